"""Fixed values of the credit-risk domain this library works on."""

# Loan statuses that count as default.
DEFAULT_STATUSES = [
    "Charged Off",
    "Default",
    "Late (31-120 days)",
    "Does not meet the credit policy. Status:Charged Off",
]

# Columns where a NULL means zero.
ZERO_FILLED = [
    "mths_since_earliest_cr_line", "acc_now_delinq", "total_acc", "pub_rec",
    "open_acc", "inq_last_6mths", "delinq_2yrs", "emp_length_int",
]

# Words read as "no number".
NA_WORDS = ["", "nan", "NaN", "none", "None", "null", "NULL", "N/A", "NA"]

# Fixed value: first number of a text, exponent included.
NUMBER_PATTERN = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

# Date format and reference date of the month offsets.
MONTH_FORMAT = "MMM-yyyy"
REFERENCE_DATE = "2018-12-01"

# Fixed value: name of the class that holds NULLs.
MISSING = "MISSING"

# Fixed value: added to both shares inside the logarithm of a weight of evidence.
WOE_EPSILON = 1e-9

# Discrete features of the default-probability model.
DISCRETE_FEATURES = [
    "grade", "home_ownership", "addr_state", "verification_status", "purpose",
    "initial_list_status",
]

# Continuous features, their initial bins and whether the weight
# of evidence must be monotonic. "dti" may also be called "dti_factor".
CONTINUOUS_FEATURES = {
    "term_int": (8, False),
    "emp_length_int": (11, False),
    "delinq_2yrs": (10, False),
    "inq_last_6mths": (10, False),
    "open_acc": (20, False),
    "pub_rec": (10, False),
    "acc_now_delinq": (6, False),
    "mths_since_issue_d": (30, True),
    "int_rate": (30, True),
    "funded_amnt": (30, False),
    "mths_since_earliest_cr_line": (30, True),
    "total_acc": (25, False),
    "total_rev_hi_lim": (30, False),
    "installment": (30, False),
    "annual_inc": (40, True),
    "dti": (40, True),
    "mths_since_last_delinq": (30, False),
    "mths_since_last_record": (30, False),
}
COLUMN_ALIASES = {"dti": ["dti", "dti_factor"]}

# Thresholds of the class-merging rules.
MIN_SHARE_OBS = 0.05
MIN_SHARE_GOOD = 0.05
MIN_SHARE_BAD = 0.01
MIN_WOE_STEP = 0.005
MIN_GOOD_RATE_STEP = 0.001
MAX_MERGES = 50

# Patterns removed from loan descriptions.
HTML_TAG = r"<[^>]+>"
BOILERPLATE = r"(?i)borrower added on \d{2}/\d{2}/\d{2}\s*>?"

# Stop words added to the usual English list.
DOMAIN_STOP_WORDS = [
    "``", "''", "]", "[", "*", "br",
    "'ve", "'ll", "'re", "'d", "'s", "'m", "n't",
    "would", "like", "also", "get", "one", "two", "well",
    "want", "need", "know", "make", "take", "going", "got",
    "use", "could", "much", "even", "really", "thing",
    "able", "back", "still", "every", "keep", "come",
    "year", "time", "month", "day",
    "constant", "flying", "logical", "trial", "mae", "climb", "given",
    "approving", "withdrawn",
]

# The usual English stop words (Spark ML's list) of three letters
# or more that a tokenizer can emit; shorter ones fall to the length rule.
ENGLISH_STOP_WORDS = [
    "myself", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "him", "his", "himself", "she", "her", "hers", "herself", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "are", "was", "were", "been",
    "being", "have", "has", "had", "having", "does", "did", "doing", "the", "and",
    "but", "because", "until", "while", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "from", "down", "out", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "nor", "not", "only",
    "own", "same", "than", "too", "very", "can", "will", "just", "don", "should",
    "now", "cannot", "could", "ought", "would",
]

# The contractions of that list.
ENGLISH_CONTRACTIONS = [
    "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd",
    "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've",
    "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "that's", "who's", "what's", "here's", "there's", "when's", "where's", "why's", "how's", "let's",
]

# Seed words of the default-risk knowledge base.
RISK_SEEDS = [
    "default", "missed", "late", "payment", "delinquent", "overdue", "bankrupt",
    "collection", "debt", "struggling", "hardship", "behind", "foreclosure",
]

# Sizes of the text features.
TFIDF_BUCKETS = 5000
TFIDF_MIN_DOC_FREQ = 50
W2V_SIZE = 50
W2V_MIN_COUNT = 10
W2V_WINDOW = 3
W2V_PARTITIONS = 8
W2V_PASSES = 8
TITLE_BUCKETS = 20
CLUSTER_BUCKETS = 1000
CLUSTERS = 20
SEQUENCE_VOCABULARY = 2500
SEQUENCE_LENGTH = 100
SEED = 42

# Columns never used as structured model inputs.
NOT_FEATURES = [
    "id", "member_id", "good_bad", "default_flag", "lgd", "ccf", "ead",
    "emp_length_int", "term_int", "mths_since_earliest_cr_line", "mths_since_issue_d",
]

# Text blocks added to the structured features per model variant.
VARIANTS_TEXT_PRESENT = {
    "M0_baseline": [],
    "M1_+tfidf": ["tfidf_features"],
    "M2_+w2v": ["w2v_features"],
    "M3_+text_score": ["text_score"],
    "M4_+categorical": ["title_ohe", "emp_ohe"],
    "M5_full": ["tfidf_features", "w2v_features", "text_score", "title_ohe", "emp_ohe"],
}
VARIANTS_FULL = {
    "M0_baseline_full": [],
    "M_categorical_full": ["title_ohe", "emp_ohe"],
}
