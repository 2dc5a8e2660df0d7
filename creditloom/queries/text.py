"""Text feature queries over the documents, titles and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import scalars as S
from creditloom.operators import text as X
from creditloom.operators import profile as E
from creditloom.plans import views as V
from creditloom.queries.registry import query, sql_on
from creditloom.session import cut_lineage


def r(c, digits=6):
    return F.round(c, digits)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOPS = quoted(dict.fromkeys([*K.ENGLISH_STOP_WORDS, *K.ENGLISH_CONTRACTIONS, *K.DOMAIN_STOP_WORDS]))
# Words that occur in the test documents, as a stand-in knowledge base.
KNOWN_RISK = ["the", "with", "were", "which", "dans", "pour", "nicht", "wird", "para", "como", *K.RISK_SEEDS]

CLEAN = """
cleaned AS (
  SELECT id, good_bad, lower(regexp_replace(regexp_replace(desc_, '<[^>]+>', ' ', 'g'),
    '(?i)borrower added on \\d{2}/\\d{2}/\\d{2}\\s*>?', '', 'g')) AS body
  FROM loan_text WHERE desc_ IS NOT NULL AND desc_ <> '')"""
TOKENS = CLEAN + f""",
raw_tokens AS (
  SELECT id, good_bad, unnest(regexp_split_to_array(body, '[^\\p{{L}}\\p{{N}}''-]+')) AS token FROM cleaned),
tokens AS (
  SELECT * FROM raw_tokens WHERE length(token) > 2 AND NOT starts_with(token, '''')
    AND NOT regexp_full_match(token, '[0-9]+') AND regexp_matches(token, '[\\p{{L}}\\p{{N}}]') AND token NOT IN ({STOPS}))"""
SENTENCES = CLEAN + """,
pieces AS (SELECT id, regexp_split_to_array(body, '[.!?]+') AS parts FROM cleaned),
numbered AS (
  SELECT id, unnest(parts) AS part, unnest(range(len(parts))) AS n FROM pieces),
lines AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pos, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS sentence
  FROM numbered WHERE trim(regexp_replace(part, '\\s+', ' ', 'g')) <> '')"""


def token_frame(spark, d):
    present = X.text_present(V.loan_text(spark, d), "desc_")
    return present.select("id", "good_bad", X.clean_tokens("desc_").alias("tokens"))


@query("strip_markup", sql_on("loan_text", body=f"WITH {CLEAN} SELECT id, body FROM cleaned"))
def strip_markup(spark, d):
    present = X.text_present(V.loan_text(spark, d), "desc_")
    return present.select("id", X.strip_markup("desc_").alias("body"))


@query("strip_markup_pages", """
SELECT page_id, lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '(?i)borrower added on \\d{2}/\\d{2}/\\d{2}\\s*>?', '', 'g')) AS body FROM pages""")
def strip_markup_pages(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.strip_markup("html").alias("body"))


@query("clean_tokens", sql_on("loan_text", body=f"""WITH {TOKENS}
SELECT t.id, COALESCE(k.n, 0) AS n_tokens, COALESCE(k.joined, '') AS joined FROM loan_text t LEFT JOIN (
  SELECT id, COUNT(*) AS n, string_agg(token, ' ' ORDER BY token) AS joined FROM tokens GROUP BY id) k ON t.id = k.id"""))
def clean_tokens(spark, d):
    return V.loan_text(spark, d).select("id", X.clean_tokens("desc_").alias("t")).select(
        "id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.sort_array("t"), " ").alias("joined"))


@query("clean_tokens_lemmas", sql_on("loan_text", body=f"""WITH {TOKENS},
words AS (SELECT DISTINCT token FROM tokens),
lemmas AS (SELECT a.token, b.token AS lemma FROM words a JOIN words b ON a.token = b.token || 's'),
named AS (SELECT t.id, COALESCE(l.lemma, t.token) AS token FROM tokens t LEFT JOIN lemmas l ON t.token = l.token)
SELECT t.id, COALESCE(k.n, 0) AS n_tokens, COALESCE(k.joined, '') AS joined FROM loan_text t LEFT JOIN (
  SELECT id, COUNT(*) AS n, string_agg(token, ' ' ORDER BY token) AS joined FROM named GROUP BY id) k ON t.id = k.id"""))
def clean_tokens_lemmas(spark, d):
    """The dictionary comes from the texts: a word with an ``s`` after another word stands for that."""
    frame = cut_lineage(V.loan_text(spark, d).select("id", X.clean_tokens("desc_").alias("t")), "tokens")
    words = frame.select(F.explode("t").alias("lemma")).distinct()
    several = words.select(F.col("lemma").alias("token"))
    lemmas = several.join(words, F.col("token") == F.concat("lemma", F.lit("s")))
    return X.with_lemmas(frame, "t", lemmas).select(
        "id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.sort_array("t"), " ").alias("joined"))


@query("token_frequency", sql_on("loan_text", body=f"""WITH {TOKENS}
SELECT token, COUNT(*) AS "count" FROM tokens GROUP BY token ORDER BY 2 DESC, 1 LIMIT 5000"""))
def token_frequency(spark, d):
    return X.token_counts(token_frame(spark, d), "tokens", 5000)


STATS = TOKENS + """,
docs AS (SELECT COUNT(*) AS n, CAST(SUM(1 - good_bad) AS BIGINT) AS bad, CAST(SUM(good_bad) AS BIGINT) AS good FROM cleaned),
tfs AS (SELECT id, good_bad, token, COUNT(*) AS tf FROM tokens GROUP BY id, good_bad, token),
stats AS (SELECT token, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS tf,
  CAST(SUM(CASE WHEN good_bad = 0 THEN tf ELSE 0 END) AS BIGINT) AS tf_bad,
  CAST(SUM(CASE WHEN good_bad = 1 THEN tf ELSE 0 END) AS BIGINT) AS tf_good FROM tfs GROUP BY token),
weights AS (SELECT s.*, d.n, d.bad, d.good, CASE WHEN df >= 50 THEN ln((d.n + 1.0::DOUBLE) / (df + 1)) ELSE 0.0 END AS idf
  FROM stats s, docs d)"""


@query("tfidf_mean_all", sql_on("loan_text", body=f"""WITH {STATS}
SELECT token, df, tf, ROUND(idf, 6) AS idf, ROUND(tf * idf / n, 6) AS mean_tfidf FROM weights"""))
def tfidf_mean_all(spark, d):
    table = X.mean_tfidf(token_frame(spark, d), "tokens", min_doc_freq=K.TFIDF_MIN_DOC_FREQ)
    return table.select("token", "df", "tf", r("idf").alias("idf"), r("mean_tfidf").alias("mean_tfidf"))


@query("tfidf_top_terms", sql_on("loan_text", body=f"""WITH {STATS}
SELECT token, ROUND(tf * idf / n, 6) AS mean_tfidf FROM weights ORDER BY ROUND(tf * idf / n, 9) DESC, token LIMIT 20"""))
def tfidf_top_terms(spark, d):
    table = X.mean_tfidf(token_frame(spark, d), "tokens", min_doc_freq=K.TFIDF_MIN_DOC_FREQ)
    return X.top_terms(table, "mean_tfidf").select("token", r("mean_tfidf").alias("mean_tfidf"))


@query("tfidf_top_contrast", sql_on("loan_text", body=f"""WITH {STATS},
gaps AS (SELECT token, tf_bad * idf / greatest(bad, 1) AS b, tf_good * idf / greatest(good, 1) AS g FROM weights)
SELECT token, ROUND(b, 6) AS mean_bad, ROUND(g, 6) AS mean_good, ROUND(b - g, 6) AS difference FROM gaps
ORDER BY ROUND(ABS(b - g), 9) DESC, token LIMIT 20"""))
def tfidf_top_contrast(spark, d):
    table = X.tfidf_contrast(token_frame(spark, d), "tokens", min_doc_freq=K.TFIDF_MIN_DOC_FREQ)
    return X.top_terms(table, "difference").select(
        "token", *[r(c).alias(c) for c in ("mean_bad", "mean_good", "difference")])


SCORED_LINES = SENTENCES + f""",
line_words AS (SELECT id, pos, unnest(regexp_split_to_array(sentence, '[^\\p{{L}}\\p{{N}}''-]+')) AS w FROM lines),
hits AS (SELECT id, pos, COUNT(DISTINCT w) AS score FROM line_words
  WHERE length(w) > 2 AND w IN ({quoted(KNOWN_RISK)}) GROUP BY id, pos),
scores AS (SELECT l.id, l.pos, l.sentence, COALESCE(h.score, 0) AS score FROM lines l
  LEFT JOIN hits h ON l.id = h.id AND l.pos = h.pos)"""


@query("sentence_scores", sql_on("loan_text", body=f"""WITH {SCORED_LINES}
SELECT id, CAST(pos AS INTEGER) AS pos, sentence, CAST(score AS INTEGER) AS score FROM scores"""))
def sentence_scores(spark, d):
    return X.sentence_scores(X.text_present(V.loan_text(spark, d), "desc_"), "desc_", KNOWN_RISK)


@query("extract_sentences", sql_on("loan_text", body=f"""WITH {SCORED_LINES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS k FROM scores),
best AS (SELECT id, string_agg(sentence, ' ' ORDER BY k) AS extracted FROM ranked WHERE k <= 2 GROUP BY id)
SELECT t.id, COALESCE(b.extracted, '') AS extracted FROM loan_text t LEFT JOIN best b ON t.id = b.id"""))
def extract_sentences(spark, d):
    return V.loan_text(spark, d).select("id", X.extract_by_match("desc_", KNOWN_RISK, 2).alias("extracted"))


@query("vocabulary_codes", sql_on("loan_text", body=f"""WITH {TOKENS},
top AS (SELECT token, COUNT(*) AS n FROM tokens GROUP BY token ORDER BY 2 DESC, 1 LIMIT 2498)
SELECT token, CAST(1 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS code FROM top"""))
def vocabulary_codes(spark, d):
    return X.vocabulary(token_frame(spark, d), "tokens")


@query("encode_sequences", sql_on("loan_text", body=f"""WITH {CLEAN},
split_up AS (SELECT id, list_filter(regexp_split_to_array(body, '[^\\p{{L}}\\p{{N}}''-]+'), lambda w: w <> '') AS ws FROM cleaned),
word_rows AS (SELECT id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM split_up),
top AS (SELECT token, COUNT(*) AS n FROM word_rows GROUP BY token ORDER BY 2 DESC, 1 LIMIT 2498),
vocab AS (SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS code FROM top),
coded AS (SELECT w.id, w.pos, COALESCE(v.code, 1) AS code FROM word_rows w LEFT JOIN vocab v ON w.token = v.token WHERE w.pos < 100),
lists AS (SELECT id, COUNT(*) AS n, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY pos) AS s FROM coded GROUP BY id)
SELECT c.id, trim(COALESCE(l.s, '') || repeat(' 0', CAST(100 - COALESCE(l.n, 0) AS INTEGER))) AS sequence
FROM cleaned c LEFT JOIN lists l ON c.id = l.id"""))
def encode_sequences(spark, d):
    present = X.text_present(V.loan_text(spark, d), "desc_")
    tokens = present.select("id", X.words(X.strip_markup("desc_")).alias("tokens"))
    coded = X.encode_sequences(tokens, "tokens", X.vocabulary(tokens, "tokens"))
    return coded.select("id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"))


CENTRES = """
dims AS (SELECT label, unnest(vector) AS v, unnest(range(len(vector))) AS i FROM word_vectors),
means AS (SELECT label, i, AVG(v) AS m FROM dims GROUP BY label, i),
centres AS (SELECT 'c' || label AS word, list(m ORDER BY i) AS vector FROM means GROUP BY label)"""


def centres(spark, d):
    means = X.mean_vectors(V.word_vectors(spark, d), "label")
    return means.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("word"), "vector")


@query("cosine_matrix", sql_on("word_vectors", body=f"""WITH {CENTRES}
SELECT a.word AS word_a, b.word AS word_b, ROUND(list_cosine_similarity(a.vector, b.vector), 5) AS cosine
FROM centres a CROSS JOIN centres b"""))
def cosine_matrix(spark, d):
    return X.cosine_matrix(centres(spark, d)).withColumn("cosine", r("cosine", 5))


@query("nearest_words", sql_on("word_vectors", body=f"""WITH {CENTRES},
s AS (SELECT c.word AS seed, v.word, list_cosine_similarity(c.vector, v.vector) AS cosine FROM centres c CROSS JOIN word_vectors v),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ROUND(cosine, 9) DESC, word) AS rank FROM s)
SELECT seed, word, ROUND(cosine, 5) AS cosine, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5"""))
def nearest_words(spark, d):
    return X.nearest(V.word_vectors(spark, d), centres(spark, d), 5).withColumn("cosine", r("cosine", 5))


@query("knowledge_base", sql_on("word_vectors", body=f"""WITH {CENTRES},
s AS (SELECT c.word AS seed, v.word, list_cosine_similarity(c.vector, v.vector) AS cosine FROM centres c CROSS JOIN word_vectors v),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ROUND(cosine, 9) DESC, word) AS rank FROM s)
SELECT word FROM k WHERE rank <= 5 UNION SELECT word FROM centres UNION SELECT 'absent'"""))
def knowledge_base(spark, d):
    from creditloom.operators.embeddings import expand_seeds
    seeds = centres(spark, d)
    return expand_seeds(V.word_vectors(spark, d), seeds, extra_seeds=["absent"])


@query("vector_lookup", sql_on("titles", "word_vectors", body="""
SELECT t.id, 'w' || t.id AS word, ROUND(COALESCE(list_sum(v.vector), 0.0), 5) AS total, CAST(COALESCE(len(v.vector), 64) AS INTEGER) AS size
FROM titles t LEFT JOIN word_vectors v ON v.word = 'w' || t.id"""))
def vector_lookup(spark, d):
    words = V.titles(spark, d).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    found = X.vector_lookup(words, V.word_vectors(spark, d), 64)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return found.select("id", "word", r(total, 5).alias("total"), F.size("vector").alias("size"))


@query("title_buckets", sql_on("titles", body="""
WITH t AS (SELECT id, lower(trim(emp_title)) AS norm FROM titles),
top AS (SELECT norm FROM t WHERE norm IS NOT NULL GROUP BY norm ORDER BY COUNT(*) DESC, norm LIMIT 20)
SELECT id, CASE WHEN norm IN (SELECT norm FROM top) THEN norm ELSE 'other' END AS title_bucket FROM t"""))
def title_buckets(spark, d):
    return bucketed_titles(spark, d).select("id", "title_bucket")


def bucketed_titles(spark, d):
    titles = V.titles(spark, d).withColumn("norm", S.normalise("emp_title"))
    top = [row["norm"] for row in X.top_values(titles, "norm", K.TITLE_BUCKETS).collect()]
    return X.top_bucket(titles, "norm", "title_bucket", top)


@query("bucket_coverage", sql_on("titles", body="""
WITH t AS (SELECT id, lower(trim(emp_title)) AS norm FROM titles),
top AS (SELECT norm FROM t WHERE norm IS NOT NULL GROUP BY norm ORDER BY COUNT(*) DESC, norm LIMIT 20),
b AS (SELECT CASE WHEN norm IN (SELECT norm FROM top) THEN norm ELSE 'other' END AS title_bucket FROM t),
c AS (SELECT title_bucket, COUNT(*) AS n FROM b GROUP BY title_bucket)
SELECT title_bucket, n AS "count", ROUND(SUM(n) OVER (ORDER BY n DESC, title_bucket ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / (SELECT SUM(n) FROM c), 6) AS cum_pct FROM c"""))
def bucket_coverage(spark, d):
    return X.bucket_coverage(bucketed_titles(spark, d), "title_bucket").withColumn("cum_pct", r("cum_pct"))


@query("cluster_profile", """
WITH p AS (SELECT p_brand, p_name, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS good_bad FROM part),
c AS (SELECT p_brand, p_name, COUNT(*) AS n, SUM(1 - good_bad) AS bad FROM p GROUP BY p_brand, p_name),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS k FROM c)
SELECT p_brand, CAST(SUM(n) AS BIGINT) AS size, string_agg(p_name, ' / ' ORDER BY k) FILTER (WHERE k <= 3) AS top_titles,
  ROUND(SUM(bad) / SUM(n), 6) AS default_rate FROM k GROUP BY p_brand""")
def cluster_profile(spark, d):
    titles = V.titles(spark, d).withColumn("good_bad", F.when(F.col("p_size") % 5 == 0, 0).otherwise(1))
    profile = X.cluster_profile(titles, "p_brand", "emp_title")
    return profile.withColumn("default_rate", r("default_rate"))


@query("title_default_rates", sql_on("loan_text", body="""
SELECT title, COUNT(*) AS "count", ROUND(1 - AVG(good_bad), 6) AS default_rate FROM loan_text GROUP BY title"""))
def title_default_rates(spark, d):
    return E.default_rates(V.loan_text(spark, d), "title").withColumn("default_rate", r("default_rate"))
