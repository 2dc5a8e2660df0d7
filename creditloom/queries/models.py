"""Spark ML queries: text vectors, clusters, default, loss and exposure models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import scalars as S
from creditloom.operators import coarse as C
from creditloom.operators import embeddings as W
from creditloom.operators import evaluation as L
from creditloom.operators import loss as Q
from creditloom.operators import models as M
from creditloom.operators import prep as P
from creditloom.operators import text as X
from creditloom.plans import hybrid as H
from creditloom.plans import structured as ST
from creditloom.plans import textual as TX
from creditloom.plans import views as V
from creditloom.queries.binning import SPECS, TRAIN_PLACED, all_loans, rounded
from creditloom.queries.registry import query, sql_on
from creditloom.queries.text import CLEAN, SENTENCES, TOKENS, quoted, token_frame
from creditloom.session import cut_lineage, new_path

SPLIT = "((id % 2147483647) * 48271 % 2147483647) % 1000 < 800"


def written_tokens(spark, d):
    """Documents with tokens, cleaned once: Word2Vec alone reads its input twice."""
    return cut_lineage(token_frame(spark, d), "tokens")


def token_parts(spark, d):
    """Documents with tokens, training and test part."""
    return P.stable_split(written_tokens(spark, d))


# The word vectors' own vocabulary: every token that occurs often enough.
VOCABULARY = TOKENS + f""",
vocab AS (SELECT token FROM tokens GROUP BY token HAVING COUNT(*) >= {K.W2V_MIN_COUNT})"""


@query("hashed_tfidf")
def hashed_tfidf(spark, d):
    tokens = token_frame(spark, d)
    fitted = W.hashed_tfidf("tokens").fit(tokens).transform(tokens)
    values = W.sparse_parts("tfidf_features")["values"]
    return fitted.select("id", F.size(F.filter(values, lambda x: x > 0)).alias("n_terms"),
                         F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("bucket_dictionary")
def bucket_dictionary(spark, d):
    return W.bucket_dictionary(token_frame(spark, d), "tokens")


@query("vector_mean_by_class")
def vector_mean_by_class(spark, d):
    tokens = token_frame(spark, d)
    means = W.vector_mean(W.hashed_tfidf("tokens").fit(tokens).transform(tokens), "tfidf_features", "good_bad")
    return means.select("good_bad", F.posexplode("mean").alias("bucket", "mean_tfidf")).where("mean_tfidf > 0")


@query("vector_mean_overall", sql_on("word_vectors", body="""
WITH x AS (SELECT unnest(vector) AS v, unnest(range(len(vector))) AS i FROM word_vectors)
SELECT CAST(i AS INTEGER) AS position, ROUND(AVG(v), 6) AS mean FROM x GROUP BY i"""))
def vector_mean_overall(spark, d):
    from pyspark.ml.functions import array_to_vector
    vectors = V.word_vectors(spark, d).select(array_to_vector("vector").alias("v"))
    return W.vector_mean(vectors, "v").select(F.posexplode("mean").alias("position", "mean")).withColumn(
        "mean", F.round("mean", 6))


@query("word2vec_vectors", sql_on("loan_text", body=f"""WITH {VOCABULARY}
SELECT token AS word, CAST({K.W2V_SIZE} AS INTEGER) AS size FROM vocab"""))
def word2vec_vectors(spark, d):
    model = W.fit_word2vec(written_tokens(spark, d), "tokens")
    return W.model_vectors(model).select("word", F.size("vector").alias("size"))


@query("word2vec_documents", sql_on("loan_text", body=f"""WITH {VOCABULARY}
SELECT id, CAST({K.W2V_SIZE} AS INTEGER) AS size FROM cleaned"""))
def word2vec_documents(spark, d):
    tokens = written_tokens(spark, d)
    return W.fit_word2vec(tokens, "tokens").transform(tokens).select(
        "id", F.size(vector_to_array("w2v_features")).alias("size"))


@query("word2vec_knowledge_base")
def word2vec_knowledge_base(spark, d):
    tokens = written_tokens(spark, d)
    model = W.fit_word2vec(tokens, "tokens")
    frequent = X.token_counts(tokens, "tokens", 13)
    vectors = W.model_vectors(model)
    return W.expand_seeds(vectors, frequent.select(F.col("token").alias("word")).join(vectors, "word"))


@query("extract_by_distance")
def extract_by_distance(spark, d):
    texts = X.text_present(V.loan_text(spark, d), "desc_")
    tokens = written_tokens(spark, d)
    vectors = W.fit_word2vec(tokens, "tokens").getVectors()
    base = [r["token"] for r in X.token_counts(tokens, "tokens", 13).collect()]
    return X.extract_by_distance(texts, "desc_", vectors, base).select("id", "extracted")


VECTOR_WORDS = SENTENCES + TOKENS.removeprefix(CLEAN) + f""",
ranked AS (SELECT token, row_number() OVER (ORDER BY COUNT(*) DESC, token) - 1 AS k FROM tokens GROUP BY token
  QUALIFY k < {K.SEQUENCE_VOCABULARY - 2}),
vectors AS (SELECT r.token AS word, r.k, CAST(e.embedding AS DOUBLE[]) AS vector FROM ranked r JOIN embeddings e ON e.vec_id = r.k)"""


@query("extract_by_given_vectors", sql_on("loan_text", body=f"""WITH {VECTOR_WORDS},
long_vectors AS (SELECT word, k, unnest(vector) AS x, unnest(range(len(vector))) AS dim FROM vectors),
centre AS (SELECT dim, AVG(x) AS c FROM long_vectors WHERE k < 13 GROUP BY dim),
size AS (SELECT sqrt(SUM(c * c)) AS size FROM centre),
line_words AS (SELECT id, pos, unnest(regexp_split_to_array(sentence, '[^\\p{{L}}\\p{{N}}''-]+')) AS w FROM lines),
counted AS (SELECT id, pos, w, COUNT(*) AS n FROM line_words WHERE length(w) > 2 AND w IN (SELECT word FROM vectors) GROUP BY 1, 2, 3),
sums AS (SELECT id, pos, dim, SUM(n * x) AS s, SUM(n) AS n FROM counted JOIN long_vectors ON w = word GROUP BY 1, 2, 3),
scores AS (SELECT id, pos, SUM(s * c) / (sqrt(SUM(s * s)) * ANY_VALUE(size)) AS score
  FROM sums JOIN centre USING (dim) CROSS JOIN size WHERE n >= 2 GROUP BY 1, 2),
best AS (SELECT l.id, l.sentence, row_number() OVER (PARTITION BY l.id ORDER BY ROUND(score, 9) DESC NULLS LAST, l.pos) AS k
  FROM lines l LEFT JOIN scores s ON l.id = s.id AND l.pos = s.pos)
SELECT c.id, COALESCE(string_agg(sentence, ' ' ORDER BY k), '') AS extracted
FROM cleaned c LEFT JOIN best b ON c.id = b.id AND k <= 2 GROUP BY c.id"""))
def extract_by_given_vectors(spark, d):
    """The k-th most frequent word has the k-th given vector; the 13 most frequent are the knowledge base."""
    texts = X.text_present(V.loan_text(spark, d), "desc_")
    codes = cut_lineage(X.vocabulary(token_frame(spark, d), "tokens"), "codes")
    given = V.word_vectors(spark, d).withColumnRenamed("word", "name")
    vectors = codes.join(given, F.concat(F.lit("w"), F.col("code") - 2) == F.col("name")).select(
        F.col("token").alias("word"), array_to_vector("vector").alias("vector"))
    base = [row["token"] for row in codes.where(F.col("code") < 15).collect()]
    return X.extract_by_distance(texts, "desc_", vectors, base).select("id", "extracted")


SHORT_STOPS = quoted(
    "i me my we he it am is be do a an if or as of at by to up in on no so s t".split())
STOPS_ALL = quoted(K.ENGLISH_STOP_WORDS) + ", " + SHORT_STOPS


@query("regex_words", f"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\W'), lambda w: w <> '' AND w NOT IN ({STOPS_ALL})) AS ws FROM conversations)
SELECT conv_id, turn, CAST(len(ws) AS INTEGER) AS n, array_to_string(ws, ' ') AS words FROM t""")
def regex_words(spark, d):
    from pyspark.ml import Pipeline
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = Pipeline(stages=W.regex_words("text", "words")).fit(rows).transform(rows)
    return out.select("conv_id", "turn", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


@query("title_one_hot", sql_on("titles", body="""
WITH t AS (SELECT id, lower(trim(emp_title)) AS v FROM titles),
k AS (SELECT v, row_number() OVER (ORDER BY COUNT(*) DESC, v) - 1 AS i FROM t GROUP BY v)
SELECT id, CAST(i AS INTEGER) AS hot, CAST((SELECT COUNT(*) FROM k) AS INTEGER) AS size FROM t JOIN k ON t.v = k.v"""))
def title_one_hot(spark, d):
    titles = V.titles(spark, d).select("id", S.normalise("emp_title").alias("v"))
    out = W.one_hot("v", "ohe").fit(titles).transform(titles)
    a = vector_to_array("ohe")
    return out.select("id", (F.array_position(a, 1.0) - 1).cast("int").alias("hot"), F.size(a).alias("size"))


@query("title_clusters")
def title_clusters(spark, d):
    titles = V.titles(spark, d).select(
        "id", S.normalise("emp_title", "missing").alias("job"), "emp_title",
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(1).alias("good_bad"))
    return X.cluster_profile(W.title_clusters("job").fit(titles).transform(titles), "emp_cluster", "emp_title")


@query("title_cluster_check", sql_on("titles", body="""
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT lower(trim(emp_title))) AS n_titles, CAST(0 AS BIGINT) AS not_nearest FROM titles"""))
def title_cluster_check(spark, d):
    """Every title's cluster against the distances to all centres, recomputed without the model from its written centres."""
    titles = V.titles(spark, d).select("id", S.normalise("emp_title", "missing").alias("job"))
    found = W.centre_distances(W.title_clusters("job").fit(titles), titles, "job")
    least = F.array_min("distances")
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("job").alias("n_titles"),
        F.count_if(F.col("distances")[F.col("emp_cluster")] > least + 1e-9).alias("not_nearest"))


@query("text_risk_score")
def text_risk_score(spark, d):
    train, test = token_parts(spark, d)
    model = W.fit_word2vec(train, "tokens")
    ready = [model.transform(part.where(F.size("tokens") > 0)).select("id", "good_bad", "w2v_features") for part in (train, test)]
    scorer = W.fit_text_score(ready[0], "w2v_features")
    return W.attach_score(test.select("id", "good_bad"), W.text_score(scorer, ready[1]))


@query("text_model_metrics")
def text_model_metrics(spark, d):
    """AUC, Gini and KS of the text-only models on the test part."""
    train, test = token_parts(spark, d)
    tfidf, w2v = W.hashed_tfidf("tokens").fit(train), W.fit_word2vec(train, "tokens")
    train, test = [
        cut_lineage(w2v.transform(tfidf.transform(p)).select("id", "good_bad", "tfidf_features", "w2v_features"), "text-features")
        for p in (train, test)
    ]
    scored = [
        M.fit_naive_bayes(train, test, "tfidf_features")[1],
        M.fit_text_lr(train, test, ["tfidf_features"], "tfidf")[1],
        M.fit_text_lr(train, test, ["w2v_features"], "w2v")[1],
        M.fit_text_lr(train, test, ["tfidf_features", "w2v_features"], "tfidf_w2v")[1],
    ]
    return L.metrics(L.cumulative(P.stack_frames(*scored)))


def split_loans(spark, d):
    return P.stable_split(cut_lineage(all_loans(spark, d), "loans"))


@query("lr_raw_vs_coarse")
def lr_raw_vs_coarse(spark, d):
    """Logistic regression on raw columns against coarse-class indicators."""
    train, test = split_loans(spark, d)
    classing = C.fit_classing(train, SPECS)
    parts = [cut_lineage(classing.indicator_vectors(part), "indicator-vectors") for part in (train, test)]
    scored = P.stack_frames(M.fit_raw_lr(train, test)[1], M.fit_indicator_lr(*parts)[1])
    return L.metrics(L.cumulative(scored)).join(L.accuracy(scored), "model")


@query("score_equations", sql_on("loan_book", body=f"""
{TRAIN_PLACED},
bad AS (SELECT feature, CAST(g AS INTEGER) AS grp, COUNT(*) FILTER (b.good_bad = 0) AS n FROM placed p JOIN loan_book b ON p.id = b.id GROUP BY feature, g)
SELECT feature, grp, n AS observed, n AS implied FROM bad
UNION ALL SELECT 'intercept', -1, COUNT(*) FILTER (good_bad = 0), COUNT(*) FILTER (good_bad = 0) FROM train_loans"""))
def score_equations(spark, d):
    """Defaults per group of the training part, as counted and as the logistic model on indicator vectors implies them.

    The implied number is the sum of predicted probabilities plus the penalty's
    part; a model that is not at its optimum gives another one.
    """
    from pyspark.ml.feature import VectorAssembler

    train, _ = split_loans(spark, d)
    classing = C.fit_classing(train, SPECS, exact_edges=True)
    vectors = cut_lineage(classing.indicator_vectors(train), "indicator-vectors").withColumn("bad_label", S.bad_label("good_bad"))
    features = list(classing.group_numbers)
    frame = VectorAssembler(inputCols=[f"{f}_ind" for f in features], outputCol="features").transform(vectors)
    model = M.logistic("bad_label", 200, tol=1e-7).fit(frame)
    M.checked(model, 200)
    sizes = [classing.group_numbers[f] for f in features]
    spans = [(f, sum(sizes[:k]), n) for k, (f, n) in enumerate(zip(features, sizes))]  # one row per feature
    places = spark.createDataFrame(spans, "feature string, start int, size int").select(
        "feature", F.posexplode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("grp", "position"))
    table = M.score_equations(model, frame, "bad_label").join(F.broadcast(places), "position", "left")
    return table.select(F.coalesce("feature", F.lit("intercept")).alias("feature"), F.coalesce("grp", F.lit(-1)).alias("grp"),
                        F.round("observed").cast("long").alias("observed"), F.round("implied").cast("long").alias("implied"))


@query("exposure_equations", sql_on("loan_book", body=f"""
{TRAIN_PLACED},
t AS (SELECT id, CASE WHEN funded_amnt > 0 THEN total_rec_prncp / funded_amnt ELSE 0.0 END AS rr, funded_amnt FROM loan_book)
SELECT feature, CAST(g AS INTEGER) AS grp, ROUND(AVG(funded_amnt * greatest(0.0, least(1.0, rr))), 2) AS mean_ead
FROM placed p JOIN t ON p.id = t.id GROUP BY feature, g"""))
def exposure_equations(spark, d):
    """Mean exposure per group of the training part, as the regression on all indicators predicts it: at its optimum the mean itself."""
    train, _ = split_loans(spark, d)
    classing = C.fit_classing(train, SPECS, exact_edges=True)
    flags = cut_lineage(classing.indicators(train), "indicators")
    columns = [c for c in flags.columns if c not in ("id", "good_bad")]
    targets = Q.with_loss_targets(V.loan_book(spark, d, "id", "funded_amnt", "total_rec_prncp"))
    model = M.fit_ead(flags, targets, columns)
    scored = model.transform(flags)
    named = [(c, f, g) for f, pairs in classing.indicator_names().items() for g, (c, _) in enumerate(pairs)]
    sums = scored.agg(*[(F.sum(F.col(f"`{c}`") * F.col("prediction")) / F.sum(f"`{c}`")).alias(c) for c, _, _ in named])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(g).alias("grp"), F.round(F.col(f"`{c}`"), 2).alias("mean_ead")) for c, f, g in named])
    return sums.select(F.inline(rows))


@query("coefficient_table")
def coefficient_table(spark, d):
    train, test = split_loans(spark, d)
    coarse = ST.fit_structured(train, test, SPECS)
    columns = coarse.strongest(60)
    result = M.fit_pd("M0", coarse.train, coarse.test, columns)
    return M.coefficient_table(result.model, coarse.train, columns, top=30)


@query("strongest_indicators")
def strongest_indicators(spark, d):
    from creditloom.operators.profile import class_mean_gap
    train, test = split_loans(spark, d)
    coarse = ST.fit_structured(train, test, SPECS)
    return class_mean_gap(coarse.train, P.integer_columns(coarse.train), top=60)


@query("skinny_text_frame", sql_on("loan_book", "loan_text", "word_vectors", body="""
SELECT b.id, b.good_bad, t.title, COALESCE(CASE WHEN t.desc_ IS NULL THEN 1 ELSE 0 END, 1) AS desc_missing, 0.0::DOUBLE AS text_score,
  ROUND(COALESCE(list_sum(v.vector), 0.0), 5) AS total
FROM loan_book b LEFT JOIN (SELECT * FROM loan_text) t ON b.id = t.id LEFT JOIN word_vectors v ON v.word = 'w' || b.id
""").replace("COALESCE(CASE WHEN t.desc_ IS NULL THEN 1 ELSE 0 END, 1)", "CASE WHEN t.desc_ IS NULL OR trim(t.desc_) = '' THEN 1 ELSE 0 END"))
def skinny_text_frame(spark, d):
    from pyspark.ml.functions import array_to_vector
    text = V.loan_text(spark, d).select(
        "id", "title", S.missing_flag("desc_").alias("desc_missing"), F.lit(None).cast("double").alias("text_score"))
    vectors = V.word_vectors(spark, d).select(
        F.expr("cast(substr(word, 2) as long)").alias("id"), array_to_vector("vector").alias("w2v_features"))
    frame = M.skinny_text_frame(V.loan_book(spark, d, "id", "good_bad"), text, {"w2v_features": vectors}, {"w2v_features": 64})
    total = F.aggregate(vector_to_array("w2v_features"), F.lit(0.0), lambda a, x: a + x)
    return frame.select("id", "good_bad", "title", "desc_missing", "text_score", F.round(total, 5).alias("total"))


@query("variant_frame", sql_on("loan_book", "loan_text", body="""
SELECT b.id, b.good_bad, b.funded_amnt, CASE WHEN t.desc_ IS NULL OR trim(t.desc_) = '' THEN 1 ELSE 0 END AS desc_missing
FROM loan_book b JOIN loan_text t ON b.id = t.id"""))
def variant_frame(spark, d):
    """Structured rows with just the text columns a variant uses."""
    text = V.loan_text(spark, d).select("id", "title", "lang", S.missing_flag("desc_").alias("desc_missing"))
    return M.variant_frame(V.loan_book(spark, d, "id", "good_bad", "funded_amnt"), ["funded_amnt"], text, ["desc_missing"])


ONE_WAY = f"""
t AS (SELECT *, CASE WHEN funded_amnt > 0 THEN total_rec_prncp / funded_amnt ELSE 0.0 END AS rr FROM loan_book),
targets AS (SELECT *, greatest(0.001, least(0.999, 1 - rr)) AS lgd, funded_amnt * greatest(0.0, least(1.0, rr)) AS ead FROM t)"""


def loss_frames(spark, d):
    loans = Q.with_loss_targets(V.loan_book(spark, d, "id", "good_bad", "grade", "funded_amnt", "total_rec_prncp"))
    flags = [F.when(F.col("grade") == g, 1).otherwise(0).alias(f"grade_{i}")
             for i, g in enumerate(["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 2)]
    return loans.select("*", *flags)


@query("lgd_model_by_grade", sql_on("loan_book", body=f"""WITH {ONE_WAY},
m AS (SELECT grade, AVG(lgd) AS lgd_pred FROM targets WHERE good_bad = 0 AND {SPLIT} GROUP BY grade)
SELECT t.id, ROUND(m.lgd_pred, 4) AS lgd_pred FROM targets t JOIN m ON t.grade = m.grade WHERE NOT ({SPLIT})"""))
def lgd_model_by_grade(spark, d):
    """With one indicator per grade the regression gives each grade's mean."""
    train, test = P.stable_split(loss_frames(spark, d))
    model = M.fit_lgd(train, train, ["grade_2", "grade_3", "grade_4", "grade_5"])
    return M.predict_lgd(model, test).withColumn("lgd_pred", F.round("lgd_pred", 4))


@query("ead_model_on_amount", sql_on("loan_book", body=f"""WITH {ONE_WAY},
m AS (SELECT regr_slope(ead, funded_amnt) AS b, regr_intercept(ead, funded_amnt) AS a FROM targets WHERE {SPLIT})
SELECT id, ROUND(greatest(a + b * funded_amnt, 0.0), 2) AS ead_pred FROM targets, m WHERE NOT ({SPLIT})"""))
def ead_model_on_amount(spark, d):
    train, test = P.stable_split(loss_frames(spark, d))
    model = M.fit_ead(train, train, ["funded_amnt"])
    return M.predict_ead(model, test).withColumn("ead_pred", F.round("ead_pred", 2))


@query("saved_model_scores", sql_on("loan_book", body=f"""
WITH m AS (SELECT grade, AVG(1.0::DOUBLE - good_bad) AS p FROM loan_book WHERE {SPLIT} GROUP BY grade)
SELECT id, ROUND(p, 3) AS prob_default FROM loan_book JOIN m USING (grade) WHERE NOT ({SPLIT})"""))
def saved_model_scores(spark, d):
    """A pipeline written to the shared folder scores after loading; one indicator per grade gives each grade's rate."""
    train, test = P.stable_split(loss_frames(spark, d))
    columns = ["grade_2", "grade_3", "grade_4", "grade_5"]
    result = M.fit_pd("saved", train, test, columns, reg=0.0, max_iter=200)
    path = new_path(spark, "pd-model")
    W.save_model(result.model, path)
    again = W.load_pipeline(path).transform(test)
    return again.select("id", F.round(S.element("probability", 0), 3).alias("prob_default"))


def hybrid_inputs(spark, d):
    loans = V.loan_book(spark, d)
    texts = V.loan_text(spark, d).select("id", F.col("desc_").alias("desc"), "title")
    jobs = V.titles(spark, d).select("id", "emp_title")
    book = loans.join(texts, "id", "left").join(jobs, "id", "left")
    return P.stable_split(cut_lineage(book, "hybrid-book"))


def hybrid(spark, d):
    train, test = hybrid_inputs(spark, d)
    coarse = ST.fit_structured(train, test, SPECS)
    text = TX.fit_text(train)
    return H.run_hybrid(coarse, text, train, test)


@query("hybrid_comparison")
def hybrid_comparison(spark, d):
    """All default models of both experiments with their measures."""
    h = hybrid(spark, d)
    return h.text_present.comparison().unionByName(h.full.comparison())


@query("hybrid_expected_loss")
def hybrid_expected_loss(spark, d):
    h = hybrid(spark, d)
    return Q.summary(h.full.expected_loss(h.lgd, h.ead))
