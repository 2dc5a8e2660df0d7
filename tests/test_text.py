import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import embeddings as W
from creditloom.operators import text as X

SAMPLE = "  Borrower added on 12/01/11 > I need a loan for <br> debt consolidation and paying off BILLS."


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def one(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_cleaning(spark):
    df = texts(spark, [SAMPLE, None, "", "   ", "It's 1,000 or 2000 'quoted fixed-rate élève"])
    assert one(df, X.clean_tokens("t")) == [
        ["loan", "debt", "consolidation", "paying", "bills"], [], [], [],
        ["fixed-rate", "élève"]]


def test_lemmas_keep_order_and_rows(spark):
    df = spark.createDataFrame([(1, ["bills", "loan", "bills"]), (2, [])], "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("bills", "bill")], "token string, lemma string")
    rows = {r["id"]: r["tokens"] for r in X.with_lemmas(df, "tokens", lemmas).collect()}
    assert rows == {1: ["bill", "loan", "bill"], 2: []}


def test_sentence_count(spark):
    df = texts(spark, ["One. Two! Three", "none", None])
    assert one(df, X.sentence_count("t")) == [3, 1, None]


def test_extraction_is_stable_and_whole(spark):
    df = texts(spark, ["Nice day. Missed payment. I like it. Late payment debt!", "No signal. Second. Third.", "", None])
    out = one(df, X.extract_by_match("t", ["missed", "payment", "late", "debt"], 2))
    assert out == ["late payment debt missed payment", "no signal second", "", ""]


def test_repeated_words_count_once(spark):
    df = texts(spark, ["debt debt debt. late payment."])
    assert one(df, X.extract_by_match("t", ["debt", "late", "payment"], 1)) == ["late payment"]


def test_distance_extraction_against_numpy(spark):
    vec = {"good": [1.0, 0.0], "fine": [0.9, 0.1], "debt": [0.0, 1.0], "late": [0.1, 0.9]}
    vectors = spark.createDataFrame([(w, Vectors.dense(v)) for w, v in vec.items()], ["word", "vector"])
    df = texts(spark, ["good fine fine. debt late. good debt. debt. unknown words", None])
    rows = {r["id"]: r["extracted"] for r in X.extract_by_distance(df, "t", vectors, ["debt", "late", "absent"]).collect()}
    centre = (np.array(vec["debt"]) + vec["late"]) / 2

    def cos(words):
        m = np.mean([vec[w] for w in words], axis=0)
        return m @ centre / np.linalg.norm(m) / np.linalg.norm(centre)

    assert cos(["debt", "late"]) > cos(["good", "debt"]) > cos(["good", "fine", "fine"])
    assert rows == {0: "debt late good debt", 1: ""}


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, 0, ["debt", "debt", "car"]), (2, 1, ["car"]), (3, 1, [])], "id int, good_bad int, tokens array<string>")
    rows = {r["token"]: r for r in X.mean_tfidf(df, "tokens").collect()}
    assert rows["debt"]["mean_tfidf"] == pytest.approx(2 * np.log(4 / 2) / 3)
    assert rows["car"]["mean_tfidf"] == pytest.approx(2 * np.log(4 / 3) / 3)
    assert X.mean_tfidf(df, "tokens", min_doc_freq=2).where("token = 'debt'").first()["mean_tfidf"] == 0.0
    gap = {r["token"]: r["difference"] for r in X.tfidf_contrast(df, "tokens").collect()}
    assert gap["debt"] == pytest.approx(2 * np.log(2)) and gap["car"] == pytest.approx(np.log(4 / 3) * (1 - 0.5))


def test_sql_tfidf_equals_hashed_tfidf_without_collisions(spark):
    df = spark.createDataFrame([(1, ["debt", "debt", "car"]), (2, ["car", "house"])], "id int, tokens array<string>")
    hashed = W.hashed_tfidf("tokens", buckets=1 << 18, min_doc_freq=0).fit(df).transform(df)
    total = sum(float(sum(r["tfidf_features"].values)) for r in hashed.collect())
    assert X.mean_tfidf(df, "tokens").agg(F.sum("mean_tfidf") * 2).first()[0] == pytest.approx(total)


def test_bucket_dictionary_uses_the_stage_hash(spark):
    from pyspark.ml.feature import HashingTF
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, words + ["w3", "w3"])], "id int, tokens array<string>")
    stage = HashingTF(numFeatures=16)
    best: dict = {}
    for w in words:
        n, b = (3 if w == "w3" else 1), stage.indexOf(w)
        if b not in best or (-n, w) < best[b]:
            best[b] = (-n, w)
    got = {r["bucket"]: r["token"] for r in W.bucket_dictionary(df, "tokens", 16).collect()}
    assert got == {b: w for b, (_, w) in best.items()}


def test_cosine_and_nearest(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0]), ("z", [0.0, 0.0])], "word string, vector array<double>")
    m = {(r["word_a"], r["word_b"]): r["cosine"] for r in X.cosine_matrix(df, ["a", "b", "z", "absent"]).collect()}
    assert len(m) == 9 and m["a", "b"] == pytest.approx(2 ** -0.5) and m["a", "z"] == 0.0 and m["a", "a"] == 1.0
    near = X.nearest(df, df.where("word = 'a'"), 2).orderBy("rank").collect()
    assert [r["word"] for r in near] == ["b", "c"]
    base = {r["word"] for r in W.expand_seeds(df, df.where("word = 'a'"), 1, ["ghost"]).collect()}
    assert base == {"a", "b", "ghost"}


def test_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"] + ["a"] * 5), (3, [])], "id int, tokens array<string>")
    vocab = X.vocabulary(df, "tokens", 4)
    assert {r["token"]: r["code"] for r in vocab.collect()} == {"a": 2, "b": 3}
    rows = {r["id"]: r["sequence"] for r in X.encode_sequences(df, "tokens", vocab, length=4).collect()}
    assert rows == {1: [2, 2, 3, 0], 2: [1, 2, 2, 2], 3: [0, 0, 0, 0]}


def test_buckets_and_profile(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("c", 1), (None, 1)], "v string, good_bad int")
    out = X.top_bucket(df, "v", "b", ["a"])
    assert sorted(r["b"] for r in out.collect()) == ["a", "a", "other", "other", "other"]
    cover = X.bucket_coverage(out, "b").orderBy("cum_pct").collect()
    assert [(r["b"], r["count"], r["cum_pct"]) for r in cover] == [("other", 3, 60.0), ("a", 2, 100.0)]
    prof = X.cluster_profile(df.where("v is not null").withColumn("k", F.lit(0)), "k", "v", keep=2).first()
    assert (prof["size"], prof["top_titles"], prof["default_rate"]) == (4, "a / b", 0.25)


def test_lookup_join_ways_agree(spark):
    from creditloom.session import lookup_join
    facts = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = facts.select("k").distinct().where("k <> '1'").withColumn("v", F.length("k"))
    small = lookup_join(facts, lookup, "k")
    salted = lookup_join(facts, lookup, "k", salt_by="id", salts=4, limit=1)
    assert small.exceptAll(salted.select(*small.columns)).count() == 0 and salted.count() == 900


def test_measured_bytes(spark):
    from creditloom.session import measured_bytes
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 300).alias("v"), F.repeat(F.lit("é"), 50).alias("s"))
    assert measured_bytes(wide) == 10 * (16 + 16 + 16 + 300 * 8 + 16 + 100)
    assert measured_bytes(wide.limit(0)) == 0


def test_text_score_and_one_hot(spark):
    rows = [(i, i % 4 > 0, Vectors.dense([float(i % 4 > 0), 0.1 * (i % 3)])) for i in range(80)]
    df = spark.createDataFrame([(i, int(g), v) for i, g, v in rows], ["id", "good_bad", "v"])
    model = W.fit_text_score(df, "v")
    scores = W.text_score(model, df)
    out = W.attach_score(df.select("id").union(spark.createDataFrame([(999,)], "id long")), scores)
    assert out.where("id = 999").first()["text_score"] == 0.0
    assert out.where("id % 4 > 0 AND id < 80").agg(F.avg("text_score")).first()[0] > 0.8
    hot = W.one_hot("t", "o").fit(spark.createDataFrame([("a",), ("a",), ("b",)], "t string"))
    assert hot.transform(spark.createDataFrame([("new",)], "t string")).first()["o"].size == 2


def test_word2vec_repeats_with_one_partition(spark):
    df = spark.createDataFrame([(i, ["debt", "loan", "late", f"w{i % 3}"]) for i in range(60)], "id int, tokens array<string>")
    a = W.fit_word2vec(df, "tokens", size=5, min_count=5, partitions=1)
    b = W.fit_word2vec(df, "tokens", size=5, min_count=5, partitions=1)
    assert W.model_vectors(a).orderBy("word").collect() == W.model_vectors(b).orderBy("word").collect()
    assert "debt" in W.knowledge_base(a, ["debt", "nowhere"], 2)
    mean = W.vector_mean(a.transform(df), "w2v_features").first()["mean"]
    assert len(mean) == 5


def test_clean_tokens_of_a_sentence(spark):
    text = "I don't think we've paid; the loan isn't late --- can't say, won't say 2024 mid-term O'Brien"
    row = spark.createDataFrame([(text,)], "t string").select(X.clean_tokens("t")).first()[0]
    assert row == ["think", "paid", "loan", "late", "say", "say", "mid-term", "o'brien"]


def test_clean_tokens_by_patterns_and_without(spark):
    """Trimming a word's start decides as the patterns do, and no word meets a pattern."""
    bits = ["<", ">", "<b>", "/", "borrower added on 01/02/03 >", "Borrower Added on 11/12/13", "1", "333", "٣٣٣", " ", ".", "é", "É", "ab", "the",
            "don't", "'", "-", "---", "''", "-12-", "²³", "İ", "漢字漢", "\n", "_", "a<c/d>e"]
    rows = [("".join(bits[(i * 7 + k * k * (i % 5 + 1) + i // 9) % len(bits)] for k in range(30)),) for i in range(300)]
    df = spark.createDataFrame([*rows, (None,)], "t string")
    body = F.lower(F.regexp_replace(F.regexp_replace("t", K.HTML_TAG, " "), K.BOILERPLATE, ""))
    stops = [*K.ENGLISH_STOP_WORDS, *K.ENGLISH_CONTRACTIONS, *K.DOMAIN_STOP_WORDS]
    by_patterns = F.filter(F.split(body, X.WORD_BREAK), lambda w: (F.length(w) > 2) & ~w.startswith("'") & ~w.rlike("^[0-9]+$")
                           & w.rlike(r"[\p{L}\p{N}]") & ~w.isin(stops))
    made = df.select(X.strip_markup("t").alias("body"), X.clean_tokens("t").alias("tokens"), body.alias("body_was"),
                     F.coalesce(by_patterns, F.array().cast("array<string>")).alias("tokens_were"))
    assert made.where("NOT (body <=> body_was AND tokens <=> tokens_were)").count() == 0
    assert made.where("size(tokens) > 0").count() > 200
    assert "RLIKE" not in df.select(X.clean_tokens("t"))._jdf.queryExecution().analyzed().toString().upper()


def test_frequent_join_equals_a_join(spark):
    """Repeated and NULL keys included, whatever part of the lookup fits; the facts of a frequent key are not shuffled."""
    from creditloom.session import frequent_join, measured_bytes

    facts = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"w{i % 40}") for i in range(600)], "id int, k string")
    lookup = spark.createDataFrame([("hot", 1.0), (None, 9.0), ("w1", 1.5), ("w1", 1.25), *[(f"w{i}", float(i)) for i in range(2, 300)]], "k string, v double")
    plain = sorted(map(tuple, facts.join(lookup, "k").collect()))
    size = measured_bytes(lookup)
    for limit in (0, 1, size // 100, size // 10, size // 2, size):
        assert sorted(map(tuple, frequent_join(facts, lookup, "k", salt_by="id", limit=limit).collect())) == plain
    assert frequent_join(facts, lookup.where("k = 'absent'"), "k", salt_by="id", limit=0).count() == 0
    assert frequent_join(facts, lookup.where("k <> 'hot'"), "k", salt_by="id", limit=size // 10).where("k = 'hot'").count() == 0
    assert "frequent-" in frequent_join(facts, lookup, "k", salt_by="id", limit=size // 10)._jdf.queryExecution().toString()


def test_extract_by_distance_broadcasts_what_it_can(spark, monkeypatch):
    """The result is the same with all vectors broadcast, some and none; frequent words join where they lie."""
    from creditloom import session

    rng = np.random.default_rng(3)
    names = [f"word{i}" for i in range(60)]
    vectors = spark.createDataFrame([(w, Vectors.dense(rng.normal(size=4))) for w in names], ["word", "vector"])
    rows = [(i, ". ".join(" ".join(names[int(k)] for k in rng.zipf(1.5, 4) % 60) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, None), (40, "word1 word2. word3 word4. word5 word6"), (None, "word1 word2")], "id int, t string")

    def extracted():
        return X.extract_by_distance(df, "t", vectors, names[:5])

    whole = sorted(extracted().select("id", "extracted").collect(), key=str)
    join, seen = session.lookup_join, []
    monkeypatch.setattr(session, "lookup_join", lambda facts, lookup, *a, **k: (seen.append((facts, lookup)), join(facts, lookup, *a, **k))[1])
    monkeypatch.setattr(X, "frequent_join", lambda *a, **k: session.frequent_join(*a, **k, limit=2000))
    assert sorted(extracted().select("id", "extracted").collect(), key=str) == whole
    first = [lookup.count() for _, lookup in seen if "_v0" in lookup.columns]
    assert sum(first) == 60 and all(first), "some vectors go with the frequent words, the others with the rest"


def test_nearest_takes_any_number_of_seeds(spark):
    vectors = spark.range(1200).selectExpr("concat('w', id) AS word", "array(cos(id / 400D), sin(id / 400D)) AS vector")
    found = X.nearest(vectors, vectors, 1)
    assert found.count() == 1200
    assert found.where("abs(cast(substring(seed, 2) AS int) - cast(substring(word, 2) AS int)) <> 1").count() == 0


def test_centre_distances_follow_the_words_not_the_buckets(spark):
    df = texts(spark, ["senior nurse", "nurse", "lorry driver", "driver", "", "nurse nurse driver"])
    model = W.title_clusters("t", k=2, buckets=20_000).fit(df)
    found = W.centre_distances(model, df, "id")
    # The centres are a row, not 40,000 literals, and no row becomes an array as wide as the buckets.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 40_000 and "vector_to_array" not in plan
    centres = model.stages[-2].clusterCenters()
    want = {r["id"]: r["_title_tfidf"].toArray() for r in model.transform(df).collect()}
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 6
    for key, x in want.items():
        assert got[key]["distances"] == pytest.approx([((x - c) ** 2).sum() for c in centres], abs=1e-9)
        assert got[key]["emp_cluster"] == int(np.argmin(got[key]["distances"]))
