import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from creditloom.operators import embeddings as W
from creditloom.operators import models as M
from creditloom.operators import prep as P
from creditloom.plans import general as G


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b = int(rng.random() < 0.5), int(rng.random() < 0.3)
        good = int(rng.random() < 0.5 + 0.3 * a)
        rows.append((i, good, a, 1 - a, b, float(0.2 + 0.3 * a + 0.05 * rng.random()), 1000.0 * (1 + a) + 10 * b))
    return spark.createDataFrame(rows, "id int, good_bad int, a int, not_a int, b int, lgd double, ead double")


def test_probability_is_that_of_default(spark, loans):
    result = M.fit_pd("m", loans, loans, ["a", "b"], reg=0.0)
    rates = loans.groupBy("a").agg((1 - F.avg("good_bad")).alias("r"))
    got = result.predictions.join(loans.select("id", "a"), "id").groupBy("a").agg(F.avg("prob_default").alias("p"))
    for row in got.join(rates, "a").collect():
        assert row["p"] == pytest.approx(row["r"], abs=1e-3)
    table = M.coefficient_table(result.model, loans, ["a", "b"]).collect()
    assert table[0]["feature"] == "a" and table[0]["coefficient"] > 0


def test_loss_models_take_dependent_indicators(spark, loans):
    lgd = M.predict_lgd(M.fit_lgd(loans, loans, ["a", "not_a"]), loans).join(loans.select("id", "a"), "id")
    want = {r["a"]: r["m"] for r in loans.where("good_bad = 0").groupBy("a").agg(F.avg("lgd").alias("m")).collect()}
    for row in lgd.groupBy("a").agg(F.avg("lgd_pred").alias("m")).collect():
        assert row["m"] == pytest.approx(want[row["a"]], abs=1e-3)
    model = M.fit_ead(loans, loans, ["a", "not_a", "b"])
    assert M.r_squared(model) == pytest.approx(1.0, abs=1e-4)
    assert M.predict_ead(model, loans).agg(F.min("ead_pred")).first()[0] >= 0


def test_skinny_frame_fills_zero_vectors(spark, loans):
    text = spark.createDataFrame([(0, 1, 0, 3, 0.7)], "id int, good_bad int, desc_missing int, emp_cluster int, text_score double")
    vec = spark.createDataFrame([(0, Vectors.dense([1.0, 2.0]))], ["id", "w2v_features"])
    out = M.skinny_text_frame(loans, text, {"w2v_features": vec}, {"w2v_features": 2})
    rows = {r["id"]: r for r in out.where("id < 2").collect()}
    assert rows[0]["text_score"] == 0.7 and list(rows[0]["w2v_features"]) == [1.0, 2.0]
    assert rows[1]["w2v_features"] == Vectors.sparse(2, [], []) and rows[1]["desc_missing"] == 1
    assert out.count() == 600
    result = M.fit_pd("v", loans.join(out.drop("good_bad"), "id"), loans.join(out.drop("good_bad"), "id"), ["a", "w2v_features"])
    assert result.n_columns == 2 and result.n_features == 3 and result.predictions.count() == 600
    assert M.feature_names(out, ["text_score", "w2v_features"]) == ["text_score", "w2v_features_0", "w2v_features_1"]


def test_raw_and_indicator_models(spark, loans):
    raw = loans.select("id", "good_bad", "ead", F.when(F.col("a") == 1, "x").alias("s"))
    _, scores = M.fit_raw_lr(raw, raw)
    assert scores.count() == 600 and scores.where("score IS NULL").count() == 0
    _, coarse = M.fit_indicator_lr(loans.select("id", "good_bad", "a", "b"), loans.select("id", "good_bad", "a", "b"))
    by = coarse.join(loans.select("id", "a"), "id").groupBy("a").agg(F.avg("score").alias("s")).collect()
    by = {r["a"]: r["s"] for r in by}
    assert by[0] > by[1]


def test_naive_bayes_and_saved_model(spark, loans, tmp_path):
    df = loans.select("id", "good_bad", F.col("a").cast("double").alias("a"))
    stages = M.assembler_stages(df, ["a"], "v")
    ready = stages[-1].transform(df)
    _, scores = M.fit_naive_bayes(ready, ready, "v")
    assert scores.count() == 600
    result = M.fit_pd("m", loans, loans, ["a"])
    W.save_model(result.model, str(tmp_path / "m"))
    again = W.load_pipeline(str(tmp_path / "m")).transform(loans)
    from creditloom.functions.scalars import element
    a = [r[0] for r in again.orderBy("id").select(element("probability", 0)).collect()]
    b = [r["prob_default"] for r in result.predictions.orderBy("id").collect()]
    assert a == b


def test_general_preparation(spark):
    schema = ("id long, loan_status string, emp_length string, term string, earliest_cr_line string, issue_d string, "
              "annual_inc double, funded_amnt double, total_rev_hi_lim double, open_acc double")
    train = spark.createDataFrame([
        (1, "Current", "10+ years", " 36 months", "Jan-2000", "Dec-2015", 10.0, 100.0, None, None),
        (2, "Charged Off", "< 1 year", " 60 months", "Jan-2020", "Dec-2016", None, 300.0, 5.0, 2.0),
        (3, "Default", None, " 60 months", None, "Dec-2016", 30.0, None, None, 2.0)], schema)
    a, b = G.prepare(train, train.where("id = 2"))
    rows = {r["id"]: r for r in a.collect()}
    assert rows[1]["emp_length_int"] == 10 and rows[2]["emp_length_int"] == 0 and rows[3]["emp_length_int"] == 0
    assert rows[1]["term_int"] == 36 and rows[1]["mths_since_issue_d"] == 36
    assert rows[1]["mths_since_earliest_cr_line"] == 227 == rows[2]["mths_since_earliest_cr_line"]
    assert rows[3]["mths_since_earliest_cr_line"] == 0
    assert rows[3]["funded_amnt"] == 200.0 and rows[3]["total_rev_hi_lim"] == 200.0 and rows[2]["annual_inc"] in (10.0, 30.0)
    assert [rows[i]["good_bad"] for i in (1, 2, 3)] == [1, 0, 0] and rows[1]["open_acc"] == 0.0
    # The test part takes the training part's largest offset.
    assert b.first()["mths_since_earliest_cr_line"] == 227


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8, 16, 40])
def test_random_split_share(spark, parts):
    df = spark.range(1500).repartition(parts)
    train, test = P.random_split(df)
    assert train.count() + test.count() == 1500 and train.union(test).distinct().count() == 1500
    assert (train.count() / 1500 - 0.8) ** 2 * 1500 < 25 * 0.16


def numbers(spark, n=600):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        kind = i % 3
        a, x = float(kind == 0), float(rng.standard_normal())
        y = int(rng.random() < 1 / (1 + np.exp(-0.7 * x - a)))
        rows.append((i, y, a, float(kind == 1), float(kind == 2), x, 5.0, 3 * x + 1, float(np.clip(0.3 + 0.1 * kind + 0.05 * rng.random(), 0.01, 0.99))))
    return spark.createDataFrame(rows, "id int, good_bad int, a double, b double, c double, x double, constant double, twice double, t double")


def test_independent_columns(spark):
    df = numbers(spark)
    assert M.independent_columns(df, ["a", "b", "c", "x", "constant", "twice"]) == ["a", "b", "x"]
    assert M.independent_columns(df, ["constant"]) == ["constant"]


def test_score_equations(spark):
    df = VectorAssembler(inputCols=["a", "b", "c", "x"], outputCol="features").transform(numbers(spark)).cache()
    model = M.logistic(reg=0.05, max_iter=200, tol=1e-12).fit(df)
    rows = M.score_equations(model, df).collect()
    assert [r["position"] for r in rows] == [-1, 0, 1, 2, 3]
    assert all(abs(r["gradient"]) < 1e-6 for r in rows)
    # The derivative of the written objective at other coefficients is not zero.
    short = M.logistic(reg=0.05, max_iter=1).fit(df)
    assert max(abs(r["gradient"]) for r in M.score_equations(short, df).collect()) > 1e-3
    assert M.checked(model, 200)[1] and M.checked(short, 1) == (1, False)


def test_a_failed_line_search_raises():
    class Model:
        class summary:
            objectiveHistory, totalIterations = [0.7, 0.6, 0.5], 2

    with pytest.raises(M.FitError):
        M.checked(Model, 50)
    Model.summary.objectiveHistory = [0.7, float("nan")]
    with pytest.raises(M.FitError):
        M.checked(Model, 50)


def test_loss_fits_with_columns_that_sum_to_one(spark):
    """Each group's mean comes out, however many redundant columns are given."""
    df = numbers(spark)
    targets = df.select("id", F.col("t").alias("lgd"), (F.col("t") * 100).alias("ead"))
    columns = ["a", "b", "c", "constant"]
    for model, target, label in ((M.fit_lgd(df.withColumn("good_bad", F.lit(0)), targets, columns), "lgd", None), (M.fit_ead(df, targets, columns), "ead", None)):
        out = model.transform(df).join(targets, "id").groupBy("a", "b").agg(F.avg("prediction").alias("p"), F.avg(target).alias("t")).collect()
        assert all(r["p"] == pytest.approx(r["t"], rel=1e-6) for r in out)


def test_weighted_text_score_equals_copies(spark):
    """Weights do what copies of the rarer class's rows would."""
    rows = [(i, int(i % 5 > 0), Vectors.dense([(i * 37 % 11) / 11, float(i % 5 > 0) + (i * 13 % 7) / 3])) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "good_bad", "v"])
    weighted = W.fit_text_score(df, "v")
    copies = df.union(df.where("good_bad = 0")).union(df.where("good_bad = 0")).union(df.where("good_bad = 0"))
    from pyspark.ml.classification import LogisticRegression
    plain = LogisticRegression(featuresCol="v", labelCol="good_bad", maxIter=100, regParam=0.01).fit(copies)
    assert np.allclose(weighted.coefficients.toArray(), plain.coefficients.toArray(), atol=2e-2)


@pytest.mark.parametrize("name", ["word2vec_vectors", "word2vec_documents", "word2vec_knowledge_base", "extract_by_distance",
                                  "text_risk_score", "text_model_metrics"])
def test_word2vec_queries_clean_texts_once(spark, tmp_path, monkeypatch, name):
    """Word2Vec reads its input twice, then rows are transformed: all from written tokens."""
    from creditloom.queries import queries

    rows = [(i, f"<b>late</b> payment number{i}", "s", "en") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    class Seen(Exception):
        pass

    def fit(df, tokens, **settings):
        raise Seen(df)

    monkeypatch.setattr(W, "fit_word2vec", fit)
    with pytest.raises(Seen) as seen:
        queries()[name](spark, str(tmp_path))
    frame = seen.value.args[0]
    assert "regexp_replace" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r["tokens"][:2]) for r in frame.collect()} == {("late", "payment")}
