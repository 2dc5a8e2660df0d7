"""Hashed TF-IDF, word vectors, title clusters and the text risk score, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    HashingTF, IDF, OneHotEncoder, RegexTokenizer, StopWordsRemover, StringIndexer, Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import profile as E
from creditloom.operators import text as X


def hashed_tfidf(tokens: str, out: str = "tfidf_features", buckets: int = K.TFIDF_BUCKETS,
                 min_doc_freq: int = K.TFIDF_MIN_DOC_FREQ) -> Pipeline:
    tf = HashingTF(inputCol=tokens, outputCol=f"_tf_{out}", numFeatures=buckets)
    return Pipeline(stages=[tf, IDF(inputCol=f"_tf_{out}", outputCol=out, minDocFreq=min_doc_freq)])


def regex_words(text: str, out: str) -> list:
    """Stages: split on non-word characters, then drop the default stop words."""
    return [
        RegexTokenizer(inputCol=text, outputCol=f"_raw_{out}", pattern="\\W"),
        StopWordsRemover(inputCol=f"_raw_{out}", outputCol=out),
    ]


def bucket_dictionary(df: DataFrame, tokens: str, buckets: int = K.TFIDF_BUCKETS) -> DataFrame:
    """``(bucket, token, count)``: most frequent token of each hash bucket.

    The hash is computed by the same stage on one-token arrays, over the
    distinct vocabulary only.
    """
    counts = X.token_counts(df, tokens).withColumn("_one", F.array("token"))
    hashed = HashingTF(inputCol="_one", outputCol="_h", numFeatures=buckets).transform(counts)
    return (
        hashed.select(sparse_parts("_h")["indices"][0].alias("bucket"), "token", "count")
        .groupBy("bucket").agg(F.min(F.struct((-F.col("count")).alias("c"), "token")).alias("b"))
        .select("bucket", F.col("b.token").alias("token"), (-F.col("b.c")).alias("count"))
    )


def sparse_parts(vector: str) -> Column:
    """``indices`` and ``values`` of a sparse vector; the width never matters."""
    parts = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))),
                        "v struct<indices: array<int>, values: array<double>>")
    return parts["v"]


def fit_word2vec(df: DataFrame, tokens: str, out: str = "w2v_features", *, size: int = K.W2V_SIZE,
                 min_count: int = K.W2V_MIN_COUNT, window: int = K.W2V_WINDOW,
                 partitions: int = K.W2V_PARTITIONS, passes: int = K.W2V_PASSES):
    """Skip-gram vectors, trained in ``partitions`` parts whose models are averaged after each of ``passes``.

    Neither follows the size of the data; ``partitions=1`` repeats exactly.
    """
    stage = Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, seed=K.SEED,
                     numPartitions=partitions, maxIter=passes, inputCol=tokens, outputCol=out)
    return stage.fit(df)


def expand_seeds(vectors: DataFrame, seeds: DataFrame, neighbours: int = 5,
                 extra_seeds: Sequence[str] = ()) -> DataFrame:
    """Knowledge base: seed words and their nearest words.

    ``seeds(word, vector)`` are the seeds that have a vector; ``extra_seeds``
    have none and are kept as they are.
    """
    found = X.nearest(vectors, seeds, neighbours).select("word")
    base = found.union(seeds.select("word"))
    if extra_seeds:
        literal = vectors.sparkSession.createDataFrame([(w,) for w in extra_seeds], "word string")
        base = base.union(literal)
    return base.distinct()


def model_vectors(model) -> DataFrame:
    """``(word, vector)`` with the vector as an array."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def knowledge_base(model, seeds: Sequence[str] = tuple(K.RISK_SEEDS), neighbours: int = 5) -> list[str]:
    """Seed words plus their nearest words; a bounded list for the driver."""
    vectors = model_vectors(model)
    known = vectors.where(F.col("word").isin(list(seeds)))
    return sorted(r["word"] for r in expand_seeds(vectors, known, neighbours, seeds).collect())


def vector_mean(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """Mean of a vector column, overall or per class, as an array."""
    mean = Summarizer.mean(F.col(vector)).alias("_m")
    grouped = df.groupBy(by).agg(mean) if by else df.agg(mean)
    keep = [by] if by else []
    return grouped.select(*keep, vector_to_array("_m").alias("mean"))


def one_hot(column: str, out: str, keep_unknown: bool = True) -> Pipeline:
    """Index by frequency, then one-hot; an unseen value gets its own index."""
    invalid = "keep" if keep_unknown else "error"
    return Pipeline(stages=[
        StringIndexer(inputCol=column, outputCol=f"{out}_idx", handleInvalid=invalid),
        OneHotEncoder(inputCol=f"{out}_idx", outputCol=out),
    ])


def title_clusters(column: str, k: int = K.CLUSTERS, buckets: int = K.CLUSTER_BUCKETS,
                   cluster: str = "emp_cluster", out: str = "emp_ohe") -> Pipeline:
    """Words → hashed TF-IDF → k-means → one-hot."""
    from pyspark.ml.clustering import KMeans

    return Pipeline(stages=[
        *regex_words(column, "_title_words"),
        HashingTF(inputCol="_title_words", outputCol="_title_tf", numFeatures=buckets),
        IDF(inputCol="_title_tf", outputCol="_title_tfidf"),
        KMeans(featuresCol="_title_tfidf", predictionCol=cluster, k=k, seed=K.SEED),
        OneHotEncoder(inputCol=cluster, outputCol=out),
    ])


def centre_distances(model: PipelineModel, df: DataFrame, keep: str, cluster: str = "emp_cluster") -> DataFrame:
    """``(keep, cluster, distances)``: squared distances of each row to all centres of a fitted :func:`title_clusters`.

    Centres are few and of fixed width, so they are one row. A distance is the
    centre's own square with the terms of the row's entries that are not zero
    set right: its cost follows the words of a title, not the buckets.
    """
    stage = next(s for s in model.stages if hasattr(s, "clusterCenters"))
    centres = [(float(c @ c), c.tolist()) for c in stage.clusterCenters()]
    table = df.sparkSession.createDataFrame([(centres,)], "centres array<struct<square: double, at: array<double>>>")
    parts = sparse_parts("_title_tfidf")
    rows = model.transform(df).select(
        keep, cluster, F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("v")).alias("_x"))
    apart = F.transform("centres", lambda c: F.aggregate(
        "_x", c["square"], lambda total, x: total + x["v"] * (x["v"] - 2 * c["at"][x["i"]])))
    return rows.crossJoin(F.broadcast(table)).select(keep, cluster, apart.alias("distances"))


def fit_text_score(train: DataFrame, vector: str, label: str = "good_bad", *, max_iter: int = 100, reg: float = 0.01):
    """Logistic regression on word-vector means with balanced class weights.

    A row of the rarer class weighs more in the loss; no row is copied, so an
    uneven table does not grow.
    """
    from pyspark.ml.classification import LogisticRegression

    weights = {r[label]: r["weight"] for r in E.class_weights(train, label).collect()}  # one per class
    weight = F.lit(1.0)
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, F.lit(w)).otherwise(weight)
    fit = LogisticRegression(featuresCol=vector, labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=reg)
    return fit.fit(train.withColumn("_weight", weight))


def text_score(model, df: DataFrame, out: str = "text_score") -> DataFrame:
    """``(id, score)``: probability of class 1 per text."""
    return model.transform(df).select("id", vector_to_array("probability")[1].alias(out))


def attach_score(df: DataFrame, scores: DataFrame, column: str = "text_score", key: str = "id") -> DataFrame:
    """Scores by key; rows without text get 0."""
    return df.join(scores, key, "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
