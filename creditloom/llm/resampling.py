"""Quality classifier by importance resampling.

Two generative models count hashed words and word pairs, one over target texts
and one over all texts. A document's log weight is the log ratio of their
likelihoods; Gumbel noise and a top-k draw resample documents by weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map, arrow_sums, ranked_prefix, text_bytes
from creditloom.llm.mixing import uniform
from creditloom.llm.words import WordNumbers, ngrams
from creditloom.session import cut_lineage

BUCKETS = 16_384
# The target model is fitted on at most so many labelled documents, those with the smallest hash.
TARGET_ROWS = 20_000


def features(text: bytes, store: WordNumbers) -> np.ndarray:
    """Buckets of the words and word pairs of a text, lower case."""
    numbers = store.of(text.lower().split())
    both = np.concatenate([ngrams(numbers, 1), ngrams(numbers, 2)])
    return (both % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all texts and of the target's."""
    wanted = docs.sparkSession.sparkContext.broadcast(target_ids)
    store = WordNumbers()  # empty here; each task fills its own copy

    def add(batch, totals):
        chosen = np.isin(pc.fill_null(batch.column(0), -(2**63)).to_numpy(zero_copy_only=False), wanted.value)
        for text, is_target in zip(text_bytes(batch.column(1)), chosen, strict=True):
            own = np.bincount(features(text, store), minlength=BUCKETS)
            totals[0] += own
            if is_target:
                totals[1] += own

    raw, target = arrow_sums(docs, add, BUCKETS, 2)
    return raw, target


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``id, n_features, log_weight`` of each document."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)
    store = WordNumbers()

    def score(batch):
        ratio = shipped.value
        found = [features(t, store) for t in text_bytes(batch.column(1))]
        return [batch.column(0), [len(f) for f in found], [float(ratio[f].sum()) for f in found]]

    return arrow_map(docs, score, "id long, n_features long, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, share: float | None = None, seed: int = 29) -> DataFrame:
    """One row per document: ``id, n_features, log_weight, score, kept``.

    ``labels`` has ``id`` and ``good`` (1: target). ``share`` of the documents
    are kept, by default the share of good ones among the labels: those with the
    largest log weight plus Gumbel noise. Noise depends on id and seed only.
    Null or empty texts have no features and weight 0; a null id is never a
    target. Rows that repeat an id are documents of their own; ties go by id.
    Without labels all weights are 0 and, unless ``share`` is given, all rows stay.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    good = labels.where("good = 1 AND id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct()
    chosen = good.orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    target_ids = np.array([r[0] for r in chosen.collect()], dtype=np.int64)  # TARGET_ROWS at most
    raw, target = bucket_counts(source, target_ids)
    p_target = (target + 1.0) / (target.sum() + BUCKETS)
    p_raw = (raw + 1.0) / (raw.sum() + BUCKETS)
    ratios = np.log(p_target) - np.log(p_raw) if target.sum() else np.zeros(BUCKETS)
    if share is None:
        share = labels.agg(F.avg(F.col("good").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    weights = log_weights(source, ratios)
    noise = -F.log(-F.log(uniform(F.col("id"), seed)))
    scored = cut_lineage(weights.withColumn("score", F.col("log_weight") + noise), "weights")
    scored = scored.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    room = scored.groupBy(F.col("_all").alias("_room_group")).agg(
        F.round(F.count(F.lit(1)) * F.lit(float(share))).alias("room")
    )
    score: Column = F.col("score")
    place = 0.5 - 0.5 * score / (1.0 + F.abs(score))
    flagged = ranked_prefix(scored, "_all", place, [score.desc(), F.col("id").asc_nulls_last()], "_one", room)
    return flagged.select("id", "n_features", "log_weight", "score", F.col("chosen").alias("kept"))


def op10_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return resample(docs, labels).withColumnRenamed("id", "doc_id")
