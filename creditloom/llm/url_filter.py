"""URL filter: prefix rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map
from creditloom.session import cut_lineage

# (verdict, host, path); a rule's name is host and path.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
# Words in a host's labels that mark a URL as unwanted; where no rule covers it; they fit few tables.
UNWANTED = ("ads", "bets", "casino", "cheap", "pills", "spam")
# The trees are fitted on at most so many labelled URLs, those with the smallest hash.
TRAINING_ROWS = 20_000
TREES, DEPTH = 12, 3
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "hyphens", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "suffix_length", "suffix_log_count", "suffix_unwanted",
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def lexical(urls: DataFrame) -> DataFrame:
    """``key, url, host, path`` and the features that one URL shows by itself."""

    def measure(batch):
        rows = []
        for url, host, path in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
            url = url or ""
            query = url.partition("?")[2].partition("#")[0]
            suffix = host.rpartition(".")[2]
            digits, host_digits = len(re.findall("[0-9]", url)), len(re.findall("[0-9]", host))
            rows.append((
                suffix, float(len(url)), float(len(host)), float(len(path)), float(len([p for p in path.split("/") if p])),
                float(host.count(".") + 1 if host else 0), float(host.count("-")), digits / max(1, len(url)),
                host_digits / max(1, len(host)), entropy(url), entropy(host),
                float(len([p for p in query.split("&") if p])), float(len(suffix)),
            ))
        columns = list(zip(*rows)) if rows else [[]] * 13
        return [*batch.columns[:4], *(list(c) for c in columns)]

    key = urls.schema["key"].dataType.simpleString()
    return arrow_map(
        urls.select("key", "url", "host", "path"), measure,
        f"key {key}, url string, host string, path string, suffix string, " + ", ".join(f"{f} double" for f in FEATURES[:12]),
    )


def train(labelled: DataFrame) -> tuple[GBTClassificationModel, DataFrame]:
    """Trees and suffix table from ``labelled`` (features, ``suffix`` and ``label`` 0/1), at most ``TRAINING_ROWS`` rows of it."""
    sample = cut_lineage(
        labelled.orderBy(F.xxhash64("url", "label"), "url").limit(TRAINING_ROWS), "url-training"
    )
    suffixes = sample.groupBy("suffix").agg(((F.sum("label") + 0.5) / (F.count("label") + 1.0)).alias("suffix_unwanted"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        sample.join(suffixes, "suffix")
    ).select("features", F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3).fit(rows)
    return trees, suffixes


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, score, judged_by``.

    The longest rule that fits decides; other URLs are judged by the trees,
    blocked from a score of 0.5. ``labels`` (``url``, ``label`` 1 for unwanted)
    trains them; without it the rules' verdicts are the labels, and URLs without
    a rule are labelled by ``words`` in their hosts, or not at all if ``words``
    is empty. Suffix counts are taken over all
    rows. A null URL or one without ``://`` has an empty host and path and is
    judged by the trees like any other. ``judged_by`` is ``rule`` or
    ``trees``. If the labels have one class only, or there are none, no trees are
    trained: scores are null, URLs without a rule are allowed and ``judged_by``
    says ``none``. Repeated rows are rows of their own.
    """
    urls = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    table = cut_lineage(lexical(urls), "urls")
    counts = cut_lineage(table.groupBy("suffix").agg(F.log1p(F.count(F.lit(1))).alias("suffix_log_count")), "suffixes")
    table = table.join(counts, "suffix", "left")
    found = longest_rule(F.col("host"), F.col("path"), rules)
    table = table.withColumn("found", found)
    if labels is None:
        by_words = F.arrays_overlap(F.split("host", "[^a-z]+"), F.array(*map(F.lit, words))) if words else F.lit(None)
        by_rule = F.col("found.verdict") == "block"
        labelled = table.where("host <> ''").withColumn("label", F.coalesce(by_rule, by_words).cast("int"))
    else:
        own = labels.select("url", "label").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        known = lexical(own.select(F.col("label").alias("key"), "url", "host", "path"))
        labelled = known.withColumnRenamed("key", "label").join(counts, "suffix", "left").fillna({"suffix_log_count": 0.0})
    labelled = labelled.select("url", "suffix", *FEATURES[:13], "label").where("label IS NOT NULL")
    classes = [r[0] for r in labelled.select("label").distinct().limit(2).collect()]
    if len(classes) < 2:
        scored = table.withColumn("score", F.lit(None).cast("double"))
    else:
        trees, suffixes = train(labelled)
        rows = table.join(cut_lineage(suffixes, "suffix-rates"), "suffix", "left").fillna({"suffix_unwanted": 0.5})
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        from pyspark.ml.functions import vector_to_array

        scored = trees.transform(rows).withColumn("score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("key").alias("id"), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_trees).alias("verdict"), "score",
        F.when(F.col("found").isNotNull(), "rule").when(F.col("score").isNotNull(), "trees").otherwise("none").alias("judged_by"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
