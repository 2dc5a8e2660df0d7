"""Credit-shaped views over the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOAN_COLUMNS = [
    "id", "loan_status", "good_bad", "grade", "purpose", "addr_state", "funded_amnt", "dti",
    "open_acc", "int_rate", "total_rec_prncp", "issue_d",
]
_FROM_CUSTOMER = {"purpose", "addr_state", "dti"}
_FROM_LINES = {"open_acc", "int_rate", "total_rec_prncp"}


def loan_book(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per order, seen as a loan. Tables no asked column needs are not joined.

    The mean discount is taken over whole percents: a sum of integers does not
    depend on the order of the rows, so a bin edge is never missed by a last digit.
    """
    wanted = list(columns) or LOAN_COLUMNS
    loans = table(spark, sf_dir, "orders")
    if _FROM_CUSTOMER & set(wanted):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
        loans = loans.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "addr_state" in wanted:
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        loans = loans.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if _FROM_LINES & set(wanted):
        lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_rec"),
            (F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double")
             / F.count(F.lit(1)) / 100).alias("_disc"),
        )
        loans = loans.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    expr = {
        "id": lambda: F.col("o_orderkey"),
        "loan_status": lambda: F.col("o_orderstatus"),
        "good_bad": lambda: F.when(
            (F.col("o_orderstatus") == "F") & (urgent | (F.col("o_totalprice") > 250000)), 0
        ).otherwise(1),
        "grade": lambda: F.col("o_orderpriority"),
        "purpose": lambda: F.when(F.col("o_orderkey") % 13 != 0, F.col("c_mktsegment")),
        "addr_state": lambda: F.col("n_name"),
        "funded_amnt": lambda: F.col("o_totalprice"),
        "dti": lambda: F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")),
        "open_acc": lambda: F.coalesce(F.col("_n"), F.lit(0)),
        "int_rate": lambda: F.col("_disc"),
        "total_rec_prncp": lambda: F.coalesce(F.col("_rec"), F.lit(0.0)),
        "issue_d": lambda: F.col("o_orderdate"),
    }
    return loans.select(*[expr[c]().alias(c) for c in wanted])


def loan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, seen as a loan with a description."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.coalesce("quality", F.lit(1)).alias("good_bad"),
        F.col("text").alias("desc_"),
        F.col("source").alias("title"),
        "lang",
    )


def loan_text_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loan_text`` in which every third loan has no description: for what deals with missing texts."""
    texts = loan_text(spark, sf_dir)
    return texts.withColumn("desc_", F.when(F.col("id") % 3 != 0, F.col("desc_")))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts seen as job titles."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("emp_title"), "p_brand", "p_size"
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings seen as word vectors; the word is ``w<vec_id>``."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        "label",
    )


def scored(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Loans with two deterministic default scores that have many ties."""
    loans = loan_book(spark, sf_dir, "id", "good_bad", "grade", "funded_amnt", *extra)
    urgent = F.col("grade").isin("1-URGENT", "2-HIGH")
    return loans.select(
        "id", "good_bad", "grade", "funded_amnt", *extra,
        (F.floor(F.col("funded_amnt") / 500) / 1000).alias("pd_a"),
        F.when(urgent, 0.4).otherwise(0.2).alias("pd_b"),
    )


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model, id, y, score)`` with ``y = 1`` for a default."""
    wide = scored(spark, sf_dir).select(
        "id", (1 - F.col("good_bad")).alias("y"), F.col("pd_a").alias("a"), F.col("pd_b").alias("b")
    )
    return wide.unpivot(["id", "y"], ["a", "b"], "model", "score")
