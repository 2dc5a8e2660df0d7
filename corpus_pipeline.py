"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing and token ids.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` read from Parquet, and
returns a DataFrame that is written and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

Rows are followed through a stage by file and place in the file, so rows that
repeat an id, or have none, stay rows of their own. That place does not depend
on how a scan is split, which follows the executors present at the time.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from creditloom.llm import bpe, line_dedup, mixing, ngram_join, quality_rules  # noqa: E402
from creditloom.session import cut_lineage, lookup_join, new_path  # noqa: E402

# Near duplicates share this per cent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# More than a Parquet file has rows: a row key is the file's number times this, plus the row's place.
ROWS_OF_FILE = 1 << 36


def placed(docs: DataFrame) -> DataFrame:
    """The documents with a row key from file and place in it, the same in every scan; ``docs`` is read from Parquet.

    Files are numbered in a written table of one narrow row per file, which is broadcast below
    a limit on its measured bytes and joined by a salted shuffle above it. No row passes through the driver.
    """
    at = docs.metadataColumn("_metadata")
    files = docs.select(at["file_path"].alias("_path")).distinct()
    numbers = cut_lineage(files.select("_path", F.row_number().over(Window.orderBy("_path")).cast("long").alias("_number")), "pipeline-files")
    rows = docs.select(*COLUMNS, at["file_path"].alias("_path"), at["row_index"].alias("_place"))
    return lookup_join(rows, numbers, "_path", how="inner", salt_by="_place").select(
        *COLUMNS, (F.col("_number") * F.lit(ROWS_OF_FILE) + F.col("_place")).alias("_row")
    )


def with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; take boilerplate lines out of the others."""
    rows = placed(docs)
    found = quality_rules.assess(rows, row_col="_row").where("kept").select(F.col("row").alias("_row"), "lines_removed")
    return with_text(rows.join(found, "_row"), line_dedup.without_lines(F.col("text"), F.col("lines_removed")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out; a document of which no word is left goes."""
    rows = placed(docs)
    found = line_dedup.repeated_lines(rows, row_col="_row").select(
        F.col("row").alias("_row"), F.col("repeats.line_no").alias("numbers")
    ).where("numbers IS NOT NULL")
    text = line_dedup.without_lines(F.col("text"), F.col("numbers"))
    joined = rows.join(found, "_row", "left").withColumn("_left", text)
    left = joined.where(F.col("numbers").isNull() | F.col("_left").rlike(mixing.WORD))
    return with_text(left, F.col("_left"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Rows are the operator's documents, so of rows that repeat an id and a text
    one stays. Documents without words are in no group and stay.
    """
    rows = placed(docs)
    found = ngram_join.similar_documents(rows, id_col="_row", words=NEAR_WORDS, percent=NEAR_PERCENT)
    ranked = found.select(F.col("id").alias("_row"), F.col("component_id").alias("_group"))
    ids = rows.select("_row", "doc_id").join(ranked, "_row")
    smallest = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first"))
    return rows.join(smallest.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; a document without words is taken once per whole copy."""
    rows = placed(docs)
    due = mixing.mix(rows, row_col="_row").where("copies > 0").select(F.col("row").alias("_row"), "copies")
    repeated = rows.join(due, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed as little-endian 32-bit integers, and digests of ids and decoded text."""
    model = bpe.default_model()
    return bpe.recode(docs.select(*COLUMNS), model).select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding", token_stage),
]

# Edit distances, a tokenizer's merges and repeated closures have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
