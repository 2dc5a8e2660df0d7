"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes ends in zeros, so equal
passages are cut alike wherever they stand. Each chunk moves once, and equal
chunks are combined before that, to prove that a chunk's digest names one byte
string only. After that a document is its recipe, the ordered list of verified
chunk identifiers, and documents are compared by recipes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map, text_bytes
from creditloom.session import cut_lineage

MIN_CHUNK = 1024
MEAN_BITS = 12  # a cut every 4096 bytes on average beyond the minimum
MAX_CHUNK = 32768
DIGEST_BYTES = 16

_SPACES = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    if not text:
        return text
    words = b" ".join(text.split())
    if not words:
        return b" "
    return (b" " if text[0] in _SPACES else b"") + words + (b" " if text[-1] in _SPACES else b"")


def byte_weights() -> np.ndarray:
    """A random 32-bit number per byte value, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)


def cut_points(text: bytes, weights: np.ndarray) -> list[int]:
    """Ends of the chunks of ``text``; the last is its length."""
    size = len(text)
    if size <= MIN_CHUNK:
        return [size]
    rolling = weights[np.frombuffer(text, dtype=np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        further = rolling.copy()
        further[reach:] += rolling[:-reach] << np.uint32(reach)
        rolling = further
    candidates = np.flatnonzero(rolling >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, start, at = [], 0, 0
    while size - start > MIN_CHUNK:
        at = int(np.searchsorted(candidates, start + MIN_CHUNK))
        end = int(candidates[at]) if at < len(candidates) else size
        start = min(end, start + MAX_CHUNK, size)
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Per document: ``id``, ``text_sha256`` of the normalised text, ``digests`` and ``pieces`` of its chunks."""
    weights = byte_weights()

    def cut(batch):
        shas, digests, pieces = [], [], []
        for raw in text_bytes(batch.column(1)):
            text = normalise(raw)
            shas.append(hashlib.sha256(text).hexdigest())
            start, own = 0, []
            for end in cut_points(text, weights):
                own.append(text[start:end])
                start = end
            pieces.append(own)
            digests.append([xxhash.xxh3_128_digest(p)[:digest_bytes] for p in own])
        return [batch.column(0), shas, digests, pieces]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, cut, "id long, text_sha256 string, digests array<binary>, pieces array<binary>")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after each run of ASCII white space became one
    space; null counts as empty. Of equal texts the smallest id stays, a null id
    only if there is no other; of rows that repeat an id, one stays. Extra
    columns are ignored, an empty table gives an empty result. Should two
    different chunks share a digest, the chunk's bytes become part of its
    identifier, so the answer is exact for any digest.
    """
    table = cut_lineage(
        chunked(docs, id_col, text_col, digest_bytes).withColumn("row", F.monotonically_increasing_id()), "chunks"
    )
    pieces = table.select("row", F.explode(F.arrays_zip("digests", "pieces")).alias("c")).select(
        "row", F.col("c.digests").alias("digest"), F.col("c.pieces").alias("piece")
    )
    # Equal chunks are combined inside each task; what is left names the bytes of a digest.
    clashing = cut_lineage(
        pieces.select("digest", "piece").distinct().groupBy("digest").count().where("count > 1").select("digest"),
        "clashes",
    )
    docs_only = table.select("row", "id", "text_sha256", F.col("digests").alias("recipe"))
    if not clashing.isEmpty():
        places = table.select("row", F.posexplode(F.arrays_zip("digests", "pieces")).alias("at", "c")).select(
            "row", "at", F.col("c.digests").alias("digest"), F.col("c.pieces").alias("piece")
        )
        named = places.join(clashing.withColumn("clash", F.lit(True)), "digest", "left").select(
            "row", "at", F.when(F.col("clash"), F.concat("digest", "piece")).otherwise(F.col("digest")).alias("name")
        )
        recipes = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "name")))["name"].alias("recipe"))
        docs_only = table.select("row", "id", "text_sha256").join(recipes, "row")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    groups = docs_only.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("size"))
    several = groups.where("size > 1").select(
        "recipe", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "size"
    )
    joined = docs_only.join(several, "recipe", "left")
    return joined.select(
        "id",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t"""
