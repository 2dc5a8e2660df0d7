"""Quality rules: counts of one text, and lines that many documents of a host share.

Normalised lines are hashed, the distinct documents of a host that hold each are
counted, lines above the limits are removed, and documents left with too few
of their words are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_map, text_bytes
from creditloom.llm.words import WordNumbers, ngrams
from creditloom.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW_WORDS = 5

# A line is boilerplate of its host in more documents than both limits.
LINE_DOCS = 20
LINE_SHARE = 0.005
# A document that keeps less than this share of its words is depleted.
KEPT_SHARE = 0.5


def repeated_words(numbers: np.ndarray, window: int = WINDOW_WORDS) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    grams = ngrams(numbers, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(numbers) + 1, dtype=np.int64)
    edges[:-window][twice] += 1
    edges[window:][twice] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per document: the counts of its text, and hash and words of each of its lines."""

    store = WordNumbers()  # empty here; each task fills its own copy

    def measure(batch):
        counts = [[] for _ in range(5)]
        hashes, words_of = [], []
        for text in text_bytes(batch.column(2)):
            words, seen, repeats, own_hashes, own_words = [], set(), 0, [], []
            for line in text.split(b"\n"):
                own = line.split()
                if own:
                    repeats += line in seen
                    seen.add(line)
                words += own
                own_words.append(len(own))
                own_hashes.append(xxhash.xxh3_64_intdigest(b" ".join(own).lower()) if own else 0)
            joined = b"".join(words)
            # Code points start with any byte but 10xxxxxx.
            chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
            for column, value in zip(
                counts,
                (len(words), chars, sum(text.count(c) for c in SYMBOLS), repeats, repeated_words(store.of(words))),
                strict=True,
            ):
                column.append(value)
            hashes.append(own_hashes)
            words_of.append(own_words)
        flat = np.array([h for own in hashes for h in own], dtype=np.uint64).view(np.int64)
        ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
        return [
            batch.column(0), batch.column(1), *counts,
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), words_of,
        ]

    source = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(
        source, measure,
        f"id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " line_hashes array<long>, line_words array<int>",
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, row_col: str | None = None) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``lines_removed`` (positions), ``words_left``, ``kept``.

    ``base_failed``: under 10 words, or over 20% of the words in 5-word windows
    that repeat. A line (lower case, white space collapsed; lines without a word
    aside) that over ``LINE_DOCS`` documents and over ``LINE_SHARE`` of all
    documents of the host hold is removed; ``kept`` needs at least
    ``KEPT_SHARE`` of the words left. A null text has no words and fails; null
    hosts are one host. Rows that repeat an id are documents of their own;
    ``row_col`` carries a caller's row key through. An empty table gives an
    empty result.
    """
    if row_col:
        docs = docs.withColumn("_both", F.struct(F.col(id_col).alias("id"), F.col(row_col).alias("row")))
        id_col = "_both"
    table = cut_lineage(
        measured(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id()), "quality"
    )
    lines = table.select(
        "_row", "host", F.posexplode(F.arrays_zip("line_hashes", "line_words")).alias("at", "line")
    ).select("_row", "host", "at", F.col("line.line_hashes").alias("hash"), F.col("line.line_words").alias("words")).where("words > 0")
    spread = table.select("host", F.explode(F.array_distinct("line_hashes")).alias("hash"))
    often = spread.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > LINE_DOCS)
    hosts = table.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "_host")
    # At most mean lines per document / LINE_SHARE rows for each host.
    above = cut_lineage(
        often.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("docs") > F.col("host_docs") * F.lit(LINE_SHARE))
        .select(F.col("_host"), F.col("hash").alias("_hash")),
        "quality-lines",
    )
    removed = (
        lines.join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("hash") == F.col("_hash")))
        .groupBy("_row").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("at")).alias("lines_removed"))
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    result = table.drop("line_hashes", "line_words").join(removed, "_row", "left").select(
        "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("lines_removed", F.array().cast("array<int>")).alias("lines_removed"),
        left.alias("words_left"), (~failed & (left >= F.lit(KEPT_SHARE) * F.col("n_words"))).alias("kept"),
    )
    if row_col:
        result = result.select(F.col("id.row").alias("row"), F.col("id.id").alias("id"), *result.columns[1:])
    return result


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "words_left", "kept",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT r, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars FROM w),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, ws[i:i+4] AS gram FROM g),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM h),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, range(0, 5) AS o(k) WHERE times > 1 GROUP BY r),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d),
x AS (SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
      lambda v: translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS norm FROM l),
y AS (SELECT * FROM x WHERE words > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM y GROUP BY r),
hosts AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
often AS (SELECT source, norm, count(DISTINCT r) AS docs FROM y GROUP BY source, norm),
above AS (SELECT o.source, o.norm FROM often o JOIN hosts c ON o.source IS NOT DISTINCT FROM c.source
  WHERE o.docs > 20 AND o.docs > c.host_docs * 0.005::DOUBLE),
gone AS (SELECT r, sum(words) AS gone FROM y JOIN above a ON y.source IS NOT DISTINCT FROM a.source AND y.norm = a.norm GROUP BY r),
j AS (SELECT d.doc_id, n.n_words, n.word_chars,
    len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
    coalesce(p.n_repeat_words, 0) AS n_repeat_words, n.n_words - coalesce(gone.gone, 0) AS words_left
  FROM d JOIN n USING (r) LEFT JOIN p USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, words_left::BIGINT AS words_left,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 0.5::DOUBLE * n_words AS kept FROM j"""
