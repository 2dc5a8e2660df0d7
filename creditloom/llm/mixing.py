"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due ``target / source size`` copies. The whole
part of that is certain. What is left of the target is drawn with inclusion
probabilities in proportion to size: ``min(1, rate * size)``, where the rate
makes the expected words equal to what is left. Documents whose probability
reaches 1 are certain and go first; the others are ranked by random odds divided by
inclusion odds, and the ranking is taken until the words that are left are reached.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import ranked_prefix
from creditloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and seed only: 48 bits of an MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(2.0**48)


def source_targets(sizes: DataFrame, weight: Column, most_copies: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: shares of all words by weight, limited to ``most_copies`` times a source.

    Where a limit binds, the excess goes to the others by weight until none is
    above its limit: targets are ``min(limit, level * weight)``. Sources are put
    in order of ``limit / weight``; the level follows from the sums before the
    first source that stays below. ``sizes`` has one row per source.
    """
    # One row per source: the ordered sums below run over sources, not documents.
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy("_at", F.col("source").asc_nulls_last())
    behind = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight).withColumn("_limit", F.lit(most_copies) * F.col("source_size"))
    rows = rows.withColumn("_at", F.col("_limit") / F.col("weight"))
    rows = rows.select(
        "*", F.sum("source_size").over(everything).alias("_all"), F.sum("weight").over(everything).alias("_weights"),
        F.row_number().over(by_limit).alias("_order"), F.coalesce(F.sum("_limit").over(behind), F.lit(0)).alias("_full"),
        F.coalesce(F.sum("weight").over(behind), F.lit(0)).alias("_used"),
    )
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_full")).cast("double") / (F.col("_weights") - F.col("_used")))
    # The level is that of the first source that it leaves below its limit.
    level = F.min(F.when(F.col("_at") >= F.col("_level"), F.struct("_order", "_level"))).over(everything)["_level"]
    limit = F.col("_limit").cast("double")
    target = F.coalesce(F.least(limit, F.col("weight") * level), limit)
    return rows.select("source", "source_size", target.alias("target"))


def inclusion_rates(sizes: DataFrame, room: DataFrame) -> DataFrame:
    """``source, rate``: the rate at which the sum of ``size * min(1, rate * size)`` over a source is its ``room``.

    ``sizes`` has ``source, size, n``: documents by size above 0, one row each.
    Sizes are taken from the largest down; those before the first size that the rate
    leaves at a probability of at most 1 are certain. The sums run over
    different sizes, of which there are no more than the longest document has words.
    ``room`` has ``source, room``; each room is less than the sum of the source's sizes.
    """
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sums of squares pass the range of a long at scale.
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") * F.col("n")
    rows = sizes.select(
        "source", "size", F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0)).alias("certain"),
        F.sum(square.cast("decimal(38,0)")).over(rest).cast("double").alias("squares"),
    )
    rows = rows.join(room.select(F.col("source").alias("_source"), "room"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("rate", (F.col("room") - F.col("certain")) / F.col("squares")).where(F.col("rate") * F.col("size") <= 1)
    return rows.groupBy("source").agg(F.max(F.struct("size", "rate")).alias("first")).select("source", F.col("first.rate").alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 17, most_copies: int = MOST_COPIES, row_col: str | None = None) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, probability, copies, taken``.

    A document's size is its number of words (null text: 0). Sources ordered by
    code point, null last, weigh 1, 2, 3, repeating. ``copies`` is how often
    the mix takes the document, at most ``most_copies``, and ``taken`` is
    ``copies * size``. ``probability`` is that of one copy besides the whole ones;
    a document without words has none. The draw depends on id and seed only, so reruns agree;
    documents that tie are taken by id, then size. Rows that repeat an id are
    documents of their own; ``row_col`` carries a caller's row key through as
    ``row``. An empty table gives an empty result; if no source has a word, all
    targets are 0.
    """
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *([F.col(row_col).alias("row")] if row_col else []),
        ),
        "mix-sizes",
    )
    by_size = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-by-size")
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    targets = source_targets(sizes.withColumn("_place", place), F.pmod(F.col("_place") - 1, F.lit(3)) + 1, most_copies)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = cut_lineage(
        targets.withColumn("whole", F.floor(due)).withColumn("part", due - F.col("whole"))
        .withColumn("room", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    drawn = targets.where("part > 0")
    rates = inclusion_rates(by_size.where("size > 0"), drawn).withColumnRenamed("source", "_rated")
    targets = targets.join(rates, F.col("source").eqNullSafe(F.col("_rated")), "left")
    placed = rows.join(
        targets.select(F.col("source").alias("_source"), "source_size", "target", "whole", F.coalesce("rate", F.lit(0.0)).alias("rate")),
        F.col("source").eqNullSafe(F.col("_source")), "left",
    ).drop("_source").withColumn("probability", F.least(F.lit(1.0), F.col("rate") * F.col("size")))
    draw = uniform(F.col("id"), seed)
    # Random odds over inclusion odds, mapped to (0, 1) in the same order; certain documents first.
    odds = (draw / (1 - draw)) / (F.col("probability") / (1 - F.col("probability")))
    rank = F.when(F.col("probability") >= 1, F.lit(0.0)).when(F.col("probability") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    placed = placed.withColumn("rank", rank)
    chosen = ranked_prefix(
        placed, "source", F.col("rank"), [F.col("rank"), F.col("id").asc_nulls_last(), F.col("size")], "size",
        drawn.select(F.col("source").alias("_room_group"), "room"),
    )
    copies = F.col("whole") + F.when(F.col("chosen") & (F.col("probability") > 0), 1).otherwise(0)
    return chosen.select(
        "id", "source", "size", "source_size", "target", "probability", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if row_col else []),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM g),
a AS (SELECT *, 3 * source_size AS lim, (3 * source_size)::DOUBLE / weight AS at_ FROM w),
b AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(lim) OVER p, 0) AS full_, coalesce(sum(weight) OVER p, 0) AS used
  FROM a WINDOW p AS (ORDER BY at_, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - full_)::DOUBLE / (weights - used)::DOUBLE AS level_ FROM b),
l AS (SELECT level_ AS lv FROM c WHERE at_ >= level_ ORDER BY at_, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(lim::DOUBLE, weight * (SELECT lv FROM l)), lim::DOUBLE) AS target FROM c),
f AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM t),
z AS (SELECT f.source, s.size, count(*) AS n, any_value(f.target - f.whole * f.source_size) AS room
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source WHERE s.size > 0 AND f.due - f.whole > 0 GROUP BY f.source, s.size),
y AS (SELECT source, size, (room - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(size::HUGEINT * size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS rate
  FROM z),
x AS (SELECT source, max_by(rate, size) AS rate FROM y WHERE rate * size <= 1 GROUP BY source),
u AS (SELECT s.doc_id, s.source, s.size, f.source_size, f.target, f.whole,
    least(1.0::DOUBLE, coalesce(x.rate, 0) * s.size) AS p, f.target - f.whole * f.source_size AS room,
    ((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS draw
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source LEFT JOIN x ON s.source IS NOT DISTINCT FROM x.source),
o AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (draw / (1 - draw)) / (p / (1 - p)) END AS odds FROM u),
r AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN odds / (1 + odds) ELSE 1.0 END AS rank_ FROM o),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank_, doc_id NULLS LAST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r)
SELECT doc_id, source, size, source_size, target,
  (size * (whole + CASE WHEN p > 0 AND 2 * cum - size <= 2 * room THEN 1 ELSE 0 END))::BIGINT AS taken FROM k"""
