"""Running totals and exact quantiles over data of any size.

A global window would sort everything in one task. Here the distinct values
are first counted (map-side combine removes repeats), then cut into value
ranges; a window runs inside each range and a small table of range totals
supplies the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.session import cut_lineage

MAX_RANGES = 4000


def range_edges(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Interior edges that cut the values into about equal shares.

    One sketch pass over one column. The edges reach the driver once, so every
    later evaluation of the plan uses the same ranges; their number is bounded.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(ranges, MAX_RANGES))
    points = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(value, points, 0.25 / ranges)))


def with_range(df: DataFrame, value: str, edges: Sequence[float], name: str = "_range") -> DataFrame:
    """Adds the value's range number, found by binary search in the JVM."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol=value,
                     outputCol=name, handleInvalid="keep")
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    *,
    keys: Sequence[str] = (),
    descending: bool = True,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Adds ``cum_<s>`` (inclusive) and ``total_<s>`` for each column in ``sums``.

    ``counts`` has one row per ``keys`` and ``value``. No task holds more than
    one value range of one key, and no row is dropped.
    """
    if edges is None:
        edges = range_edges(counts, value)
    keys = list(keys)
    ranged = with_range(counts, value, edges)
    offsets = _offsets(ranged, keys, sums, descending)
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = ranged.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    # At most (number of edges + 2) rows per key: safe to broadcast.
    joined = summed.join(F.broadcast(offsets), [*keys, "_range"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def _offsets(ranged: DataFrame, keys: list[str], sums: Sequence[str], descending: bool) -> DataFrame:
    """Totals before each range and overall: a few thousand rows per key at most."""
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_n_{s}") for s in sums])
    per_key: list[Column | str] = keys or [F.lit(1)]
    whole = Window.partitionBy(*per_key)
    before = whole.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.select(
        *keys, "_range",
        *[F.col(f"_n_{s}") for s in sums],
        *[F.coalesce(F.sum(f"_n_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_n_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )


def numbered(df: DataFrame, order: Sequence[str], *, keys: Sequence[str] = (), name: str = "at", previous: Sequence[str] = ()) -> DataFrame:
    """Adds each row's place (from 0) among the rows of its ``keys`` in ascending ``order``.

    Rows are dealt over tasks by range and written with their place in the
    task; one row per task supplies the offsets, so no task holds all rows of a key. ``previous``
    columns of the row before, within the keys, are added as ``previous_<column>``.
    ``keys`` name few groups, such as features.
    """
    columns = [*keys, *order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    placed = cut_lineage(placed, "numbered")
    ends = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by(F.struct(*keys, *previous), "_row").alias("_end"))
    by_part = Window.orderBy("_part")
    offsets = ends.select(
        "_part", F.coalesce(F.sum("_rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_end").over(by_part).alias("_end"))
    # One row per task.
    rows = placed.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_row"))
    if previous:
        inside = Window.partitionBy("_part").orderBy("_row")
        last = F.coalesce(F.lag(F.struct(*keys, *previous)).over(inside), F.col("_end"))
        same = F.lit(True)
        rows = rows.withColumn("_last", last)
        for key in keys:
            same = same & F.col(f"_last.{key}").eqNullSafe(F.col(key))
        rows = rows.select("*", *[F.when(same, F.col(f"_last.{c}")).alias(f"previous_{c}") for c in previous])
    if keys:
        first = rows.groupBy(*keys).agg(F.min("_at").alias("_first"))
        same_keys = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        first = first.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_first")
        rows = rows.join(F.broadcast(first), same_keys).withColumn("_at", F.col("_at") - F.col("_first"))
    return rows.select(*df.columns, *[f"previous_{c}" for c in previous], F.col("_at").alias(name))


def exact_quantiles(
    df: DataFrame,
    value: str,
    points: Sequence[float],
    *,
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """``(keys…, q, value)``: linearly interpolated quantiles, exact at any size.

    The data is read once, for a written table of rows (or their ``weight``) per
    distinct value. Its counts per value range (a few thousand numbers per key,
    summed in the tasks and brought to the driver) tell which ranges hold the
    wanted ranks, and only those ranges are ordered. NULL and NaN are left out.
    ``keys`` name few groups, such as features or models.
    """
    keys = list(keys)
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = cut_lineage(clean.groupBy(*keys, value).agg(rows.cast("long").alias("_c")), "value-counts")
    ranged = with_range(counts, value, range_edges(counts, value))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("n")).collect()
    per_key: dict[tuple, list[tuple[int, int]]] = {}
    for row in totals:
        per_key.setdefault(tuple(row[k] for k in keys), []).append((row["_range"], row["n"]))
    wanted = [
        (*key, *place) for key, sizes in per_key.items() for place in _rank_places(sorted(sizes), points)
    ]
    schema = StructType([
        *[counts.schema[k] for k in keys],
        *StructType.fromDDL("_range int, q double, _share double, _rank long").fields,
    ])
    # At most two ranks per point and key: safe to broadcast.
    places = df.sparkSession.createDataFrame(wanted, schema)
    needed = F.broadcast(places.select(*keys, "_range").distinct())
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    walked = ranged.join(needed, [*keys, "_range"], "left_semi").withColumn("_upto", F.sum("_c").over(inside))
    hits = walked.join(F.broadcast(places), [*keys, "_range"]).where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
    )
    low, high = F.min(value), F.max(value)
    return hits.groupBy(*keys, "q").agg((low + (high - low) * F.max("_share")).alias("value"))


def _rank_places(sizes: list[tuple[int, int]], points: Sequence[float]) -> list[tuple]:
    """For each point: range, point, interpolation share and rank inside the range."""
    total = sum(n for _, n in sizes)
    places = []
    for q in points:
        position = q * (total - 1)
        for rank in {math.floor(position), math.ceil(position)}:
            before = 0
            for number, n in sizes:
                if rank < before + n:
                    places.append((number, float(q), position - math.floor(position), rank - before))
                    break
                before += n
    return places
