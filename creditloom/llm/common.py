"""Shared pieces of the corpus operators: Arrow maps, components, ranked prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from creditloom.session import cut_lineage

Rows = Callable[[pa.RecordBatch], list]

# A key table of one long per row is broadcast up to here: 8 MB of keys.
BROADCAST_KEYS = 1_000_000
# Rows that a Python worker turns into objects at a time.
ROWS_AT_ONCE = 1_000


def arrow_map(df: DataFrame, function: Rows, schema: str | T.StructType) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it gives the columns of ``schema`` as lists or arrays.

    One batch is in memory at a time, which Spark bounds by rows and bytes
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``);
    ``function`` gets ``ROWS_AT_ONCE`` rows of it at most.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.fieldNames()
    kinds = [_arrow_kind(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                columns = [
                    c if isinstance(c, pa.Array) else pa.array(c, kind)
                    for c, kind in zip(function(batch), kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, out)


def arrow_sums(df: DataFrame, add: Callable[[pa.RecordBatch, list[np.ndarray]], None], size: int, count: int) -> list[np.ndarray]:
    """``count`` arrays of ``size`` integers, filled by ``add`` over all batches of a task and summed over all tasks.

    Tasks give up to ``size`` rows each, which are summed in Spark; the driver gets ``size`` rows.
    """
    names = [f"sum_{k}" for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(size, np.int64) for _ in range(count)]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                add(whole.slice(start, ROWS_AT_ONCE), totals)
        some = np.flatnonzero(np.any(totals, axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in totals)], names=["place", *names]
        )

    rows = df.mapInArrow(run, "place int, " + ", ".join(f"{n} long" for n in names))
    result = [np.zeros(size, np.int64) for _ in range(count)]
    for place, *values in rows.groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).collect():
        for array, value in zip(result, values, strict=True):
            array[place] = value
    return result


def _arrow_kind(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def semi_join_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (null matches null).

    ``keys`` has one long column. At most ``BROADCAST_KEYS`` rows of it, counted
    here, are broadcast; more are joined by a shuffle. The rows are the same.
    """
    wanted = keys.select(F.col(on).alias("_wanted"))
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, F.col(on).eqNullSafe(F.col("_wanted")), "left_semi")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(node, label)`` per linked node.

    ``label`` is the smallest node of the component. Each round takes the
    smallest label among neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of a component's diameter. Each
    round is written to the shared folder, so lost executors cost no earlier
    round. A hub's neighbours meet in a minimum with map-side combine only.
    """
    both = cut_lineage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where(F.col("a") != F.col("b")).distinct(),
        f"{name}-links",
    )
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")),
        f"{name}-0",
    )
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stepped.join(jump, "label", "left").select(
            "node", F.coalesce(F.least("label", "further"), "label").alias("label"), "before"
        )
        moved = cut_lineage(moved, f"{name}-{turn}")
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("before")).isEmpty():
            return labels


# Equal parts of (0, 1) over which ranked sizes are first summed.
RANK_PARTS = 65_536


def ranked_prefix(df: DataFrame, group: str, place: Column, order: list[Column], size: str, room: DataFrame) -> DataFrame:
    """Flag the rows that fill ``room`` when each group is taken in ``order``.

    ``place`` maps a row into [0, 1) without changing ``order``: sizes are first
    summed over ``RANK_PARTS`` parts of it (combined before the shuffle), which
    shows the one part of each group in which the room ends. Only rows of that
    part are put in order, so a group with a third of all rows is never sorted in
    one task. ``room`` has ``(group, room)``. A row is chosen while the middle of
    its span lies within the room: the total misses it by half a row at most.
    """
    part = F.least(F.lit(RANK_PARTS - 1), F.floor(place * RANK_PARTS)).cast("int")
    rows = df.withColumn("_part", part)
    sums = rows.groupBy(group, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(room, F.col(group).eqNullSafe(F.col("_room_group")))
        .where((F.col("_before") <= F.col("room")) & (F.col("_before") + F.col("_sum") >= F.col("room")))
        .groupBy(group).agg(F.min(F.struct("_part", "_before", "room")).alias("_end"))
        .select(F.col(group).alias("_end_group"), "_end.*")
        .withColumnRenamed("_part", "_end_part").withColumnRenamed("room", "_end_room")
    )
    # One row per group; Spark broadcasts it below its own size threshold.
    rows = rows.join(ends, F.col(group).eqNullSafe(F.col("_end_group")), "left")
    inside = rows.where(F.col("_part") == F.col("_end_part"))
    running = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_cum", F.col("_before") + F.sum(size).over(running)).withColumn(
        "chosen", 2 * F.col("_cum") - F.col(size) <= 2 * F.col("_end_room")
    )
    outside = rows.where(F.col("_end_part").isNull() | (F.col("_part") != F.col("_end_part"))).withColumn(
        "chosen", F.coalesce(F.col("_part") < F.col("_end_part"), F.lit(False))
    )
    keep = [*df.columns, "chosen"]
    return inside.select(*keep).union(outside.select(*keep))
