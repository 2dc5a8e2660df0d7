"""Embedding whitening from a QR factor of the centred rows.

Rows are brought to whole numbers, so that sums and centred rows are exact.
Each task reduces its centred rows to one triangular factor, block by block;
factors are merged in a tree, and the last one, whose size is the number of
dimensions, gives the components (see ``bidiagonal``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.bidiagonal import principal
from creditloom.llm.common import arrow_map
from creditloom.session import cut_lineage

STEP, OFFSET = 64, 1_000_000
# Larger entries count as this, so that sums of whole numbers stay exact.
LARGEST = 1 << 40
COMPONENTS = 32
# Factors that one task merges, and rows of a block at least.
FAN, BLOCK_ROWS = 8, 1024
LONGEST = (1 << 63) - 1


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of usable vectors, and per length the rows that have it with their whole numbers.

    A vector is usable if it and its entries are not null and its entries are finite.
    """
    lengths = np.asarray(column.value_lengths().fill_null(-1), dtype=np.int64)
    flat = column.flatten()
    numbers = np.asarray(flat.fill_null(np.nan), dtype=np.float64) if len(flat) else np.empty(0)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]) if len(lengths) else lengths
    found = []
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        block = numbers[starts[rows][:, None] + np.arange(length)]
        good = np.isfinite(block).all(axis=1)
        x = np.clip(np.floor(STEP * block[good]), -float(LARGEST), float(LARGEST)).astype(np.int64) + OFFSET
        found.append((rows[good], x))
    return lengths, found


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit numbers where they suffice, else Python's."""
    bound = max(int(np.abs(x).max(initial=0)), 1)
    if 2 * n * bound < 1 << 62:
        return n * x - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(c: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where it exceeds a long."""
    largest = float(np.abs(c).max(initial=0))
    if c.dtype != object and largest * largest * c.shape[1] < 2.0**62:
        return (c * c).sum(axis=1).tolist()
    totals = [sum(int(v) * int(v) for v in row) for row in c]
    return [t if t <= LONGEST else None for t in totals]


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the fitted vectors, and the components' directions as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray  # eigenvalues of the covariance, falling
    directions: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def project(self, c: np.ndarray) -> np.ndarray:
        return (c.astype(np.float64) / self.n) @ (self.directions / np.sqrt(self.values))


def _of_width(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    for rows, x in whole_numbers(column)[1]:
        if x.shape[1] == width:
            return rows, x
    return np.empty(0, np.int64), np.empty((0, width), np.int64)


def vector_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number and per-dimension sums of the usable vectors of the greatest length."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0))[1]:
                if len(x):
                    row = np.concatenate([[len(x)], x.sum(axis=0)])
                    totals[x.shape[1]] = totals.get(x.shape[1], 0) + row
        rows = [(length, at, int(v)) for length, row in totals.items() for at, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))],
            names=["length", "at", "total"],
        )

    parts = vectors.mapInArrow(run, "length int, at int, total long")
    sums = cut_lineage(parts.groupBy("length", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "vector-sums")
    # One row per dimension of the longest vectors.
    longest = sums.where(F.col("length") == sums.agg(F.max("length")).scalar()).orderBy("at").collect()
    if not longest:
        return 0, np.empty(0, dtype=object)
    return int(longest[0]["total"]), np.array([int(r["total"]) for r in longest[1:]], dtype=object)


def triangular(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Triangular factor of all centred rows divided by ``n``: of blocks in tasks, then of up to ``FAN`` factors at a time."""
    width = len(sums)
    at_once = max(BLOCK_ROWS, 4 * width)

    def reduce(batches):
        from pyspark import TaskContext

        factor = np.zeros((0, width))
        for batch in batches:
            c = centred(_of_width(batch.column(0), width)[1], n, sums).astype(np.float64) / n
            for start in range(0, len(c), at_once):
                factor = np.linalg.qr(np.vstack([factor, c[start:start + at_once]]), mode="r")
        if len(factor):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())],
                names=["block", "factor"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(f).reshape(-1, width) for f in pdf.sort_values("block")["factor"]]
        factor = np.linalg.qr(np.vstack(rows), mode="r")
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0]) // FAN], "factor": [factor.tobytes()]})

    factors = cut_lineage(vectors.mapInArrow(reduce, "block long, factor binary"), "factors")
    while factors.count() > FAN:
        merged = factors.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(merge, "block long, factor binary")
        factors = cut_lineage(merged, "factors")
    # At most FAN factors of width x width numbers.
    last = [np.frombuffer(r["factor"]).reshape(-1, width) for r in factors.orderBy("block").collect()]
    factor = np.linalg.qr(np.vstack(last), mode="r")
    return np.vstack([factor, np.zeros((width - len(factor), width))])


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable vectors of ``df``; None if there are none.

    Entries ``c`` become ``floor(64 * c) + 1000000``. Vectors that are null,
    hold null or non-finite entries, or are shorter than the longest usable
    one are left out; repeated rows count as often as they occur. Directions
    without variance (of a constant dimension, say) give no component.
    """
    vectors = df.select(F.col(vector_col).cast("array<double>").alias("vector"))
    n, sums = vector_sums(vectors)
    if n == 0:
        return None
    factor = triangular(vectors, n, sums)
    values, directions = principal(factor, components)
    return Whitening(n, sums, values / n, directions, float((factor * factor).sum() / n))


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Replace ``vector_col`` by ``out``, an entry per component, and ``deviation``.

    ``deviation`` is the sum of squares of ``n * x - S``, null where it exceeds
    a long. Rows whose vector the fit left out are dropped; other columns stay,
    ones named as the new columns are replaced.
    """
    kept = df.drop(*({out, deviation} - {vector_col})).withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    place = kept.columns.index(vector_col)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        model = shipped.value
        rows, x = _of_width(batch.column(place), model.width)
        c = centred(x, model.n, model.sums)
        y = model.project(c)
        offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32())
        arrays = pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64()))
        rest = [v.take(pa.array(rows)) for k, v in enumerate(batch.columns) if k != place]
        return [*rest, pa.array(squares(c), pa.int64()), arrays]

    rest = [f for f in kept.schema.fields if f.name != vector_col]
    new = T._parse_datatype_string(f"`{deviation}` long, `{out}` array<double>").fields
    return arrow_map(kept, run, T.StructType([*rest, *new]))


def identity_error(rows: DataFrame, n: int, count: int, column: str = "whitened") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Products are of rows less their mean, which is found first. Sums are taken
    in tasks; the driver gets ``count`` and then ``count ** 2`` numbers.
    """
    def summed(make, size):
        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                y = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, count)
                total += make(y).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

        sums = rows.select(column).mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part"))
        result = np.zeros(size)
        for at, part in sums.collect():
            result[at] = part
        return result / n

    mean = summed(lambda y: y.sum(axis=0), count)
    covariance = summed(lambda y: (y - mean).T @ (y - mean), count * count).reshape(count, count)
    return float(np.abs(covariance - np.eye(count)).max(initial=0.0))


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component; no rows if no vector is usable or none differs from the others."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    model = fit_whitening(rows, "vector", components)
    if model is None or len(model.values) == 0:
        return spark.createDataFrame([], COLUMNS)
    done = cut_lineage(whiten(rows, model, "vector"), "whitened")
    error = identity_error(done, model.n, len(model.values))
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    long = done.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
