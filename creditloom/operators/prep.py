"""Row preparation: offsets, fills, dummies, id sets and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import names as N
from creditloom.functions import scalars as S


def with_first_integer(df: DataFrame, source: str, target: str,
                       overrides: Mapping[str, int] | None = None) -> DataFrame:
    return df.withColumn(target, S.first_integer(source, overrides))


def month_cap(df: DataFrame, date: Column, reference: str) -> Column:
    """Largest non-negative offset in ``df`` as a scalar subquery.

    A plain aggregate with map-side maxima; no window puts the table in one task.
    """
    offset = S.months_since(date, reference)
    return df.agg(F.max(F.when(offset >= 0, offset))).scalar()


def with_months_since(df: DataFrame, source: str, target: str, *,
                      reference: str = K.REFERENCE_DATE, fmt: str | None = K.MONTH_FORMAT,
                      fit_on: DataFrame | None = None) -> DataFrame:
    """Month offsets; a negative one becomes the largest offset of ``fit_on``.

    ``fit_on`` is the training frame; without it the frame's own maximum is
    used. ``fmt=None`` means the column already is a date.
    """
    date = S.parse_date(source, fmt) if fmt else F.col(source).cast("date")
    cap = month_cap(df if fit_on is None else fit_on, date, reference)
    offset = S.months_since(date, reference)
    return df.withColumn(target, F.when(offset < 0, cap).otherwise(offset))


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULLs per column; columns that do not exist are passed over."""
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.fillna(present) if present else df


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_values(df, {c: 0 for c in columns})


def fill_from(df: DataFrame, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.coalesce(F.col(target), F.col(source)))


def fill_by_type(df: DataFrame, number: float, text: str, skip: Sequence[str] = ()) -> DataFrame:
    """Numbers get ``number``, everything else ``text``."""
    numbers, others = split_columns(df, skip)
    return df.fillna(number, subset=numbers).fillna(text, subset=others)


def split_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and other columns, in schema order."""
    from pyspark.sql.types import NumericType

    fields = [f for f in df.schema.fields if f.name not in set(exclude)]
    return (
        [f.name for f in fields if isinstance(f.dataType, NumericType)],
        [f.name for f in fields if not isinstance(f.dataType, NumericType)],
    )


def integer_columns(df: DataFrame, exclude: Sequence[str] = K.NOT_FEATURES) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "int" and name not in set(exclude)]


def drop_matching(df: DataFrame, suffixes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    gone = [c for c in df.columns if c.endswith(tuple(suffixes)) or c in set(names)]
    return df.drop(*gone)


def fit_dummies(df: DataFrame, columns: Sequence[str], max_categories: int = 60) -> DataFrame:
    """``(column, value, count, rank)``: most frequent values of many columns.

    All columns share one aggregate; the ranking window sees one row per
    distinct value and Spark prunes each task to its own top rows first.
    """
    present = [c for c in columns if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in present]).unpivot(
        [], present, "column", "value"
    )
    counts = (
        long.where("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_categories)


def dummy_spec(fitted: DataFrame) -> dict[str, list[str]]:
    """Fitted dummies as a dict; at most ``max_categories`` rows per column."""
    spec: dict[str, list[str]] = {}
    for row in fitted.orderBy("column", "rank").collect():
        spec.setdefault(row["column"], []).append(row["value"])
    return spec


def with_dummies(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns ``column:value`` in one projection."""
    pairs = [(c, v) for c, values in spec.items() if c in df.columns for v in values]
    titles = N.unique_names([f"{c}:{N.plain_name(v)}" for c, v in pairs])
    flags = [
        F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).alias(t)
        for (c, v), t in zip(pairs, titles)
    ]
    return df.select("*", *flags)


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``; duplicates in ``ids`` do no harm."""
    return df.join(ids.select(key), on=key, how="left_semi")


def id_union(*frames: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys over several frames."""
    ids = frames[0].select(key)
    for frame in frames[1:]:
        ids = ids.union(frame.select(key))
    return ids.distinct()


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that one side lacks is NULL there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def check_same_columns(train: DataFrame, test: DataFrame) -> None:
    odd = set(train.columns) ^ set(test.columns)
    if odd:
        raise ValueError(f"train and test differ in columns: {sorted(odd)}")


def random_split(df: DataFrame, train: float = 0.8, seed: int = K.SEED) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([train, 1 - train], seed=seed)
    return first, second


def stable_split(df: DataFrame, key: str = "id", train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key.

    The side of a row depends on its key only: not on partitions, file order or
    a retried task. Text keys are hashed first.
    """
    from pyspark.sql.types import StringType

    hashed = F.crc32(F.col(key)) if isinstance(df.schema[key].dataType, StringType) else F.col(key)
    bucket = S.bucket_of_id(hashed)
    limit = round(train * 1000)
    return df.where(bucket < limit), df.where(bucket >= limit)
