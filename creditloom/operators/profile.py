"""Profiles, missing-value reports, group rates and imputers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import scalars as S
from creditloom.operators.prefix import exact_quantiles

PROFILE_POINTS = (0.01, 0.25, 0.5, 0.75, 0.99)


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group, largest first; equal counts by group value."""
    return (
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), *[F.asc_nulls_first(c) for c in by])
    )


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, column, value)`` with every column as double, NULLs left out."""
    wide = df.select(*keep, *[S.numeric(df, c).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column", "value").where("value IS NOT NULL")


def column_profile(
    df: DataFrame,
    columns: Sequence[str],
    points: Sequence[float] = PROFILE_POINTS,
    *,
    exact: bool = False,
) -> DataFrame:
    """Count, mean, median, min, max and quantiles of many columns in one pass.

    Approximate quantiles come from mergeable sketches. ``exact`` gives
    interpolated ones by a distributed rank search, never by collecting a
    column's values in one task.
    """
    values = long_values(df, columns)
    basics = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if not exact:
        q = F.percentile_approx("value", F.array(*[F.lit(p) for p in points]), 10000)
        return (
            values.groupBy("column").agg(*basics, q.alias("_q"))
            .select("column", "count", "mean", "min", "max",
                    *[F.col("_q")[i].alias(quantile_name(p)) for i, p in enumerate(points)])
        )
    quantiles = (
        exact_quantiles(values, "value", points, keys=("column",))
        .groupBy("column").pivot("q", list(points)).agg(F.first("value"))
    )
    named = quantiles.select("column", *[F.col(f"`{p}`").alias(quantile_name(p)) for p in points])
    return values.groupBy("column").agg(*basics).join(named, "column", "left")


def quantile_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def missing_summary(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_ratio)`` of the columns with NULLs, worst first."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    return (
        counts.unpivot(["_rows"], list(df.columns), "column", "missing_count")
        .where("missing_count > 0")
        .select("column", "missing_count",
                (F.col("missing_count") / F.col("_rows")).alias("missing_ratio"))
        .orderBy(F.desc("missing_count"), "column")
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the NULL count of each listed column that exists."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns if c in df.columns])


def blank_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, missing, total, missing_rate)`` of text columns, NULL or empty."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns],
    )
    return counts.unpivot(["total"], list(columns), "column", "missing").select(
        "column", "missing", "total", (F.col("missing") / F.col("total")).alias("missing_rate")
    )


def default_rate(target: Column | str = "good_bad") -> Column:
    return 1 - F.avg(S.col_of(target))


def default_rates(df: DataFrame, *by: str, target: str = "good_bad") -> DataFrame:
    """Rows and default rate, overall or per group."""
    measures = [F.count(F.lit(1)).alias("count"), default_rate(target).alias("default_rate")]
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def summarise(df: DataFrame, column: Column, name: str = "value",
              points: Sequence[float] = (0.5, 0.75, 0.9, 0.95), *, exact: bool = False) -> DataFrame:
    """Count, mean, quantiles and maximum of one derived column."""
    derived = df.select(column.cast("double").alias(name))
    return column_profile(derived, [name], points, exact=exact).select(
        "column", "count", "mean", *[quantile_name(p) for p in points], "max"
    )


def class_mean_gap(df: DataFrame, columns: Sequence[str], target: str = "good_bad",
                   top: int | None = None) -> DataFrame:
    """``|mean in defaults − mean in goods|`` per column, largest first.

    The columns become rows first, so the aggregate keeps four numbers per
    column however many columns there are.
    """
    value = F.col("value")
    wide = df.select(target, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    gaps = (
        wide.unpivot([target], list(columns), "feature", "value")
        .groupBy("feature")
        .agg(F.avg(F.when(F.col(target) == 0, value)).alias("mean_bad"),
             F.avg(F.when(F.col(target) == 1, value)).alias("mean_good"))
        .withColumn("gap", F.abs(F.col("mean_bad") - F.col("mean_good")))
        .orderBy(F.desc_nulls_last("gap"), "feature")
    )
    return gaps if top is None else gaps.limit(top)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (classes · n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(label, "n", (totals["n"] / (totals["k"] * F.col("n"))).alias("weight"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], *, exact: bool = True) -> DataFrame:
    """``(column, n_distinct)``; exact counts shuffle one row per distinct value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    if exact:
        return (long.where("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1).alias("one"))
                .groupBy("column").agg(F.count("one").alias("n_distinct")))
    return long.groupBy("column").agg(F.approx_count_distinct("value").alias("n_distinct"))


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Training means; one job for all columns, one row to the driver."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fit_medians(df: DataFrame, columns: Sequence[str], *, exact: bool = False) -> dict[str, float]:
    """Training medians, approximate by default."""
    if exact:
        rows = exact_quantiles(long_values(df, columns), "value", [0.5], keys=("column",)).collect()
        return {r["column"]: r["value"] for r in rows}
    row = df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def prediction_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
