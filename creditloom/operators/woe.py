"""Weight of evidence and information value, all features in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import scalars as S


def class_counts(df: DataFrame, classes: Mapping[str, Column | str], target: str = "good_bad",
                 good_value=1) -> DataFrame:
    """``(feature, bin, n_obs, n_good)`` of every feature from one scan.

    The classes are turned into rows and counted with map-side combine: the
    shuffle carries features × classes rows per task, not loans.
    """
    wide = df.select(
        S.good_indicator(target, good_value).alias("_good"),
        *[S.col_of(c).cast("string").alias(name) for name, c in classes.items()],
    )
    return (
        wide.unpivot(["_good"], list(classes), "feature", "bin")
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n_obs"), F.sum("_good").cast("long").alias("n_good"))
    )


def _share(part: Column, whole: Column) -> Column:
    return part / F.when(whole == 0, F.lit(1)).otherwise(whole)


def woe_table(counts: DataFrame, *, keys: Sequence[str] = ("feature",),
              order_by: str = "woe") -> DataFrame:
    """WoE/IV report of class counts.

    ``order_by`` is ``"woe"``, ``"bin"`` or the name of a column of ``counts``;
    ties go by WoE, then class name. The windows see one row per class.
    """
    by_feature = Window.partitionBy(*keys)
    n_bad = F.col("n_obs") - F.col("n_good")
    shares = counts.withColumn("n_bad", n_bad).select(
        "*",
        (F.col("n_good") / F.col("n_obs")).alias("prop_good"),
        _share(F.col("n_obs"), F.sum("n_obs").over(by_feature)).alias("prop_n_obs"),
        _share(F.col("n_good"), F.sum("n_good").over(by_feature)).alias("prop_n_good"),
        _share(F.col("n_bad"), F.sum("n_bad").over(by_feature)).alias("prop_n_bad"),
    )
    eps = F.lit(K.WOE_EPSILON)
    weighed = shares.withColumn(
        "woe", F.ln((F.col("prop_n_good") + eps) / (F.col("prop_n_bad") + eps))
    )
    order = {"woe": [F.asc("woe"), F.asc("bin")], "bin": [F.asc("bin")]}.get(
        order_by, [F.asc(order_by), F.asc("woe"), F.asc("bin")]
    )
    ordered = by_feature.orderBy(*order)
    part = (F.col("prop_n_good") - F.col("prop_n_bad")) * F.col("woe")
    return (
        weighed
        .withColumn("position", F.row_number().over(ordered) - 1)
        .withColumn("diff_prop_good", F.abs(F.col("prop_good") - F.lag("prop_good").over(ordered)))
        .withColumn("diff_woe", F.abs(F.col("woe") - F.lag("woe").over(ordered)))
        .withColumn("iv_component", part)
        .withColumn("iv", F.sum("iv_component").over(by_feature))
        .select(*keys, "position", "bin", "n_obs", "prop_good", "prop_n_obs", "n_good", "n_bad",
                "prop_n_good", "prop_n_bad", "woe", "diff_prop_good", "diff_woe",
                "iv_component", "iv")
    )


def iv_ranking(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Total information value per feature, strongest first."""
    return (
        table.groupBy(*keys)
        .agg(F.sum("iv_component").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
        .orderBy(F.desc("iv"), *keys)
    )


def merge_candidates(table: DataFrame, *, keys: Sequence[str] = ("feature",),
                     monotonic: Column | bool = False,
                     min_obs: float = K.MIN_SHARE_OBS, min_good: float = K.MIN_SHARE_GOOD,
                     min_bad: float = K.MIN_SHARE_BAD, min_woe: float = K.MIN_WOE_STEP,
                     min_rate: float = K.MIN_GOOD_RATE_STEP) -> DataFrame:
    """Flags on a WoE report: small classes, close pairs and monotonic breaks.

    A pair flag sits on the right-hand row and speaks of it and the row before;
    ``left_bin`` names that row.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("position")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.col("woe") - F.lag("woe").over(order)
    rising = F.last("woe").over(ends) >= F.first("woe").over(ends)
    wanted = F.lit(monotonic) if isinstance(monotonic, bool) else monotonic
    against = F.when(rising, step < 0).otherwise(step > 0)
    return table.select(
        *keys, "position", "bin",
        F.lag("bin").over(order).alias("left_bin"),
        ((F.col("prop_n_obs") < min_obs) | (F.col("prop_n_good") < min_good)
         | (F.col("prop_n_bad") < min_bad)).alias("is_small"),
        F.coalesce((F.col("diff_woe") < min_woe) | (F.col("diff_prop_good") < min_rate),
                   F.lit(False)).alias("is_close"),
        F.coalesce(wanted & (F.count(F.lit(1)).over(whole) >= 3) & against,
                   F.lit(False)).alias("is_break"),
        "n_obs", "prop_n_good", "prop_n_bad", "woe", "diff_woe",
    )


def suggested_merges(flags: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """One row per feature: the pair to merge next and why; NULL pair to stop.

    A small class goes first, to the neighbour nearest in WoE (left on a tie);
    then the closest pair; then the first monotonic break.
    """
    order = Window.partitionBy(*keys).orderBy("position")
    rows = flags.select(
        "*",
        F.lead("bin").over(order).alias("right_bin"),
        F.abs(F.col("woe") - F.lag("woe").over(order)).alias("to_left"),
        F.abs(F.col("woe") - F.lead("woe").over(order)).alias("to_right"),
    )
    takes_left = F.col("to_right").isNull() | (F.col("to_left") <= F.col("to_right"))
    partner = F.when(F.col("to_left").isNotNull() & takes_left, F.col("left_bin")).otherwise(
        F.col("right_bin")
    )
    small = F.min(F.when(F.col("is_small"), F.struct(
        F.col("n_obs").alias("a"), F.least("prop_n_good", "prop_n_bad").alias("b"),
        (-F.abs("woe")).alias("c"), F.col("position").alias("d"),
        F.col("bin").alias("x"), partner.alias("y"))))
    close = F.min(F.when(F.col("is_close"), F.struct(
        F.col("diff_woe").alias("a"), F.col("position").alias("d"),
        F.col("left_bin").alias("x"), F.col("bin").alias("y"))))
    broken = F.min(F.when(F.col("is_break"), F.struct(
        F.col("position").alias("d"), F.col("left_bin").alias("x"), F.col("bin").alias("y"))))
    picked = rows.groupBy(*keys).agg(
        small.alias("s"), close.alias("c"), broken.alias("b"),
        F.count_if("is_small").alias("n_small"), F.count_if("is_close").alias("n_close"),
        F.count_if("is_break").alias("n_break"),
    )
    def pick(field: str) -> Column:
        return (F.when(F.col("n_small") > 0, F.when(F.col("s.y").isNotNull(), F.col(f"s.{field}")))
                .when(F.col("n_close") > 0, F.col(f"c.{field}"))
                .when(F.col("n_break") > 0, F.col(f"b.{field}")))

    return picked.select(
        *keys, "n_small", "n_close", "n_break",
        pick("x").alias("merge_bin"), pick("y").alias("merge_with"),
        F.when(F.col("n_small") > 0, "small class")
        .when(F.col("n_close") > 0, "neighbours too similar")
        .when(F.col("n_break") > 0, "monotonic order broken")
        .otherwise("nothing to merge").alias("reason"),
    )
