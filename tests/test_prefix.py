import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.operators.prefix import exact_quantiles, range_edges, running_totals


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([-3.5, -1.0, 0.0, 0.25, 0.5, 2.0, 7.0, 1e9]), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    points = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", points).collect()}
    for p in points:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_per_key_ignore_null_and_nan(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", None), ("b", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["q"]): r["value"] for r in exact_quantiles(df, "v", [0.25, 0.5], keys=("k",)).collect()}
    assert got == {("a", 0.25): 25.0, ("a", 0.5): 50.0, ("b", 0.25): 5.0, ("b", 0.5): 5.0}


def test_running_totals_with_a_hot_value(spark):
    # A third of all rows share one score.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000).alias("s"),
                                  (F.col("id") % 5 == 0).cast("long").alias("y"))
    counts = df.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    got = running_totals(counts, "s", ["n", "y"], edges=range_edges(df, "s", 16)).orderBy(F.desc("s")).toPandas()
    want = counts.toPandas().sort_values("s", ascending=False)
    assert got["cum_n"].tolist() == want["n"].cumsum().tolist()
    assert got["cum_y"].tolist() == want["y"].cumsum().tolist()
    assert set(got["total_n"]) == {3000}


def test_no_single_partition_stage(spark):
    df = spark.range(1000).select((F.col("id") / 7).alias("s"))
    counts = df.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    plan = running_totals(counts, "s", ["n"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_in_n" in line]
    assert windows and all("_range" in w for w in windows)
