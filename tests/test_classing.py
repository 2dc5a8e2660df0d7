import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import binning as B
from creditloom.operators import coarse as C
from creditloom.operators import woe as W
from creditloom.plans import structured as ST

INF = float("inf")


def counts_frame(spark, rows):
    return spark.createDataFrame(rows, "feature string, bin string, n_obs long, n_good long")


# Counts of published coarse-class reports (fixed values).
GRADE = [("F | G | E", 151487, 104780, -1.107338212364037), ("D", 259344, 206707, -0.547424049715554),
         ("C", 519837, 445409, -0.12614634356844037), ("B", 530346, 484390, 0.43989885854421784),
         ("A | MISSING", 346756, 334392, 1.382217829112681)]


def test_published_grade_report(spark):
    counts = counts_frame(spark, [("grade", b, n, g) for b, n, g, _ in GRADE])
    rows = W.woe_table(counts).orderBy("position").collect()
    assert [r["bin"] for r in rows] == [b for b, *_ in GRADE]
    for row, (_, _, _, woe) in zip(rows, GRADE):
        assert row["woe"] == pytest.approx(woe, abs=1e-12)
        assert row["iv"] == pytest.approx(0.47417175923659854, abs=1e-12)
    assert rows[0]["diff_woe"] is None and rows[1]["diff_woe"] == pytest.approx(0.5599141626484829)


def test_published_reports_need_no_merge(spark):
    counts = counts_frame(spark, [("grade", b, n, g) for b, n, g, _ in GRADE])
    row = W.suggested_merges(W.merge_candidates(W.woe_table(counts))).first()
    assert row["reason"] == "nothing to merge" and row["merge_bin"] is None


def test_one_class_only_in_a_bin(spark):
    counts = counts_frame(spark, [("f", "a", 10, 10), ("f", "b", 10, 0)])
    woes = [r["woe"] for r in W.woe_table(counts).orderBy("position").collect()]
    assert woes[0] == pytest.approx(-math.log((1 + 1e-9) / 1e-9)) and woes[1] == pytest.approx(-woes[0])


def test_only_good_loans(spark):
    rows = W.woe_table(counts_frame(spark, [("f", "a", 4, 4), ("f", "b", 6, 6)])).collect()
    assert all(r["prop_n_bad"] == 0 for r in rows)


def rescan(loans: pd.DataFrame, spec: C.FeatureSpec) -> dict[str, int]:
    """Merge loop that recounts the raw rows each round, by plain rules."""
    order = sorted(loans["bin"].unique(), key=lambda b: (0, b) if spec.kind == "discrete" else
                   (1 if b == "MISSING" else 0, 0 if b == "MISSING" else int(b)))
    group = {b: i for i, b in enumerate(order)}
    for _ in range(spec.max_merges):
        frame = loans.assign(g=loans["bin"].map(group))
        t = frame.groupby("g")["good"].agg(["count", "sum"])
        bad = t["count"] - t["sum"]
        t["pg"], t["pb"] = t["sum"] / t["sum"].sum(), bad / bad.sum()
        t["woe"] = np.log((t["pg"] + 1e-9) / (t["pb"] + 1e-9))
        if spec.kind == "discrete":
            names = {g: " | ".join(sorted(b for b in group if group[b] == g)) for g in t.index}
            ids = sorted(t.index, key=lambda g: (t["woe"][g], names[g]))
        else:
            ids = list(t.index)
        share = t["count"] / t["count"].sum()
        small = [g for g in ids if share[g] < .05 or t["pg"][g] < .05 or t["pb"][g] < .01]
        pair = None
        if len(ids) > 1 and small:
            worst = min(small, key=lambda g: (t["count"][g], min(t["pg"][g], t["pb"][g]), -abs(t["woe"][g])))
            at = ids.index(worst)
            sides = [ids[i] for i in (at - 1, at + 1) if 0 <= i < len(ids)]
            pair = worst, min(sides, key=lambda g: abs(t["woe"][worst] - t["woe"][g]))
        elif not small:
            steps = list(zip(ids, ids[1:]))
            rate = t["sum"] / t["count"]
            close = [(a, b) for a, b in steps if abs(t["woe"][b] - t["woe"][a]) < .005 or abs(rate[b] - rate[a]) < .001]
            if close:
                pair = min(close, key=lambda p: abs(t["woe"][p[1]] - t["woe"][p[0]]))
            elif spec.monotonic and len(ids) >= 3:
                up = t["woe"][ids[-1]] >= t["woe"][ids[0]]
                wrong = [(a, b) for a, b in steps if (t["woe"][b] < t["woe"][a] if up else t["woe"][b] > t["woe"][a])]
                pair = wrong[0] if wrong else None
        if pair is None:
            break
        low, high = min(pair), max(pair)
        group = {b: low if g == high else g for b, g in group.items()}
    dense = {g: i for i, g in enumerate(sorted(set(group.values())))}
    return {b: dense[g] for b, g in group.items()}


@pytest.mark.parametrize("seed", range(6))
def test_replay_on_counts_equals_rescan_of_rows(seed):
    rng = np.random.default_rng(seed)
    kind = "discrete" if seed % 2 else "continuous"
    spec = C.FeatureSpec("f", kind, monotonic=seed % 3 == 0)
    bins = rng.choice(12, 3000, p=rng.dirichlet(np.ones(12)))
    loans = pd.DataFrame({"bin": [str(b) if b < 11 else "MISSING" for b in bins],
                          "good": (rng.random(3000) < 0.6 + 0.03 * bins).astype(int)})
    counts = loans.groupby("bin")["good"].agg(n_obs="count", n_good="sum").reset_index()
    ordered = C.base_order([tuple(r) for r in counts.itertuples(index=False)], kind, "MISSING")
    groups = [[b] for b, *_ in ordered]
    for left, right, _ in C.merge_decisions(ordered, spec)[:-1]:
        groups[left] += groups.pop(right)
    assert {b: g for g, members in enumerate(groups) for b in members} == rescan(loans, spec)


def frame(spark):
    rows = []
    for i in range(4000):
        x = None if i % 11 == 0 else float(i % 100)
        c = None if i % 17 == 0 else "abcdefgh"[i % 8]
        good = int((i * 7919) % 100 < 60 + (i % 100) * 0.3 - (5 if c == "a" else 0))
        rows.append((i, good, x, c, float("nan") if i % 50 == 0 else 1e7 + i, None))
    return spark.createDataFrame(rows, "id int, good_bad int, x double, c string, big double, empty double")


SPECS = [C.FeatureSpec("x", "continuous", 20, True), C.FeatureSpec("c"), C.FeatureSpec("big", "continuous", 10),
         C.FeatureSpec("empty", "continuous", 5)]


@pytest.fixture(scope="module")
def classing(spark):
    return C.fit_classing(frame(spark), SPECS)


def test_counts_and_iv(spark, classing):
    report = classing.report().toPandas()
    assert (report.groupby("feature")["n_obs"].sum() == 4000).all()
    assert (report["iv"] >= 0).all()
    x = report[(report["feature"] == "x") & ~report["bin"].str.contains("MISSING")].sort_values("position")["woe"]
    assert x.is_monotonic_increasing or x.is_monotonic_decreasing or len(x) < 3
    history = classing.history().toPandas()
    assert (history.groupby(["feature", "step"])["n_obs"].sum() == 4000).all()
    # Each step has one group fewer than the step before.
    sizes = history.groupby(["feature", "step"]).size()
    for feature in sizes.index.get_level_values(0).unique():
        assert (np.diff(sizes[feature].to_numpy()) == -1).all()


def test_indicators_sum_to_one_and_match_between_frames(spark, classing):
    train = classing.indicators(frame(spark))
    test = classing.indicators(frame(spark).where("id < 10"))
    assert train.columns == test.columns
    for feature, pairs in classing.indicator_names().items():
        total = sum(F.col(f"`{c}`") for c, _ in pairs)
        assert train.where(total != 1).count() == 0, feature


def test_unseen_values_take_the_missing_class(spark, classing):
    odd = spark.createDataFrame([(1, 1, -5.0, "zzz", 1e12, 3.0)], frame(spark).schema)
    row = classing.transform(odd, "both").first()
    missing = classing.groups.where("feature = 'c' AND bin = 'MISSING'").first()
    assert row["c_grp"] == missing["label"] and row["c_woe"] == pytest.approx(missing["woe"])
    lowest = next(r for r in classing.of("x") if r["bin"] == "0")
    assert row["x_grp"] == lowest["label"]


def test_transform_outputs(spark, classing):
    df = frame(spark).limit(3)
    assert [c for c in classing.transform(df, "woe").columns if c.endswith("_grp")] == []
    assert [c for c in classing.transform(df, "group").columns if c.endswith("_woe")] == []
    with pytest.raises(ValueError):
        classing.transform(df, "other")


def test_save_and_load(spark, classing, tmp_path):
    classing.save(spark, str(tmp_path))
    again = C.Classing.load(spark, str(tmp_path))
    df = frame(spark).orderBy("id")
    assert again.transform(df, "woe").drop("big").collect() == classing.transform(df, "woe").drop("big").collect()
    assert again.specs == classing.specs


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        C.fit_classing(frame(spark), [C.FeatureSpec("nope")])
    with pytest.raises(ValueError):
        C.FeatureSpec("x", "special")


def test_fine_classing_boundaries(spark):
    df = spark.createDataFrame([(36.0,), (60.0,), (35.9,), (None,), (float("nan"),)], "t double")
    out = B.with_bin_ids(df, {"t": [-INF, 36.0, 60.0, INF]})
    assert [r["t__bin"] for r in out.collect()] == [1, 2, 0, None, None]


def test_labels():
    assert B.interval_label(-INF, 0.5) == "[-inf, 0.5)"
    assert B.interval_label(36, 60, "legacy") == "(36, 60]"
    spec, edges = C.FeatureSpec("t", "continuous"), [-INF, 36.0, 60.0, INF]
    assert C.group_label(["1", "2", "MISSING"], spec, edges) == "[36, inf) | MISSING"
    assert C.group_label(["b", "c"], C.FeatureSpec("d"), None) == "b | c"


def test_empty_training_bins_join_a_neighbour(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) * 10) for i in range(100)], "id int, good_bad int, x double")
    edges = {"x": [-INF, 0.0, 3.0, 6.0, INF]}
    c = C.fit_classing(df, [C.FeatureSpec("x", "continuous", min_woe=0, min_rate=0, min_good=0, min_bad=0, min_obs=0)], edges=edges)
    grp = {r["bin"]: r["grp"] for r in c.of("x")}
    assert grp["0"] == grp["1"] == grp["2"] != grp["3"]


def test_edges_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    assert B.numeric_edges(df, {"a": 5, "b": 5}) == {"a": [-INF, 1.0, INF], "b": [-INF, 0.0, INF]}
    assert B.numeric_edges(df, {"a": 5, "b": 5}, exact=True) == {"a": [-INF, 1.0, INF], "b": [-INF, 0.0, INF]}


def test_text_numbers_are_classed_as_numbers(spark):
    df = spark.createDataFrame([("13.5%",), ("1,000",), ("n/a",)], "p string")
    out = B.with_bin_ids(df, {"p": [-INF, 20.0, INF]})
    assert [r["p__bin"] for r in out.collect()] == [0, 1, None]


@pytest.mark.parametrize("seed", range(2))
def test_wide_features_take_the_same_decisions(spark, seed):
    """Steps on the ordered table and steps on the driver's list, with ties, under several limits."""
    rng = np.random.default_rng(seed)
    rows, specs = [], []
    for f, limits in enumerate([{}, {"min_obs": 0.0, "min_good": 0.0, "min_bad": 0.0}, {"min_obs": 0.002, "min_good": 0.0, "min_bad": 0.0, "max_merges": 12},
                                {"min_obs": 0.0, "min_good": 0.0, "min_bad": 0.0, "min_woe": 0.2}]):
        for c in range(int(rng.integers(2, 90))):
            n = int(rng.integers(1, 12 if seed % 2 else 400))
            rows.append((f"f{f}", f"c{c:02d}", n, int(rng.integers(0, n + 1))))
        specs.append(C.FeatureSpec(f"f{f}", **limits))
    counts = counts_frame(spark, rows).cache()
    wide = sorted(map(str, C.plan_merges(counts, specs, driver_classes=0).collect()))
    assert wide == sorted(map(str, C.plan_merges(counts, specs).collect()))


def test_a_million_classes(spark):
    """One feature of a million classes: groups are named once, and their names grow with the classes, not their square."""
    df = spark.range(1_500_000).select("id", (F.col("id") % 7 > 0).cast("int").alias("good_bad"),
                                       F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.col("id") % 1000).cast("string").alias("c"))
    classing = C.fit_classing(df, [C.FeatureSpec("c", max_merges=6)])
    classes = df.select("c").distinct().count()
    assert classes > 1_000_000 and classing.members.count() == classes
    assert classing.named.count() == classes - 6
    assert classing.named.agg(F.sum(F.length("label"))).first()[0] <= 8 * classes + 3 * 6
    assert classing.group_numbers == {"c": classes - 6}
    vectors = classing.indicator_vectors(df.where("id < 1000"))
    assert vectors.count() == 1000 and vectors.first()["c_ind"].size == classes - 6
    out = classing.transform(df, "both")
    assert out.where("c_grp IS NULL OR c_woe IS NULL").count() == 0


def test_vectors_equal_indicator_columns(spark, classing):
    columns = {f: [c for c, _ in pairs] for f, pairs in classing.indicator_names().items()}
    odd = spark.createDataFrame([(7000, 1, -5.0, "zzz", 1e12, 3.0)], frame(spark).schema)
    df = frame(spark).where("id % 37 = 0").union(odd)
    flags = {r["id"]: r for r in classing.indicators(df).collect()}
    vectors = classing.indicator_vectors(df).collect()
    assert len(vectors) == len(flags)
    for row in vectors:
        for f, names in columns.items():
            assert list(row[f"{f}_ind"].toArray()) == [flags[row["id"]][c] for c in names]
    table = {(r["feature"], r["grp"]): r["label"] for r in classing.indicator_table().collect()}
    assert [table["x", g] for g in range(len(columns["x"]))] == classing.labels("x")


def test_large_lookups_are_joined_with_salts(spark, classing, monkeypatch):
    df = frame(spark)
    want = sorted(map(str, classing.transform(df).select("id", "c_grp", "c_woe").collect()))
    classing.__dict__["_lookup_bytes"] = {f: (1 << 40, 1 << 40) for f in classing.features}
    got = classing.transform(df).select("id", "c_grp", "c_woe")
    del classing.__dict__["_lookup_bytes"]
    assert sorted(map(str, got.collect())) == want


def test_many_categories(spark):
    """More classes than a driver list should hold; one class has a third of all rows."""
    df = spark.range(360_000).select("id", (F.col("id") % 7 > 0).cast("int").alias("good_bad"),
                                     F.when(F.col("id") % 3 > 0, (F.col("id") / 2).cast("long")).otherwise(-1).cast("string").alias("c"))
    classing = C.fit_classing(df, [C.FeatureSpec("c", max_merges=3)])
    assert classing.groups.count() == df.select("c").distinct().count() > 100_000
    out = classing.transform(df, "both")
    assert out.where("c_grp IS NULL OR c_woe IS NULL").count() == 0 and out.count() == 360_000
    assert classing.report().agg(F.sum("n_obs")).first()[0] == 360_000


def test_default_specs_resolve_aliases(spark):
    df = spark.createDataFrame([("A", 1.0)], "grade string, dti_factor double")
    specs, names, absent = C.default_specs(df)
    assert names == {"grade": "grade", "dti": "dti_factor"} and len(specs) == 2 and "int_rate" in absent


def test_structured_plan(spark):
    df = frame(spark)
    plan = ST.fit_structured(df.where("id % 5 > 0"), df.where("id % 5 = 0"), SPECS)
    assert plan.train.columns == plan.test.columns
    assert set(plan.strongest(3)) <= set(plan.train.columns) and len(plan.strongest(3, by="iv")) == 3
    assert plan.full().count() == 4000
    assert [r["feature"] for r in plan.iv().collect()]


def test_sketches_of_parts_merge_and_keep_ranks(spark):
    rows = spark.range(40_000).select(
        ((F.col("id") * 7919) % 40_000).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") % 11).alias("ties"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).alias("none"), "id")
    columns = {"a": 20, "ties": 5, "none": 4}
    parts = [B.column_sketches(rows.where(F.col("id") % 4 == k), list(columns), 4000) for k in range(4)]
    merged = B.merge_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), 4000)
    ranks = B.edge_ranks(rows, merged, columns).collect()
    assert {(r.column, round(r.q, 3)) for r in ranks} == {(c, round(i / n, 3)) for c, n in columns.items() if c != "none" for i in range(1, n)}
    assert max(r.rank_error for r in ranks) < 0.001 and all(r.n == 40_000 for r in ranks)
    edges = B.sketch_edges(merged, columns)
    assert edges["none"] == [-B.INF, 0.0, B.INF] and len(edges["a"]) == 21
    assert all(abs(e - 2000 * i) <= 40 for i, e in enumerate(edges["a"][1:-1], 1))


def test_sketches_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a double")
    sketches = B.column_sketches(empty, ["a"])
    assert B.edge_ranks(empty, sketches, {"a": 3}).count() == 0
    assert sketches.count() == 0 and B.sketch_edges(sketches, {"a": 3})["a"] == [-B.INF, 0.0, B.INF]
