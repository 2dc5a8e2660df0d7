"""Fine and coarse classing, weight of evidence and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import binning as B
from creditloom.operators import coarse as C
from creditloom.operators import prep as P
from creditloom.operators import woe as W
from creditloom.plans import views as V
from creditloom.queries.registry import query, sql_on
from creditloom.session import cut_lineage

DISCRETE = ["grade", "purpose", "addr_state"]
CONTINUOUS = {f: K.CONTINUOUS_FEATURES[f][0] for f in ("funded_amnt", "dti", "open_acc", "int_rate")}


# The specification's monotonic features, and the amount, which the test view makes monotonic.
MONOTONIC = ["funded_amnt", *(f for f in CONTINUOUS if K.CONTINUOUS_FEATURES[f][1])]


def r(c, digits=6):
    return F.round(c, digits)


def rounded(df, **digits):
    """Doubles rounded, everything else as it is."""
    return df.select(*[
        r(name, digits.get(name, 6)).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


WOE_COLUMNS = """
shares AS (SELECT *, n_obs - n_good AS n_bad, n_good / n_obs AS prop_good,
  n_obs / SUM(n_obs) OVER f AS prop_n_obs, n_good / greatest(SUM(n_good) OVER f, 1) AS prop_n_good,
  (n_obs - n_good) / greatest(SUM(n_obs - n_good) OVER f, 1) AS prop_n_bad
  FROM counts WINDOW f AS (PARTITION BY feature)),
weighed AS (SELECT *, ln((prop_n_good + 1e-9::DOUBLE) / (prop_n_bad + 1e-9::DOUBLE)) AS woe FROM shares),
stepped AS (SELECT *, row_number() OVER o - 1 AS position, abs(prop_good - lag(prop_good) OVER o) AS diff_prop_good,
  abs(woe - lag(woe) OVER o) AS diff_woe, lag(bin) OVER o AS left_bin, (prop_n_good - prop_n_bad) * woe AS iv_component
  FROM weighed WINDOW o AS (PARTITION BY feature ORDER BY {order})),
report AS (SELECT *, SUM(iv_component) OVER (PARTITION BY feature) AS iv FROM stepped)"""
REPORT = """
SELECT feature, CAST(position AS INTEGER) AS position, bin, n_obs, ROUND(prop_good, 6) AS prop_good, ROUND(prop_n_obs, 6) AS prop_n_obs,
  n_good, n_bad, ROUND(prop_n_good, 6) AS prop_n_good, ROUND(prop_n_bad, 6) AS prop_n_bad, ROUND(woe, 6) AS woe,
  ROUND(diff_prop_good, 6) AS diff_prop_good, ROUND(diff_woe, 6) AS diff_woe, ROUND(iv_component, 6) AS iv_component,
  ROUND(iv, 6) AS iv FROM report"""

DISCRETE_COUNTS = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, COALESCE(CAST({f} AS VARCHAR), 'MISSING') AS bin, COUNT(*) AS n_obs, "
    f"CAST(SUM(good_bad) AS BIGINT) AS n_good FROM loan_book GROUP BY 2" for f in DISCRETE)

EDGES = ",\n".join(
    f"edges_{f} AS (SELECT list_sort(list_distinct(quantile_cont({f}, "
    f"[{', '.join(repr(i / n) for i in range(1, n))}]))) AS e FROM loan_book WHERE {f} IS NOT NULL)"
    for f, n in CONTINUOUS.items())


def _bin_sql(f):
    return f"COALESCE(CAST(len(list_filter(e, lambda x: x <= {f})) AS VARCHAR), 'MISSING')"


NUMERIC_COUNTS = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN {f} IS NULL THEN 'MISSING' ELSE {_bin_sql(f)} END AS bin, COUNT(*) AS n_obs, "
    f"CAST(SUM(good_bad) AS BIGINT) AS n_good FROM loan_book, edges_{f} GROUP BY 2" for f in CONTINUOUS)


def discrete_counts(spark, d):
    loans = V.loan_book(spark, d, "good_bad", *DISCRETE)
    classes = B.base_classes(loans, DISCRETE, {}, keep=["good_bad"])
    return W.class_counts(classes, {f: f for f in DISCRETE})


def all_loans(spark, d):
    return V.loan_book(spark, d, "id", "good_bad", *DISCRETE, *CONTINUOUS)


def numeric_counts(spark, d, loans=None):
    loans = cut_lineage(V.loan_book(spark, d, "good_bad", *CONTINUOUS), "loans")
    edges = B.numeric_edges(loans, CONTINUOUS, exact=True)
    classes = B.base_classes(loans, [], edges, keep=["good_bad"])
    return W.class_counts(classes, {f: f for f in CONTINUOUS})


@query("base_classes_discrete", sql_on("loan_book", body="""
SELECT id, COALESCE(purpose, 'MISSING') AS purpose, CAST(open_acc AS VARCHAR) AS open_acc FROM loan_book"""))
def base_classes_discrete(spark, d):
    loans = V.loan_book(spark, d, "id", "purpose", "open_acc")
    return B.base_classes(loans, ["purpose", "open_acc"], {}, keep=["id"])


@query("woe_iv_discrete", sql_on("loan_book", body=f"""
WITH counts AS (SELECT 'grade' AS feature, COALESCE(grade, 'MISSING') AS bin, COUNT(*) AS n_obs, CAST(SUM(good_bad) AS BIGINT) AS n_good
  FROM loan_book GROUP BY 2), {WOE_COLUMNS.format(order='woe, bin')} {REPORT}"""))
def woe_iv_discrete(spark, d):
    loans = V.loan_book(spark, d, "good_bad", "grade")
    classes = B.base_classes(loans, ["grade"], {}, keep=["good_bad"])
    return rounded(W.woe_table(W.class_counts(classes, {"grade": "grade"})))


@query("woe_iv_all_features", sql_on("loan_book", body=f"""
WITH counts AS ({DISCRETE_COUNTS}), {WOE_COLUMNS.format(order='woe, bin')} {REPORT}"""))
def woe_iv_all_features(spark, d):
    return rounded(W.woe_table(discrete_counts(spark, d)))


@query("woe_iv_by_bin_name", sql_on("loan_book", body=f"""
WITH counts AS ({DISCRETE_COUNTS}), {WOE_COLUMNS.format(order='bin')} {REPORT}"""))
def woe_iv_by_bin_name(spark, d):
    return rounded(W.woe_table(discrete_counts(spark, d), order_by="bin"))


@query("quantile_edges_exact", sql_on("loan_book", body=f"""
WITH {EDGES}, e AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, unnest(e) AS edge FROM edges_{f}" for f in CONTINUOUS)})
SELECT feature, ROUND(edge, 6) AS edge, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) AS INTEGER) AS bin_id FROM e"""))
def quantile_edges_exact(spark, d):
    edges = B.numeric_edges(V.loan_book(spark, d, *CONTINUOUS), CONTINUOUS, exact=True)
    return B.bins_frame(spark, edges).where("bin_id > 0").select("feature", r("lo").alias("edge"), "bin_id")


@query("quantile_edges")
def quantile_edges(spark, d):
    edges = B.numeric_edges(V.loan_book(spark, d, *CONTINUOUS), CONTINUOUS)
    return B.bins_frame(spark, edges)


EDGE_POINTS = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {i / n!r}::DOUBLE AS q, quantile_disc({f}, {i / n!r}::DOUBLE) AS edge FROM loan_book WHERE {f} IS NOT NULL"
    for f, n in CONTINUOUS.items() for i in range(1, n))
VALUES = "\nUNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM loan_book WHERE {f} IS NOT NULL" for f in CONTINUOUS)


@query("sketch_edge_ranks", sql_on("loan_book", body=f"""
WITH p AS ({EDGE_POINTS}), x AS ({VALUES}), c AS (SELECT feature, v, COUNT(*) AS k FROM x GROUP BY 1, 2),
t AS (SELECT p.feature, q, edge, CAST(SUM(k) AS BIGINT) AS n, CAST(SUM(CASE WHEN v < edge THEN k ELSE 0 END) AS BIGINT) AS below,
    CAST(SUM(CASE WHEN v <= edge THEN k ELSE 0 END) AS BIGINT) AS upto
  FROM p JOIN c ON p.feature = c.feature GROUP BY 1, 2, 3)
SELECT feature, ROUND(q, 6) AS q, ROUND(edge, 6) AS edge, n, below, upto,
  ROUND(greatest(0.0, below / n - q, q - upto / n), 6) AS rank_error FROM t"""))
def sketch_edge_ranks(spark, d):
    """Sketches of two parts are written and merged. Up to ``SKETCH_SIZE`` values they are exact, and equal the SQL's edges."""
    loans = V.loan_book(spark, d, "id", *CONTINUOUS)
    parts = [cut_lineage(B.column_sketches(loans.where(F.col("id") % 2 == k), list(CONTINUOUS)), "edge-sketches") for k in (0, 1)]
    merged = cut_lineage(B.merge_sketches(parts[0].union(parts[1])), "edge-sketches")
    return rounded(B.edge_ranks(loans, merged, CONTINUOUS).withColumnRenamed("column", "feature"))


@query("fine_classing", sql_on("loan_book", body="""
SELECT id, CASE WHEN funded_amnt IS NULL THEN NULL ELSE CAST(len(list_filter([50000.0, 100000.0, 250000.0, 400000.0], lambda x: x <= funded_amnt)) AS INTEGER) END AS funded_amnt__bin,
  CASE WHEN dti IS NULL THEN NULL ELSE CAST(len(list_filter([0.0, 2500.5, 7000.0], lambda x: x <= dti)) AS INTEGER) END AS dti__bin,
  CASE WHEN dti IS NULL THEN 'MISSING' WHEN dti < 0 THEN '[-inf, 0)' WHEN dti < 2500.5 THEN '[0, 2500.5)'
    WHEN dti < 7000 THEN '[2500.5, 7000)' ELSE '[7000, inf)' END AS dti_label
FROM loan_book"""))
def fine_classing(spark, d):
    inf = float("inf")
    edges = {"funded_amnt": [-inf, 50000.0, 100000.0, 250000.0, 400000.0, inf], "dti": [-inf, 0.0, 2500.5, 7000.0, inf]}
    binned = B.with_bin_ids(V.loan_book(spark, d, "id", "funded_amnt", "dti"), edges)
    labels = [B.interval_label(a, b) for a, b in zip(edges["dti"], edges["dti"][1:])]
    names = F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), F.col("dti__bin")), F.lit("MISSING"))
    return binned.select("id", "funded_amnt__bin", "dti__bin", names.alias("dti_label"))


@query("woe_iv_numeric", sql_on("loan_book", body=f"""
WITH {EDGES}, counts AS ({NUMERIC_COUNTS}),
{WOE_COLUMNS.format(order="CASE WHEN bin = 'MISSING' THEN 1 ELSE 0 END, TRY_CAST(bin AS INTEGER)")} {REPORT}"""))
def woe_iv_numeric(spark, d):
    counts = numeric_counts(spark, d).withColumn("_order", F.coalesce(F.col("bin").try_cast("int"), F.lit(10**9)))
    return rounded(W.woe_table(counts, order_by="_order"))


@query("iv_ranking", sql_on("loan_book", body=f"""
WITH {EDGES}, counts AS ({DISCRETE_COUNTS} UNION ALL {NUMERIC_COUNTS}), {WOE_COLUMNS.format(order='woe, bin')}
SELECT feature, ROUND(SUM(iv_component), 6) AS iv, COUNT(*) AS n_bins FROM report GROUP BY feature"""))
def iv_ranking(spark, d):
    loans = V.loan_book(spark, d, "good_bad", *DISCRETE, *CONTINUOUS)
    edges = B.numeric_edges(loans, CONTINUOUS, exact=True)
    classes = B.base_classes(loans, DISCRETE, edges, keep=["good_bad"])
    counts = W.class_counts(classes, {f: f for f in [*DISCRETE, *CONTINUOUS]})
    return W.iv_ranking(W.woe_table(counts)).withColumn("iv", r("iv"))


FLAGS = """
flags AS (SELECT *, prop_n_obs < 0.05 OR prop_n_good < 0.05 OR prop_n_bad < 0.01 AS is_small,
  COALESCE(diff_woe < 0.005 OR diff_prop_good < 0.001, FALSE) AS is_close,
  COALESCE({mono} AND COUNT(*) OVER (PARTITION BY feature) >= 3 AND CASE WHEN
    last_value(woe) OVER p >= first_value(woe) OVER p THEN woe < lag(woe) OVER q ELSE woe > lag(woe) OVER q END, FALSE) AS is_break
  FROM report WINDOW p AS (PARTITION BY feature ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    q AS (PARTITION BY feature ORDER BY position))"""


@query("merge_candidates", sql_on("loan_book", body=f"""
WITH {EDGES}, counts AS ({NUMERIC_COUNTS}),
{WOE_COLUMNS.format(order="CASE WHEN bin = 'MISSING' THEN 1 ELSE 0 END, TRY_CAST(bin AS INTEGER)")},
{FLAGS.format(mono="feature = 'funded_amnt'")}
SELECT feature, CAST(position AS INTEGER) AS position, bin, left_bin, is_small, is_close, is_break FROM flags"""))
def merge_candidates(spark, d):
    counts = numeric_counts(spark, d).withColumn("_order", F.coalesce(F.col("bin").try_cast("int"), F.lit(10**9)))
    flags = W.merge_candidates(W.woe_table(counts, order_by="_order"), monotonic=F.col("feature") == "funded_amnt")
    return flags.select("feature", "position", "bin", "left_bin", "is_small", "is_close", "is_break")


@query("suggested_merges", sql_on("loan_book", body=f"""
WITH counts AS ({DISCRETE_COUNTS}), {WOE_COLUMNS.format(order='woe, bin')}, {FLAGS.format(mono='FALSE')},
sides AS (SELECT *, lead(bin) OVER q AS right_bin, abs(woe - lag(woe) OVER q) AS to_left, abs(woe - lead(woe) OVER q) AS to_right
  FROM flags WINDOW q AS (PARTITION BY feature ORDER BY position)),
small AS (SELECT feature, bin AS x, CASE WHEN to_left IS NOT NULL AND (to_right IS NULL OR to_left <= to_right) THEN left_bin ELSE right_bin END AS y
  FROM sides WHERE is_small QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n_obs, least(prop_n_good, prop_n_bad), -abs(woe), position) = 1),
near AS (SELECT feature, left_bin AS x, bin AS y FROM sides WHERE is_close
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY diff_woe, position) = 1),
n AS (SELECT feature, COUNT(*) FILTER (WHERE is_small) AS n_small, COUNT(*) FILTER (WHERE is_close) AS n_close,
  COUNT(*) FILTER (WHERE is_break) AS n_break FROM flags GROUP BY feature)
SELECT n.feature, n_small, n_close, n_break, CASE WHEN n_small > 0 THEN s.x ELSE c.x END AS merge_bin,
  CASE WHEN n_small > 0 THEN s.y ELSE c.y END AS merge_with,
  CASE WHEN n_small > 0 THEN 'small class' WHEN n_close > 0 THEN 'neighbours too similar' ELSE 'nothing to merge' END AS reason
FROM n LEFT JOIN small s ON n.feature = s.feature LEFT JOIN near c ON n.feature = c.feature"""))
def suggested_merges(spark, d):
    return W.suggested_merges(W.merge_candidates(W.woe_table(discrete_counts(spark, d))))


SPECS = [
    *(C.FeatureSpec(f) for f in DISCRETE),
    *(C.FeatureSpec(f, "continuous", bins, f in MONOTONIC) for f, bins in CONTINUOUS.items()),
]
NUMERIC_NAMES = ", ".join(f"'{f}'" for f in CONTINUOUS)

# The merge loop as a recursive query: one step per round, all features at once.
MERGE_STEPS = """
base AS (SELECT feature, bin, n_obs, n_good, row_number() OVER (PARTITION BY feature ORDER BY
    CASE WHEN feature IN ({numeric}) THEN COALESCE(TRY_CAST(bin AS INTEGER), 1000000) ELSE 0 END, bin) - 1 AS grp FROM counts),
rec AS (
  SELECT feature, 0 AS step, bin, n_obs, n_good, grp FROM base
  UNION ALL (
  WITH g AS (SELECT feature, grp, CAST(SUM(n_obs) AS DOUBLE) AS n, CAST(SUM(n_good) AS DOUBLE) AS good,
      string_agg(bin, ' | ' ORDER BY bin) AS label FROM rec GROUP BY feature, grp),
  s AS (SELECT *, n / SUM(n) OVER f AS pn, good / greatest(SUM(good) OVER f, 1) AS pg,
      (n - good) / greatest(SUM(n - good) OVER f, 1) AS pb, good / n AS rate FROM g WINDOW f AS (PARTITION BY feature)),
  w AS (SELECT *, ln((pg + 1e-9::DOUBLE) / (pb + 1e-9::DOUBLE)) AS woe FROM s),
  o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY CASE WHEN feature IN ({numeric}) THEN grp ELSE 0 END, woe, label) AS pos,
      COUNT(*) OVER (PARTITION BY feature) AS k FROM w),
  l AS (SELECT *, lag(grp) OVER q AS lgrp, lead(grp) OVER q AS rgrp, woe - lag(woe) OVER q AS dwoe, abs(lead(woe) OVER q - woe) AS rwoe,
      abs(rate - lag(rate) OVER q) AS drate, first_value(woe) OVER e AS w0, last_value(woe) OVER e AS w1 FROM o
      WINDOW q AS (PARTITION BY feature ORDER BY pos), e AS (PARTITION BY feature ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  cand AS (
    SELECT feature, 1 AS rule, n AS a, least(pg, pb) AS b, -abs(woe) AS c, pos, grp AS x,
      CASE WHEN lgrp IS NOT NULL AND (rgrp IS NULL OR abs(dwoe) <= rwoe) THEN lgrp ELSE rgrp END AS y
    FROM l WHERE k > 1 AND (pn < 0.05 OR pg < 0.05 OR pb < 0.01)
    UNION ALL SELECT feature, 2, abs(dwoe), 0, 0, pos, lgrp, grp FROM l WHERE abs(dwoe) < 0.005 OR drate < 0.001
    UNION ALL SELECT feature, 3, 0, 0, 0, pos, lgrp, grp FROM l WHERE feature IN ({monotonic}) AND k >= 3
      AND CASE WHEN w1 >= w0 THEN dwoe < 0 ELSE dwoe > 0 END),
  pick AS (SELECT feature, least(x, y) AS lo, greatest(x, y) AS hi FROM cand
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY rule, a, b, c, pos) = 1)
  SELECT r.feature, r.step + 1, r.bin, r.n_obs, r.n_good, CASE WHEN r.grp = p.hi THEN p.lo ELSE r.grp END
  FROM rec r JOIN pick p ON r.feature = p.feature WHERE r.step < 50)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY feature, step ORDER BY grp) - 1 AS g,
  MAX(step) OVER (PARTITION BY feature) AS last FROM rec)"""
ALL_COUNTS = f"counts AS ({DISCRETE_COUNTS} UNION ALL {NUMERIC_COUNTS})"


def fitted_sql(monotonic: list[str]) -> str:
    steps = MERGE_STEPS.format(numeric=NUMERIC_NAMES, monotonic=", ".join(f"'{f}'" for f in monotonic))
    return f"WITH RECURSIVE {EDGES}, {ALL_COUNTS}, {steps}"


FITTED = fitted_sql(MONOTONIC)


def fitted(spark, d, specs=SPECS, loans=None):
    return C.fit_classing(all_loans(spark, d) if loans is None else loans, specs, exact_edges=True)


def merged_report(keys: str, where: str) -> str:
    """Report over groups; classes are named by their base classes."""
    numeric = f"CASE WHEN feature IN ({NUMERIC_NAMES}) THEN g ELSE 0 END"
    body = WOE_COLUMNS.format(order=f"{numeric}, woe, bin").replace("PARTITION BY feature", f"PARTITION BY {keys}")
    grouped = f"""grouped AS (SELECT {keys}, g, string_agg(bin, ' | ' ORDER BY bin) AS bin, CAST(SUM(n_obs) AS BIGINT) AS n_obs,
  CAST(SUM(n_good) AS BIGINT) AS n_good FROM ranked WHERE {where} GROUP BY {keys}, g)"""
    return f"{grouped}, " + body.replace("FROM counts", "FROM grouped")


@query("coarse_classing_report", sql_on("loan_book", body=f"""
{FITTED}, {merged_report('feature', 'step = last')}
SELECT feature, CAST(position AS INTEGER) AS position, n_obs, n_good, n_bad, ROUND(prop_good, 6) AS prop_good, ROUND(woe, 6) AS woe,
  ROUND(diff_woe, 6) AS diff_woe, ROUND(iv_component, 6) AS iv_component, ROUND(iv, 6) AS iv FROM report"""))
def coarse_classing_report(spark, d):
    return rounded(fitted(spark, d).report().select(
        "feature", "position", "n_obs", "n_good", "n_bad", "prop_good", "woe", "diff_woe", "iv_component", "iv"))


@query("default_spec_classing", sql_on("loan_book", body=f"""
{fitted_sql([f for f in CONTINUOUS if K.CONTINUOUS_FEATURES[f][1]])}, {merged_report('feature', 'step = last')}
SELECT CASE feature WHEN 'dti' THEN 'dti_factor' ELSE feature END AS feature, CAST(position AS INTEGER) AS position, n_obs, n_good, n_bad,
  ROUND(woe, 6) AS woe, ROUND(iv, 6) AS iv FROM report"""))
def default_spec_classing(spark, d):
    """Features, aliases, class counts and orders resolved from the default specs, with nothing named here."""
    loans = V.loan_book(spark, d).withColumnRenamed("dti", "dti_factor")
    specs, names, _ = C.default_specs(loans)
    report = fitted(spark, d, specs, loans.select("id", "good_bad", *names.values())).report()
    return rounded(report.select("feature", "position", "n_obs", "n_good", "n_bad", "woe", "iv"))


@query("coarse_classing_history", sql_on("loan_book", body=f"""
{FITTED}, {merged_report('feature, step', 'TRUE')}
SELECT feature, CAST(step AS INTEGER) AS step, CAST(position AS INTEGER) AS position, bin, n_obs, n_good, ROUND(woe, 6) AS woe, ROUND(iv, 6) AS iv FROM report"""))
def coarse_classing_history(spark, d):
    return rounded(fitted(spark, d).history().select(
        "feature", "step", "position", "bin", "n_obs", "n_good", "woe", "iv"))


@query("coarse_classing_comparison", sql_on("loan_book", body=f"""
{FITTED}, {merged_report('feature, step, last', 'step = 0 OR step = last')}
SELECT feature, CASE WHEN step = last THEN 'final' ELSE 'initial' END AS stage, CAST(position AS INTEGER) AS position, bin, n_obs,
  ROUND(woe, 6) AS woe, ROUND(iv, 6) AS iv FROM report"""))
def coarse_classing_comparison(spark, d):
    return rounded(fitted(spark, d).comparison().select(
        "feature", "stage", "position", "bin", "n_obs", "woe", "iv"))


@query("coarse_classing_mapping", sql_on("loan_book", body=f"""
{FITTED}, {merged_report('feature', 'step = last')}
SELECT r.feature, r.bin, CAST(r.g AS INTEGER) AS grp, ROUND(p.woe, 6) AS woe FROM ranked r
JOIN report p ON r.feature = p.feature AND r.g = p.g WHERE r.step = r.last"""))
def coarse_classing_mapping(spark, d):
    return rounded(fitted(spark, d).groups.where("woe IS NOT NULL").select("feature", "bin", "grp", "woe"))


TRAIN = "((id % 2147483647) * 48271 % 2147483647) % 1000 < 800"
TRAIN_FITTED = FITTED.replace("FROM loan_book", "FROM train_loans")


def _base_sql(f):
    if f in DISCRETE:
        return f"SELECT id, '{f}' AS feature, COALESCE({f}, 'MISSING') AS bin FROM test_loans"
    return f"SELECT id, '{f}' AS feature, CASE WHEN {f} IS NULL THEN 'MISSING' ELSE {_bin_sql(f)} END AS bin FROM test_loans, edges_{f}"


APPLIED = TRAIN_FITTED.replace("WITH RECURSIVE ", f"""WITH RECURSIVE train_loans AS (SELECT * FROM loan_book WHERE {TRAIN}),
test_loans AS (SELECT * FROM loan_book WHERE NOT ({TRAIN})), """, 1) + f""",
{merged_report('feature', 'step = last')},
mapping AS (SELECT r.feature, r.bin, r.g, p.woe FROM ranked r JOIN report p ON r.feature = p.feature AND r.g = p.g WHERE r.step = r.last),
placed AS (SELECT t.id, t.feature, m.g, m.woe FROM ({" UNION ALL ".join(_base_sql(f) for f in [*DISCRETE, *CONTINUOUS])}) t
  LEFT JOIN mapping m ON t.feature = m.feature AND t.bin = m.bin)"""


@query("coarse_classing_apply", sql_on("loan_book", body=f"""
{APPLIED}
SELECT id, {", ".join(f"ROUND(MAX(CASE WHEN feature = '{f}' THEN woe END), 6) AS {f}_woe" for f in [*DISCRETE, *CONTINUOUS])}
FROM placed GROUP BY id"""))
def coarse_classing_apply(spark, d):
    """Fitted on the training part, applied to the test part."""
    train, test = P.stable_split(all_loans(spark, d))
    applied = fitted(spark, d, loans=train).transform(test, "woe")
    return rounded(applied.select("id", *[f"{f}_woe" for f in [*DISCRETE, *CONTINUOUS]]))


@query("indicator_columns", sql_on("loan_book", body=f"""
{APPLIED}
SELECT feature, CAST(g AS INTEGER) AS grp, COUNT(*) AS ones FROM placed GROUP BY feature, g"""))
def indicator_columns(spark, d):
    """Ones per indicator column of the test part, with the group it stands for."""
    train, test = P.stable_split(all_loans(spark, d))
    classing = fitted(spark, d, loans=train)
    order = {(row["feature"], row["label"]): row["grp"] for row in classing.groups.select("feature", "label", "grp").distinct().collect()}
    named = [(c, f, order[f, label]) for f, pairs in classing.indicator_names().items() for c, label in pairs]
    flags = classing.indicators(test)
    sums = flags.agg(*[F.sum(f"`{c}`").alias(c) for c, _, _ in named])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(g).alias("grp"), F.col(f"`{c}`").alias("ones")) for c, f, g in named])
    return sums.select(F.inline(rows)).where("ones > 0")


@query("indicator_vectors", sql_on("loan_book", body=f"""
{APPLIED}
SELECT feature, CAST(g AS INTEGER) AS grp, COUNT(*) AS ones FROM placed GROUP BY feature, g"""))
def indicator_vectors(spark, d):
    """Ones per place of the indicator vectors of the test part; a vector is as long as training has groups."""
    train, test = P.stable_split(all_loans(spark, d))
    vectors = fitted(spark, d, loans=train).indicator_vectors(test)
    from creditloom.operators.embeddings import sparse_parts

    features = [*DISCRETE, *CONTINUOUS]
    places = vectors.select(*[sparse_parts(f"{f}_ind")["indices"].alias(f) for f in features])
    return places.unpivot([], features, "feature", "indices").select("feature", F.explode("indices").alias("grp")).groupBy(
        "feature", "grp").agg(F.count(F.lit(1)).alias("ones"))


# The training part's rows with their groups.
TRAIN_PLACED = APPLIED.replace("FROM test_loans", "FROM train_loans")
