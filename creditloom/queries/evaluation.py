"""Score quality queries on deterministic scores with many ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import evaluation as L
from creditloom.plans import views as V
from creditloom.queries.binning import rounded
from creditloom.queries.registry import query, sql_on

CUM = """
counts AS (SELECT model, score, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_pos, CAST(SUM(1 - y) AS BIGINT) AS n_neg FROM scored_long GROUP BY model, score),
cum AS (SELECT *, SUM(n_pos) OVER w AS cp, SUM(n_neg) OVER w AS cn, SUM(n_pos) OVER (PARTITION BY model) AS tp,
  SUM(n_neg) OVER (PARTITION BY model) AS tn FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

MEASURES = """
best AS (SELECT model, cp / tp - cn / tn AS gap, score, row_number() OVER (PARTITION BY model ORDER BY ROUND(cp / tp - cn / tn, 12) DESC, score DESC) AS k FROM cum),
areas AS (SELECT model, SUM(n_pos * (tn - cn + n_neg / 2.0::DOUBLE)) / (MAX(tp) * MAX(tn)::DOUBLE) AS auc,
  SUM(n_pos / tp * (cp / (cp + cn) + CASE WHEN cp - n_pos + cn - n_neg > 0 THEN (cp - n_pos) / (cp - n_pos + cn - n_neg) ELSE cp / (cp + cn) END) / 2) AS pr_auc
  FROM cum GROUP BY model),
measures AS (SELECT a.model, auc, 2 * auc - 1 AS gini, b.gap AS ks, b.score AS ks_threshold, pr_auc FROM areas a JOIN best b ON a.model = b.model AND b.k = 1)"""

LIFT = """
edges AS (SELECT model, list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored_long GROUP BY model),
placed AS (SELECT s.model, s.y, greatest(len(e) - 1, 1) - len(list_filter(e[2:len(e) - 1], lambda x: x < s.score)) AS decile
  FROM scored_long s JOIN edges USING (model)),
deciles AS (SELECT model, decile, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS defaults FROM placed GROUP BY model, decile),
lift AS (SELECT model, CAST(decile AS INTEGER) AS decile, n AS "count", defaults, defaults / n AS default_rate,
  (defaults / n) / (SUM(defaults) OVER w / SUM(n) OVER w) AS lift,
  CAST(SUM(defaults) OVER u AS BIGINT) AS cum_defaults, SUM(defaults) OVER u / SUM(defaults) OVER w AS cum_default_rate
  FROM deciles WINDOW w AS (PARTITION BY model), u AS (PARTITION BY model ORDER BY decile ROWS UNBOUNDED PRECEDING))"""


@query("score_metrics", sql_on("scored_long", body=f"""WITH {CUM}, {MEASURES}
SELECT model, ROUND(auc, 6) AS auc, ROUND(gini, 6) AS gini, ROUND(ks, 6) AS ks, ROUND(ks_threshold, 6) AS ks_threshold,
  ROUND(pr_auc, 6) AS pr_auc FROM measures"""))
def score_metrics(spark, d):
    return rounded(L.metrics(L.cumulative(V.scored_long(spark, d))))


@query("accuracy", sql_on("scored_long", body="""
SELECT model, ROUND(AVG(CASE WHEN (score > 0.3) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored_long GROUP BY model"""))
def accuracy(spark, d):
    return rounded(L.accuracy(V.scored_long(spark, d), threshold=0.3))


@query("roc_points", sql_on("scored_long", body=f"""WITH {CUM}
SELECT model, score AS threshold, ROUND(cn / tn, 6) AS fpr, ROUND(cp / tp, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM counts"""))
def roc_points(spark, d):
    return rounded(L.roc_points(L.cumulative(V.scored_long(spark, d))))


@query("ks_curve", sql_on("scored_long", body=f"""WITH {CUM}
SELECT model, score AS threshold, ROUND(cn / tn, 6) AS fpr, ROUND(cp / tp, 6) AS tpr FROM cum"""))
def ks_curve(spark, d):
    return rounded(L.roc_points(L.cumulative(V.scored_long(spark, d)), start=False))


@query("capture_curve", sql_on("scored_long", body=f"""WITH {CUM}
SELECT model, score, ROUND((cp + cn) / (tp + tn), 6) AS cum_population, ROUND(cp / tp, 6) AS cum_bad_capture FROM cum"""))
def capture_curve(spark, d):
    return rounded(L.capture_curve(L.cumulative(V.scored_long(spark, d))))


@query("running_share", sql_on("scored", body="""
WITH c AS (SELECT pd_a AS score, COUNT(*) AS n FROM scored GROUP BY pd_a)
SELECT score, n, CAST(SUM(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n, CAST(SUM(n) OVER () AS BIGINT) AS total_n FROM c"""))
def running_share(spark, d):
    from creditloom.operators.prefix import running_totals
    counts = V.scored(spark, d).groupBy(F.col("pd_a").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "score", ["n"], descending=False)


@query("lift_table", sql_on("scored_long", body=f"""WITH {LIFT}
SELECT model, decile, "count", defaults, ROUND(default_rate, 6) AS default_rate, ROUND(lift, 6) AS lift, cum_defaults,
  ROUND(cum_default_rate, 6) AS cum_default_rate FROM lift"""))
def lift_table(spark, d):
    return rounded(L.lift_table(V.scored_long(spark, d)))


@query("lift_comparison", sql_on("scored_long", body=f"""WITH {LIFT}
SELECT decile, ROUND(MAX(CASE WHEN model = 'a' THEN lift END), 6) AS lift_first, ROUND(MAX(CASE WHEN model = 'b' THEN lift END), 6) AS lift_second,
  ROUND(MAX(CASE WHEN model = 'b' THEN lift END) - MAX(CASE WHEN model = 'a' THEN lift END), 6) AS difference FROM lift GROUP BY decile"""))
def lift_comparison(spark, d):
    return rounded(L.lift_comparison(L.lift_table(V.scored_long(spark, d)), "a", "b"))


@query("calibration", sql_on("scored_long", body="""
SELECT model, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, ROUND(AVG(y), 6) AS default_rate FROM scored_long GROUP BY model"""))
def calibration(spark, d):
    return rounded(L.calibration(V.scored_long(spark, d)))


@query("model_comparison", sql_on("scored_long", body=f"""WITH {CUM}, {MEASURES}
SELECT model, ROUND(auc, 6) AS auc, ROUND(gini, 6) AS gini, ROUND(ks, 6) AS ks,
  ROUND(auc - (SELECT auc FROM measures WHERE model = 'b'), 6) AS delta_auc_vs_baseline FROM measures"""))
def model_comparison(spark, d):
    table = L.comparison(L.metrics(L.cumulative(V.scored_long(spark, d))), "b")
    return rounded(table.select("model", "auc", "gini", "ks", "delta_auc_vs_baseline"))


@query("model_improvement", sql_on("scored_long", body=f"""WITH {CUM}, {MEASURES},
long AS (SELECT model, 'auc' AS metric, auc AS v FROM measures UNION ALL SELECT model, 'gini', gini FROM measures UNION ALL SELECT model, 'ks', ks FROM measures)
SELECT metric, ROUND(MAX(CASE WHEN model = 'b' THEN v END), 6) AS baseline, ROUND(MAX(CASE WHEN model = 'a' THEN v END), 6) AS hybrid,
  ROUND(MAX(CASE WHEN model = 'a' THEN v END) - MAX(CASE WHEN model = 'b' THEN v END), 6) AS improvement FROM long GROUP BY metric"""))
def model_improvement(spark, d):
    return rounded(L.improvement(L.metrics(L.cumulative(V.scored_long(spark, d))), "b", "a"))
