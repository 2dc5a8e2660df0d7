"""Loss target and expected loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import loss as M
from creditloom.operators import profile as E
from creditloom.plans import views as V
from creditloom.queries.binning import rounded
from creditloom.queries.registry import query, sql_on
from creditloom.session import bucketed

TARGETS = """
t AS (SELECT *, CASE WHEN funded_amnt > 0 THEN total_rec_prncp / funded_amnt ELSE 0.0 END AS rr FROM scored),
targets AS (SELECT *, greatest(0.0, least(1.0, rr)) AS ccf, greatest(0.001, least(0.999, 1 - rr)) AS lgd,
  funded_amnt * greatest(0.0, least(1.0, rr)) AS ead FROM t)"""
EL = TARGETS + """,
el AS (SELECT id, y, pd_b, pd_a, lgd, ead, pd_b * lgd * ead AS el_b, pd_a * lgd * ead AS el_h FROM targets)"""


def el_parts(spark, d):
    """The four inputs of the merge, each one number per loan."""
    base = M.with_loss_targets(V.scored(spark, d, "total_rec_prncp"))
    return (base.select("id", (1 - F.col("good_bad")).alias("y_true"), F.col("pd_b").alias("prob_default")),
            base.select("id", F.col("pd_a").alias("prob_default")),
            base.select("id", F.col("lgd").alias("lgd_pred")), base.select("id", F.col("ead").alias("ead_pred")))


def given_scores(spark, d):
    """Deterministic default scores with the loss targets as predictions."""
    return M.expected_loss(*el_parts(spark, d))


@query("loss_targets", sql_on("loan_book", "scored", body=f"""WITH {TARGETS}
SELECT id, ROUND(rr, 6) AS recovery_rate, ROUND(ccf, 6) AS ccf, ROUND(lgd, 6) AS lgd, ROUND(ead, 4) AS ead FROM targets"""))
def loss_targets(spark, d):
    loans = M.with_loss_targets(V.loan_book(spark, d, "id", "funded_amnt", "total_rec_prncp"))
    return rounded(loans.select("id", "recovery_rate", "ccf", "lgd", "ead"), ead=4)


@query("expected_loss", sql_on("loan_book", "scored", body=f"""WITH {EL}
SELECT id, y AS y_true, pd_b AS "PD_baseline", pd_a AS "PD_hybrid", ROUND(lgd, 6) AS lgd_pred, ROUND(ead, 4) AS ead_pred,
  FLOOR(el_b * 1000 + 0.5::DOUBLE) / 1000 AS "EL_baseline", FLOOR(el_h * 1000 + 0.5::DOUBLE) / 1000 AS "EL_hybrid",
  FLOOR((el_h - el_b) * 1000 + 0.5::DOUBLE) / 1000 AS "EL_delta" FROM el"""))
def expected_loss(spark, d):
    """Loss per loan, to a tenth of a cent.

    A fully repaid loan's loss is a multiple of 1e-8 and may sit on a rounding
    boundary, where the engines' own ROUND differ; both round by FLOOR here.
    """
    el = given_scores(spark, d)
    names = ["EL_baseline", "EL_hybrid", "EL_delta"]
    cents = {c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in names}
    return rounded(el, ead_pred=4, **{c: 12 for c in names}).withColumns(cents)


@query("expected_loss_bucketed", sql_on("loan_book", "scored", body=f"""WITH {EL}
SELECT id, y AS y_true, ROUND(lgd, 6) AS lgd_pred, ROUND(ead, 4) AS ead_pred,
  FLOOR(el_b * 1000 + 0.5::DOUBLE) / 1000 AS "EL_baseline", FLOOR(el_h * 1000 + 0.5::DOUBLE) / 1000 AS "EL_hybrid" FROM el"""))
def expected_loss_bucketed(spark, d):
    """The four-way merge over tables bucketed by loan: each was dealt once, when it was written, and no join moves a row."""
    parts = [bucketed(part, name) for part, name in zip(el_parts(spark, d), ("pd-baseline", "pd-hybrid", "lgd", "ead"))]
    el = M.expected_loss(*parts)
    cents = {c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in ("EL_baseline", "EL_hybrid")}
    return rounded(el.select("id", "y_true", "lgd_pred", "ead_pred", "EL_baseline", "EL_hybrid"), ead_pred=4, EL_baseline=12,
                   EL_hybrid=12).withColumns(cents)


@query("expected_loss_summary", sql_on("loan_book", "scored", body=f"""WITH {EL}
SELECT COUNT(*) AS loans, ROUND(SUM(el_b), 2) AS total_baseline, ROUND(SUM(el_h), 2) AS total_hybrid, ROUND(AVG(el_b), 4) AS mean_baseline,
  ROUND(AVG(el_h), 4) AS mean_hybrid, ROUND(AVG(el_h - el_b), 4) AS mean_delta FROM el"""))
def expected_loss_summary(spark, d):
    return rounded(M.summary(given_scores(spark, d)), total_baseline=2, total_hybrid=2, mean_baseline=4,
                   mean_hybrid=4, mean_delta=4)


@query("expected_loss_histogram", sql_on("loan_book", "scored", body=f"""WITH {EL},
v AS (SELECT 'EL_baseline' AS "column", el_b AS x FROM el UNION ALL SELECT 'EL_hybrid', el_h FROM el),
ends AS (SELECT "column", MIN(x) AS a, MAX(x) AS b FROM v GROUP BY 1),
p AS (SELECT v."column", a, b, CAST(least(floor((x - a) / (b - a) * 50), 49) AS INTEGER) AS bin FROM v JOIN ends e ON v."column" = e."column")
SELECT "column", bin, ROUND(a + bin * ((b - a) / 50), 3) AS lo, ROUND(a + (bin + 1) * ((b - a) / 50), 3) AS hi, COUNT(*) AS "count"
FROM p GROUP BY "column", bin, a, b"""))
def expected_loss_histogram(spark, d):
    el = given_scores(spark, d).select("EL_baseline", "EL_hybrid")
    return rounded(M.histogram(el, ["EL_baseline", "EL_hybrid"]), lo=3, hi=3)


@query("prediction_stats", sql_on("loan_book", "scored", body=f"""WITH {TARGETS}
SELECT 'lgd' AS target, ROUND(AVG(lgd), 6) AS mean, ROUND(MIN(lgd), 6) AS "min", ROUND(MAX(lgd), 6) AS "max" FROM targets UNION ALL
SELECT 'ead', ROUND(AVG(ead), 3), ROUND(MIN(ead), 3), ROUND(MAX(ead), 3) FROM targets"""))
def prediction_stats(spark, d):
    loans = M.with_loss_targets(V.loan_book(spark, d, "funded_amnt", "total_rec_prncp"))
    lgd = E.prediction_stats(loans, "lgd").select(F.lit("lgd").alias("target"), "*")
    ead = E.prediction_stats(loans, "ead").select(F.lit("ead").alias("target"), "*")
    return rounded(lgd).union(rounded(ead, mean=3, min=3, max=3))
