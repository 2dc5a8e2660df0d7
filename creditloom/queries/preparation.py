"""Projection, parsing, joins, profiles, top-k, set and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions import names as N
from creditloom.functions import scalars as S
from creditloom.operators import prep as P
from creditloom.operators import profile as E
from creditloom.operators import text as X
from creditloom.plans import views as V
from creditloom.queries.registry import query, sql_on
from creditloom.session import cut_lineage


def r(c, digits=6):
    return F.round(c, digits)


# --- projections, predicates and scalar functions -------------------------------

@query("project_columns", sql_on("loan_book", body="SELECT id, good_bad, grade, purpose FROM loan_book"))
def project_columns(spark, d):
    return V.loan_book(spark, d, "id", "good_bad", "grade", "purpose")


@query("first_integer", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0
    ELSE TRY_CAST(regexp_extract(o_orderpriority, '(\\d+)', 1) AS INTEGER) END AS INTEGER) AS level,
  TRY_CAST(regexp_extract(o_orderstatus, '(\\d+)', 1) AS INTEGER) AS no_digits
FROM orders""")
def first_integer(spark, d):
    orders = V.table(spark, d, "orders")
    levels = P.with_first_integer(orders, "o_orderpriority", "level", {"5-LOW": 0})
    return P.with_first_integer(levels, "o_orderstatus", "no_digits").select(
        F.col("o_orderkey").alias("id"), "level", "no_digits")


@query("parse_number", """
WITH t AS (
  SELECT event_id AS id, props AS a, CAST(value AS VARCHAR) || '%' AS b,
    CASE WHEN event_type = 'error' THEN 'N/A' ELSE ' 1,' || CAST(100 + user_id % 900 AS VARCHAR) END AS c
  FROM events)
SELECT id, TRY_CAST(regexp_extract(replace(replace(a, ',', ''), '%', ''), '[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) AS from_json,
  TRY_CAST(regexp_extract(replace(replace(b, ',', ''), '%', ''), '[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) AS from_percent,
  CASE WHEN c = 'N/A' THEN NULL ELSE TRY_CAST(regexp_extract(replace(c, ',', ''), '[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) END AS from_commas
FROM t""")
def parse_number(spark, d):
    text = V.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("a"),
        F.concat(F.col("value").cast("string"), F.lit("%")).alias("b"),
        F.when(F.col("event_type") == "error", "N/A").otherwise(
            F.concat(F.lit(" 1,"), (100 + F.col("user_id") % 900).cast("string"))).alias("c"))
    return text.select("id", S.parse_number("a").alias("from_json"),
                       S.parse_number("b").alias("from_percent"), S.parse_number("c").alias("from_commas"))


@query("months_since", sql_on("loan_book", body="""
WITH m AS (SELECT id, datesub('month', date_trunc('month', issue_d), TIMESTAMP '1998-12-01') AS off FROM loan_book)
SELECT id, CAST(CASE WHEN off < 0 THEN (SELECT MAX(off) FROM m WHERE off >= 0) ELSE off END AS INTEGER) AS mths_since_issue_d
FROM m"""))
def months_since(spark, d):
    loans = V.loan_book(spark, d, "id", "issue_d").select(
        "id", F.date_format("issue_d", "MMM-yyyy").alias("issue_d"))
    return P.with_months_since(loans, "issue_d", "mths_since_issue_d", reference="1998-12-01").select(
        "id", "mths_since_issue_d")


@query("text_present", sql_on("loan_text_gaps", body="""
SELECT id, good_bad, LENGTH(desc_) AS n_chars FROM loan_text_gaps WHERE desc_ IS NOT NULL AND desc_ <> ''"""))
def text_present(spark, d):
    return X.text_present(V.loan_text_gaps(spark, d), "desc_").select(
        "id", "good_bad", F.length("desc_").cast("long").alias("n_chars"))


@query("missing_flag", sql_on("loan_text_gaps", body="""
SELECT id, CASE WHEN desc_ IS NULL OR trim(desc_) = '' THEN 1 ELSE 0 END AS desc_missing FROM loan_text_gaps"""))
def missing_flag(spark, d):
    return V.loan_text_gaps(spark, d).select("id", S.missing_flag("desc_").alias("desc_missing"))


@query("binary_target", sql_on("loan_book", body="""
SELECT id, CASE WHEN loan_status IN ('F', 'P') THEN 0 ELSE 1 END AS good_bad,
  CAST(CASE WHEN loan_status IN ('F', 'P') THEN 1 ELSE 0 END AS DOUBLE) AS bad_label,
  CASE WHEN loan_status IN ('F', 'P') THEN 0 ELSE 1 END AS good_indicator
FROM loan_book"""))
def binary_target(spark, d):
    loans = V.loan_book(spark, d, "id", "loan_status").withColumn(
        "good_bad", S.good_bad("loan_status", ["F", "P"]))
    return loans.select("id", "good_bad", S.bad_label("good_bad").alias("bad_label"),
                        S.good_indicator("good_bad").alias("good_indicator"))


@query("normalise_text", sql_on("titles", "loan_text_gaps", body="""
SELECT 't' || id AS id, lower(trim(emp_title)) AS tidy FROM titles UNION ALL
SELECT 'd' || id, CASE WHEN desc_ IS NULL OR trim(desc_) = '' THEN 'missing' ELSE lower(trim(desc_)) END FROM loan_text_gaps"""))
def normalise_text(spark, d):
    jobs = V.titles(spark, d).select(
        F.concat(F.lit("t"), F.col("id")).alias("id"), S.normalise("emp_title").alias("tidy"))
    texts = V.loan_text_gaps(spark, d).select(
        F.concat(F.lit("d"), F.col("id")).alias("id"), S.normalise("desc_", "missing").alias("tidy"))
    return jobs.unionByName(texts)


@query("recode_map", sql_on("loan_book", body="""
SELECT id, CASE grade WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'top' WHEN '3-MEDIUM' THEN 'mid' END AS grade_group,
  CASE WHEN purpose IN ('AUTOMOBILE', 'BUILDING') THEN purpose ELSE 'AUTOMOBILE' END AS purpose_known
FROM loan_book"""))
def recode_map(spark, d):
    mapping = {"1-URGENT": "top", "2-HIGH": "top", "3-MEDIUM": "mid"}
    return V.loan_book(spark, d, "id", "grade", "purpose").select(
        "id", S.recode("grade", mapping).alias("grade_group"),
        S.known_or(F.col("purpose"), ["AUTOMOBILE", "BUILDING"], "AUTOMOBILE").alias("purpose_known"))


@query("sanitise_names", sql_on("loan_book", body="""
SELECT DISTINCT v AS raw,
  replace(regexp_replace(replace(v, ' ', ''), '[/.:]', '_', 'g'), '%', 'pct') AS suffix,
  regexp_replace(regexp_replace(v, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS plain
FROM (SELECT grade AS v FROM loan_book UNION ALL SELECT addr_state FROM loan_book UNION ALL
      SELECT url FROM pages) t"""))
def sanitise_names(spark, d):
    values = V.loan_book(spark, d, "grade").unionAll(V.loan_book(spark, d, "addr_state")).unionAll(
        V.table(spark, d, "pages").select("url")).distinct()
    raw = F.col("grade")
    return values.select(raw.alias("raw"), N.indicator_suffix_col(raw).alias("suffix"),
                         N.plain_name_col(raw).alias("plain"))


@query("clamp", sql_on("loan_book", body="""
SELECT id, CASE WHEN dti IS NULL THEN NULL ELSE greatest(0.0, least(5000.0, dti)) END AS dti_clamped FROM loan_book"""))
def clamp(spark, d):
    return V.loan_book(spark, d, "id", "dti").select("id", S.clamp("dti", 0.0, 5000.0).alias("dti_clamped"))


@query("fill_nulls", sql_on("loan_book", body="""
SELECT id, COALESCE(dti, funded_amnt) AS dti_from, COALESCE(int_rate, 0.0) AS int_rate,
  COALESCE(purpose, 'MISSING') AS purpose, COALESCE(dti, -1.0) AS dti
FROM loan_book"""))
def fill_nulls(spark, d):
    loans = V.loan_book(spark, d, "id", "dti", "funded_amnt", "int_rate", "purpose").withColumn(
        "dti_from", F.col("dti"))
    filled = P.fill_zero(P.fill_from(loans, "dti_from", "funded_amnt"), ["int_rate", "absent"])
    return P.fill_by_type(filled, -1.0, "MISSING", skip=["id"]).drop("funded_amnt")


@query("split_columns_by_type", sql_on("loan_book", body="""
SELECT 'number' AS kind, 'id' AS name, COUNT(id) AS filled FROM loan_book UNION ALL SELECT 'number', 'good_bad', COUNT(good_bad) FROM loan_book UNION ALL
SELECT 'number', 'funded_amnt', COUNT(funded_amnt) FROM loan_book UNION ALL SELECT 'number', 'dti', COUNT(dti) FROM loan_book UNION ALL
SELECT 'other', 'grade', COUNT(grade) FROM loan_book UNION ALL SELECT 'other', 'purpose', COUNT(purpose) FROM loan_book UNION ALL
SELECT 'integer', 'good_bad', COUNT(good_bad) FROM loan_book"""))
def split_columns_by_type(spark, d):
    """Columns by type with their number of filled rows."""
    loans = V.loan_book(spark, d, "id", "good_bad", "grade", "purpose", "funded_amnt", "dti")
    numbers, others = P.split_columns(loans)
    named = [("number", n) for n in numbers] + [("other", n) for n in others]
    named += [("integer", n) for n in P.integer_columns(loans, exclude=["id"])]
    filled = loans.agg(*[F.count(c).alias(c) for c in loans.columns])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(n).alias("filled")) for k, n in named])
    return filled.select(F.inline(rows))


@query("drop_by_suffix", sql_on("loan_book", body="SELECT id, good_bad, funded_amnt FROM loan_book"))
def drop_by_suffix(spark, d):
    loans = V.loan_book(spark, d, "id", "good_bad", "funded_amnt", "grade", "purpose").withColumns(
        {"grade_grp": F.col("grade"), "grade_woe": F.lit(0.0)})
    return P.drop_matching(loans, ["_grp", "_woe", "__base_grp"], ["grade", "purpose"])


@query("fit_dummies", sql_on("loan_book", body="""
WITH c AS (
  SELECT 'grade' AS "column", grade AS value, COUNT(*) AS "count" FROM loan_book WHERE grade IS NOT NULL GROUP BY grade
  UNION ALL SELECT 'purpose', purpose, COUNT(*) FROM loan_book WHERE purpose IS NOT NULL GROUP BY purpose
  UNION ALL SELECT 'addr_state', addr_state, COUNT(*) FROM loan_book WHERE addr_state IS NOT NULL GROUP BY addr_state)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS INTEGER) AS rank FROM c)
WHERE rank <= 4"""))
def fit_dummies(spark, d):
    return P.fit_dummies(V.loan_book(spark, d, "grade", "purpose", "addr_state"),
                         ["grade", "purpose", "addr_state"], 4)


@query("apply_dummies", sql_on("loan_book", body="""
SELECT id, CASE WHEN loan_status = 'O' THEN 1 ELSE 0 END AS "loan_status:O",
  CASE WHEN loan_status = 'F' THEN 1 ELSE 0 END AS "loan_status:F",
  CASE WHEN loan_status = 'P' THEN 1 ELSE 0 END AS "loan_status:P" FROM loan_book"""))
def apply_dummies(spark, d):
    loans = V.loan_book(spark, d, "id", "loan_status")
    return P.with_dummies(loans, P.dummy_spec(P.fit_dummies(loans, ["loan_status"]))).drop("loan_status")


@query("sentence_count", sql_on("loan_text", body="""
SELECT id, CAST(len(regexp_split_to_array(desc_, '[.!?]+')) AS INTEGER) AS n_sentences FROM loan_text"""))
def sentence_count(spark, d):
    return V.loan_text(spark, d).select("id", X.sentence_count("desc_").alias("n_sentences"))


# --- joins ------------------------------------------------------------------------

@query("join_inner_on_id", sql_on("loan_book", "loan_text", body="""
SELECT b.id, b.good_bad, b.funded_amnt, t.title FROM loan_book b JOIN loan_text t ON b.id = t.id"""))
def join_inner_on_id(spark, d):
    return V.loan_book(spark, d, "id", "good_bad", "funded_amnt").join(
        V.loan_text(spark, d).select("id", "title"), "id")


@query("join_left_chain", sql_on("loan_book", "loan_text", "titles", body="""
SELECT b.id, t.title, e.emp_title, l.toxic FROM loan_book b
LEFT JOIN loan_text t ON b.id = t.id LEFT JOIN titles e ON b.id = e.id LEFT JOIN labels l ON b.id = l.doc_id"""))
def join_left_chain(spark, d):
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return (V.loan_book(spark, d, "id")
            .join(V.loan_text(spark, d).select("id", "title"), "id", "left")
            .join(V.titles(spark, d).select("id", "emp_title"), "id", "left")
            .join(labels, "id", "left"))


@query("join_one_row_constants", sql_on("loan_book", body="""
SELECT id, COALESCE(dti, z.zero_dti) AS dti, COALESCE(purpose, z.no_purpose) AS purpose
FROM loan_book CROSS JOIN (SELECT AVG(funded_amnt) * 0 AS zero_dti, MIN(purpose) AS no_purpose FROM loan_book) z"""))
def join_one_row_constants(spark, d):
    loans = V.loan_book(spark, d, "id", "dti", "purpose", "funded_amnt")
    row = loans.agg(F.struct((F.avg("funded_amnt") * 0).alias("dti"), F.min("purpose").alias("purpose"))).scalar()
    return loans.select("id", F.coalesce("dti", row["dti"]).alias("dti"),
                        F.coalesce("purpose", row["purpose"]).alias("purpose"))


@query("restrict_to_ids", sql_on("loan_book", "loan_text_gaps", body="""
SELECT id, good_bad, funded_amnt FROM loan_book WHERE id IN (SELECT id FROM loan_text_gaps WHERE desc_ IS NOT NULL AND desc_ <> '')"""))
def restrict_to_ids(spark, d):
    return P.restrict_to(V.loan_book(spark, d, "id", "good_bad", "funded_amnt"),
                         X.text_present(V.loan_text_gaps(spark, d), "desc_"))


# --- aggregations -----------------------------------------------------------------

@query("group_counts", sql_on("loan_book", body="""
SELECT loan_status, good_bad, COUNT(*) AS "count" FROM loan_book GROUP BY loan_status, good_bad"""))
def group_counts(spark, d):
    return E.group_counts(V.loan_book(spark, d, "loan_status", "good_bad", "grade", "funded_amnt"),
                          "loan_status", "good_bad")


@query("column_profile_exact", sql_on("loan_book", body="""
WITH v AS (SELECT 'funded_amnt' AS "column", funded_amnt AS x FROM loan_book UNION ALL
  SELECT 'dti', dti FROM loan_book UNION ALL SELECT 'open_acc', CAST(open_acc AS DOUBLE) FROM loan_book UNION ALL
  SELECT 'int_rate', int_rate FROM loan_book)
SELECT "column", COUNT(x) AS "count", ROUND(AVG(x), 6) AS mean, MIN(x) AS "min", MAX(x) AS "max",
  ROUND(quantile_cont(x, 0.01), 6) AS p1, ROUND(quantile_cont(x, 0.25), 6) AS p25, ROUND(quantile_cont(x, 0.5), 6) AS p50,
  ROUND(quantile_cont(x, 0.75), 6) AS p75, ROUND(quantile_cont(x, 0.99), 6) AS p99
FROM v WHERE x IS NOT NULL GROUP BY "column" """).replace("MIN(x)", "ROUND(MIN(x), 6)").replace("MAX(x)", "ROUND(MAX(x), 6)"))
def column_profile_exact(spark, d):
    cols = ["funded_amnt", "dti", "open_acc", "int_rate"]
    profile = E.column_profile(V.loan_book(spark, d, *cols), cols, exact=True)
    return profile.select("column", "count", *[r(c).alias(c) for c in profile.columns[2:]])


@query("column_profile")
def column_profile(spark, d):
    cols = ["funded_amnt", "dti", "open_acc", "int_rate"]
    return E.column_profile(V.loan_book(spark, d, *cols), cols)


@query("missing_summary", sql_on("loan_book", body="""
WITH t AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(purpose) AS purpose, COUNT(*) - COUNT(dti) AS dti,
  COUNT(*) - COUNT(int_rate) AS int_rate, COUNT(*) - COUNT(grade) AS grade FROM loan_book)
SELECT * FROM (
  SELECT 'purpose' AS "column", purpose AS missing_count, ROUND(purpose / n, 6) AS missing_ratio FROM t UNION ALL
  SELECT 'dti', dti, ROUND(dti / n, 6) FROM t UNION ALL SELECT 'int_rate', int_rate, ROUND(int_rate / n, 6) FROM t UNION ALL
  SELECT 'grade', grade, ROUND(grade / n, 6) FROM t) WHERE missing_count > 0"""))
def missing_summary(spark, d):
    loans = V.loan_book(spark, d, "purpose", "dti", "int_rate", "grade")
    return E.missing_summary(loans).withColumn("missing_ratio", r("missing_ratio"))


@query("null_counts", sql_on("loan_book", body="""
SELECT COUNT(*) - COUNT(dti) AS dti, COUNT(*) - COUNT(purpose) AS purpose, COUNT(*) - COUNT(grade) AS grade FROM loan_book"""))
def null_counts(spark, d):
    return E.null_counts(V.loan_book(spark, d, "dti", "purpose", "grade"), ["dti", "purpose", "grade", "absent"])


@query("blank_rates", sql_on("loan_text_gaps", body="""
SELECT 'desc_' AS "column", COUNT(*) FILTER (WHERE desc_ IS NULL OR desc_ = '') AS missing, COUNT(*) AS total,
  ROUND(COUNT(*) FILTER (WHERE desc_ IS NULL OR desc_ = '') / COUNT(*), 6) AS missing_rate FROM loan_text_gaps UNION ALL
SELECT 'title', COUNT(*) FILTER (WHERE title IS NULL OR title = ''), COUNT(*),
  ROUND(COUNT(*) FILTER (WHERE title IS NULL OR title = '') / COUNT(*), 6) FROM loan_text_gaps"""))
def blank_rates(spark, d):
    return E.blank_rates(V.loan_text_gaps(spark, d), ["desc_", "title"]).withColumn("missing_rate", r("missing_rate"))


@query("impute_mean", sql_on("loan_book", body="""
SELECT id, ROUND(COALESCE(dti, (SELECT AVG(dti) FROM loan_book
    WHERE ((id % 2147483647) * 48271 % 2147483647) % 1000 < 800)), 6) AS dti FROM loan_book"""))
def impute_mean(spark, d):
    loans = V.loan_book(spark, d, "id", "dti")
    train, _ = P.stable_split(loans)
    return P.fill_values(loans, E.fit_means(train, ["dti"])).withColumn("dti", r("dti"))


@query("impute_median", sql_on("loan_book", body="""
SELECT id, ROUND(COALESCE(dti, (SELECT quantile_cont(dti, 0.5) FROM loan_book
    WHERE ((id % 2147483647) * 48271 % 2147483647) % 1000 < 800)), 6) AS dti FROM loan_book"""))
def impute_median(spark, d):
    loans = V.loan_book(spark, d, "id", "dti")
    train, _ = P.stable_split(loans)
    return P.fill_values(loans, E.fit_medians(train, ["dti"], exact=True)).withColumn("dti", r("dti"))


@query("default_rate_overall", sql_on("loan_book", body="""
SELECT COUNT(*) AS "count", ROUND(1 - AVG(good_bad), 6) AS default_rate FROM loan_book"""))
def default_rate_overall(spark, d):
    return E.default_rates(V.loan_book(spark, d, "good_bad")).withColumn("default_rate", r("default_rate"))


@query("default_rate_by_group", sql_on("loan_book", body="""
SELECT purpose, COUNT(*) AS "count", ROUND(1 - AVG(good_bad), 6) AS default_rate FROM loan_book GROUP BY purpose"""))
def default_rate_by_group(spark, d):
    return E.default_rates(V.loan_book(spark, d, "purpose", "good_bad"), "purpose").withColumn(
        "default_rate", r("default_rate"))


@query("class_mean_gap", sql_on("loan_book", body="""
WITH f AS (
  SELECT good_bad, CASE WHEN grade = '1-URGENT' THEN 1 ELSE 0 END AS grade_1, CASE WHEN grade = '5-LOW' THEN 1 ELSE 0 END AS grade_5,
    CASE WHEN purpose = 'MACHINERY' THEN 1 ELSE 0 END AS machinery, dti FROM loan_book),
u AS (SELECT good_bad, 'grade_1' AS feature, grade_1 AS v FROM f UNION ALL SELECT good_bad, 'grade_5', grade_5 FROM f UNION ALL
  SELECT good_bad, 'machinery', machinery FROM f UNION ALL SELECT good_bad, 'dti', dti FROM f),
m AS (SELECT feature, AVG(CASE WHEN good_bad = 0 THEN v END) AS b, AVG(CASE WHEN good_bad = 1 THEN v END) AS g FROM u GROUP BY feature)
SELECT feature, ROUND(b, 5) AS mean_bad, ROUND(g, 5) AS mean_good, ROUND(ABS(b - g), 5) AS gap FROM m ORDER BY ABS(b - g) DESC LIMIT 3"""))
def class_mean_gap(spark, d):
    loans = V.loan_book(spark, d, "good_bad", "grade", "purpose", "dti").select(
        "good_bad", F.when(F.col("grade") == "1-URGENT", 1).otherwise(0).alias("grade_1"),
        F.when(F.col("grade") == "5-LOW", 1).otherwise(0).alias("grade_5"),
        F.when(F.col("purpose") == "MACHINERY", 1).otherwise(0).alias("machinery"), "dti")
    gaps = E.class_mean_gap(loans, ["grade_1", "grade_5", "machinery", "dti"], top=3)
    return gaps.select("feature", *[r(c, 5).alias(c) for c in ("mean_bad", "mean_good", "gap")])


@query("distinct_values", sql_on("loan_book", body="SELECT DISTINCT purpose FROM loan_book"))
def distinct_values(spark, d):
    return E.distinct_values(V.loan_book(spark, d, "purpose"), "purpose")


@query("distinct_counts", sql_on("loan_book", body="""
SELECT 'id' AS "column", COUNT(DISTINCT id) AS n_distinct FROM loan_book UNION ALL
SELECT 'purpose', COUNT(DISTINCT purpose) FROM loan_book UNION ALL SELECT 'open_acc', COUNT(DISTINCT open_acc) FROM loan_book"""))
def distinct_counts(spark, d):
    return E.distinct_counts(V.loan_book(spark, d, "id", "purpose", "open_acc"), ["id", "purpose", "open_acc"])


@query("summary_sentences", sql_on("loan_text", body="""
WITH s AS (SELECT CAST(len(regexp_split_to_array(desc_, '[.!?]+')) AS DOUBLE) AS n FROM loan_text WHERE desc_ IS NOT NULL AND desc_ <> '')
SELECT 'n_sentences' AS "column", COUNT(n) AS "count", ROUND(AVG(n), 6) AS mean, ROUND(quantile_cont(n, 0.5), 6) AS p50,
  ROUND(quantile_cont(n, 0.75), 6) AS p75, ROUND(quantile_cont(n, 0.9), 6) AS p90, ROUND(quantile_cont(n, 0.95), 6) AS p95,
  MAX(n) AS "max" FROM s"""))
def summary_sentences(spark, d):
    texts = X.text_present(V.loan_text(spark, d), "desc_")
    s = E.summarise(texts, X.sentence_count("desc_"), "n_sentences", exact=True)
    return s.select("column", "count", *[r(c).alias(c) for c in ("mean", "p50", "p75", "p90", "p95")], "max")


@query("class_weights", sql_on("loan_book", body="""
SELECT good_bad, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM loan_book) / (2.0 * COUNT(*)), 6) AS weight
FROM loan_book GROUP BY good_bad"""))
def class_weights(spark, d):
    return E.class_weights(V.loan_book(spark, d, "good_bad"), "good_bad").withColumn("weight", r("weight"))


# --- windows, sort, top-k, set operations ------------------------------------------

@query("frame_maximum", sql_on("loan_book", body="""
SELECT id, ROUND((SELECT MAX(dti) FROM loan_book WHERE dti >= 0) - dti, 6) AS below_max FROM loan_book"""))
def frame_maximum(spark, d):
    loans = V.loan_book(spark, d, "id", "dti")
    top = loans.agg(F.max(F.when(F.col("dti") >= 0, F.col("dti")))).scalar()
    return loans.select("id", r(top - F.col("dti")).alias("below_max"))


@query("sort_one_key", sql_on("loan_book", body="SELECT id, funded_amnt FROM loan_book ORDER BY funded_amnt DESC, id"))
def sort_one_key(spark, d):
    return V.loan_book(spark, d, "id", "funded_amnt").orderBy(F.desc("funded_amnt"), "id")


@query("top_k_by_count", sql_on("titles", body="""
SELECT lower(trim(emp_title)) AS value, COUNT(*) AS "count" FROM titles WHERE emp_title IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def top_k_by_count(spark, d):
    return X.top_values(V.titles(spark, d).select(S.normalise("emp_title").alias("value")), "value", 20)


@query("top_k_by_absolute", sql_on("loan_book", body="""
SELECT id, dti FROM loan_book WHERE dti IS NOT NULL ORDER BY ABS(dti) DESC, id LIMIT 25"""))
def top_k_by_absolute(spark, d):
    return (V.loan_book(spark, d, "id", "dti").where("dti IS NOT NULL")
            .orderBy(F.desc(F.abs("dti")), "id").limit(25))


@query("union_distinct_ids", sql_on("loan_book", "loan_text_gaps", body="""
SELECT id FROM loan_book UNION SELECT id FROM loan_text_gaps WHERE desc_ IS NOT NULL"""))
def union_distinct_ids(spark, d):
    return P.id_union(V.loan_book(spark, d, "id"), V.loan_text_gaps(spark, d).where("desc_ IS NOT NULL"))


@query("union_by_name", sql_on("loan_book", "loan_text", body="""
SELECT id, good_bad, grade, NULL AS title FROM loan_book UNION ALL SELECT id, good_bad, NULL, title FROM loan_text"""))
def union_by_name(spark, d):
    return P.stack_frames(V.loan_book(spark, d, "id", "good_bad", "grade"),
                          V.loan_text(spark, d).select("id", "good_bad", "title"))


# --- splits --------------------------------------------------------------------------

@query("stable_split", sql_on("loan_book", body="""
SELECT CASE WHEN ((id % 2147483647) * 48271 % 2147483647) % 1000 < 800 THEN 'train' ELSE 'test' END AS part,
  id, good_bad FROM loan_book"""))
def stable_split(spark, d):
    train, test = P.stable_split(V.loan_book(spark, d, "id", "good_bad"))
    P.check_same_columns(train, test)
    return train.select(F.lit("train").alias("part"), "*").union(test.select(F.lit("test").alias("part"), "*"))


@query("random_split", sql_on("loan_book", body="""
SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, CAST(SUM(1 - good_bad) AS BIGINT) AS defaults, TRUE AS share_as_wanted FROM loan_book"""))
def random_split(spark, d):
    """Both parts together: every loan once, and 80% of them (within 5 standard deviations) in the first."""
    train, test = P.random_split(V.loan_book(spark, d, "id", "good_bad"))
    parts = train.select(F.lit(1).alias("first"), "*").union(test.select(F.lit(0).alias("first"), "*"))
    return parts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
                     F.sum(1 - F.col("good_bad")).cast("long").alias("defaults"),
                     # A share of n draws has variance 0.8 * 0.2 / n.
                     (F.pow(F.avg("first") - 0.8, 2) * F.count(F.lit(1)) < 25 * 0.8 * 0.2).alias("share_as_wanted"))


@query("text_present_split", sql_on("loan_text_gaps", body="""
SELECT CASE WHEN ((id % 2147483647) * 48271 % 2147483647) % 1000 < 800 THEN 'train' ELSE 'test' END AS part,
  COUNT(*) AS n, CAST(SUM(1 - good_bad) AS BIGINT) AS defaults
FROM loan_text_gaps WHERE desc_ IS NOT NULL AND desc_ <> '' GROUP BY 1"""))
def text_present_split(spark, d):
    """Ids with text over train and test, kept by a semi join and split again.

    The flag is written once, so the texts are read once.
    """
    flagged = V.loan_text_gaps(spark, d).select("id", "good_bad", S.missing_flag("desc_").alias("desc_missing"))
    train, test = P.stable_split(cut_lineage(flagged, "text-flags"), train=0.5)
    ids = P.id_union(train.where("desc_missing = 0"), test.where("desc_missing = 0"))
    kept = P.restrict_to(P.stack_frames(train, test), ids)
    again = P.stable_split(kept)
    parts = [part.select(F.lit(name).alias("part"), "good_bad") for name, part in zip(("train", "test"), again)]
    return P.stack_frames(*parts).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("good_bad")).alias("defaults"))
