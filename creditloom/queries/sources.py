"""Source and sink queries: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import woe as W
from creditloom.plans import views as V
from creditloom.queries.binning import DISCRETE_COUNTS, WOE_COLUMNS, discrete_counts, rounded
from creditloom.queries.registry import query, sql_on
from creditloom.session import new_path
from creditloom.sources import files as A

LOAN_SCHEMA = "id long, good_bad int, grade string, purpose string, funded_amnt double, dti double"
LOANS_SQL = sql_on("loan_book", body="SELECT id, good_bad, grade, purpose, funded_amnt, dti FROM loan_book")


def loans(spark, d):
    return V.loan_book(spark, d, "id", "good_bad", "grade", "purpose", "funded_amnt", "dti")


@query("csv_scan_multiline", """
SELECT doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS text, lang FROM documents""")
def csv_scan_multiline(spark, d):
    """Texts with line breaks and quotes through a quoted CSV and back."""
    path = new_path(spark, "documents-csv")
    docs = V.table(spark, d, "documents").select("doc_id", "text", "lang")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    return A.read_loan_csv(spark, path, "doc_id long, text string, lang string")


@query("csv_scan_plain", LOANS_SQL)
def csv_scan_plain(spark, d):
    path = new_path(spark, "loans-csv")
    A.write_csv(loans(spark, d), path)
    return A.read_csv(spark, path, schema=LOAN_SCHEMA)


@query("csv_scan_inferred", LOANS_SQL)
def csv_scan_inferred(spark, d):
    path = new_path(spark, "loans-csv")
    A.write_csv(loans(spark, d), path)
    return A.read_csv(spark, path)


@query("csv_scan_gzip", LOANS_SQL)
def csv_scan_gzip(spark, d):
    path = new_path(spark, "loans-gz")
    loans(spark, d).write.options(header=True, compression="gzip").csv(path)
    return A.read_compressed_csv(spark, path, LOAN_SCHEMA, partitions=8)


@query("csv_to_parquet", LOANS_SQL)
def csv_to_parquet(spark, d):
    csv, parquet = new_path(spark, "loans-csv"), new_path(spark, "loans-parquet")
    A.write_csv(loans(spark, d), csv)
    return A.csv_to_parquet(spark, csv, parquet, schema=LOAN_SCHEMA)


@query("parquet_scan_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def parquet_scan_pruned(spark, d):
    return A.read_parquet(spark, f"{d}/orders.parquet", "o_orderkey", "o_totalprice").where("o_totalprice > 250000")


@query("parquet_sink", LOANS_SQL)
def parquet_sink(spark, d):
    path = new_path(spark, "loans")
    A.write_parquet(loans(spark, d), path)
    return A.read_parquet(spark, path)


@query("keyed_sink", sql_on("loan_book", body="""
SELECT CASE WHEN ((id % 2147483647) * 48271 % 2147483647) % 1000 < 800 THEN 'train' ELSE 'test' END AS part,
  COUNT(*) AS rows FROM loan_book GROUP BY 1"""))
def keyed_sink(spark, d):
    """Train and test written by key; every file then holds whole keys."""
    from creditloom.operators.prep import stable_split
    parts = []
    for name, part, files in zip(("train", "test"), stable_split(loans(spark, d)), (40, 10)):
        path = new_path(spark, f"keyed-{name}")
        A.write_parquet(part, path, key="id", partitions=files)
        written = A.file_count(A.read_parquet(spark, path))
        parts.append(written.where(F.col("files") <= files).select(F.lit(name).alias("part"), "rows"))
    return parts[0].union(parts[1])


@query("report_sink", sql_on("loan_book", body=f"""
WITH counts AS ({DISCRETE_COUNTS}), {WOE_COLUMNS.format(order='woe, bin')}
SELECT feature, bin, n_obs, ROUND(woe, 6) AS woe FROM report"""))
def report_sink(spark, d):
    path = new_path(spark, "reports")
    A.write_reports(rounded(W.woe_table(discrete_counts(spark, d))).select("feature", "bin", "n_obs", "woe"), path)
    return A.read_csv(spark, path, schema="bin string, n_obs long, woe double, feature string").select(
        "feature", "bin", "n_obs", "woe")


@query("json_sink", "SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang")
def json_sink(spark, d):
    path = new_path(spark, "languages-json")
    A.write_json(V.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("lang string, n long").json(path)


@query("literal_rows", sql_on("loan_book", body="""
SELECT b.id, m.level FROM loan_book b JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) m(grade, level) ON b.grade = m.grade"""))
def literal_rows(spark, d):
    levels = A.literal_rows(spark, [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)], "grade string, level int")
    return V.loan_book(spark, d, "id", "grade").join(F.broadcast(levels), "grade").select("id", "level")


@query("sample_rows")
def sample_rows(spark, d):
    return A.sample_rows(loans(spark, d), 0.1)
