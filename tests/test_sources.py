import gzip

import pytest

from creditloom.sources import files as A

CSV = 'id,desc,amount\n1,"two\nlines, ""quoted""",5.5\n2,,bad\n'


def test_multiline_quotes_and_bad_fields(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(CSV)
    rows = A.read_loan_csv(spark, str(path), "id int, desc string, amount double").orderBy("id").collect()
    assert rows[0]["desc"] == 'two\nlines, "quoted"' and rows[0]["amount"] == 5.5
    assert rows[1]["desc"] is None and rows[1]["amount"] is None
    assert A.read_loan_csv(spark, str(path)).count() == 2


def test_gzip_is_read_as_it_is(spark, tmp_path):
    with gzip.open(tmp_path / "loans.csv.gz", "wt") as f:
        f.write(CSV)
    df = A.read_compressed_csv(spark, str(tmp_path), "id int, desc string, amount double", partitions=3)
    assert df.count() == 2


def test_keyed_write_puts_a_key_in_one_file(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.range(200).select((F.col("id") % 20).alias("id"))
    A.write_parquet(df, str(tmp_path / "k"), key="id", partitions=6)
    placed = A.read_parquet(spark, str(tmp_path / "k")).select("id", F.input_file_name().alias("file"))
    spread = placed.groupBy("id").agg(F.count_distinct("file").alias("f"))
    assert spread.where("f > 1").count() == 0 and spread.count() == 20


def test_reports_one_folder_per_feature(spark, tmp_path):
    df = A.literal_rows(spark, [("a", "x", 1.0), ("b", "y", 2.0)], "feature string, bin string, woe double")
    A.write_reports(df, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["feature=a", "feature=b"]


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    assert A.sample_rows(df, 0.1).collect() == A.sample_rows(df, 0.1).collect()


def test_pruned_scan_and_pushed_filter(spark, small):
    df = A.read_parquet(spark, f"{small}/orders.parquet", "o_orderkey", "o_totalprice").where("o_totalprice > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_custkey" not in plan


@pytest.mark.parametrize("header", [True, False])
def test_plain_csv(spark, tmp_path, header):
    path = tmp_path / "p.csv"
    path.write_text("1,2\n3,4\n")
    assert A.read_csv(spark, str(path), header=header).count() == (1 if header else 2)


def test_bucketed_tables_join_where_they_lie(spark):
    """No Exchange in the four-way merge, nor in the join of structured and text columns; the rows are those of plain tables."""
    from creditloom.operators import loss, models
    from creditloom.queries.loss import el_parts
    from creditloom.session import bucketed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = el_parts(spark, "/root/testdata/sf0.001")
        moved, lying = loss.expected_loss(*plain), loss.expected_loss(*[bucketed(p, "part", buckets=4) for p in plain])
        rows = sorted(map(str, lying.collect()))

        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        assert "Exchange" in plan(moved) and "Exchange" not in plan(lying) and "SortMergeJoin" in plan(lying)
        assert rows == sorted(map(str, moved.collect()))
        frame = models.variant_frame(bucketed(plain[0], "a", buckets=4), ["y_true"], bucketed(plain[2], "b", buckets=4), ["lgd_pred"], label="prob_default")
        assert "Exchange" not in plan(frame) and frame.count() == plain[0].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_with_null_keys_and_no_rows(spark):
    from creditloom.session import bucketed

    df = spark.createDataFrame([(None, "a"), (1, None), (1, "b")], "id long, v string")
    assert sorted(map(str, bucketed(df, "odd").collect())) == sorted(map(str, df.collect()))
    assert bucketed(df.where("false"), "none").count() == 0
