import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import names as N
from creditloom.functions import scalars as S
from creditloom.operators import prep as P
from creditloom.operators import profile as E


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def results(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_first_integer(spark):
    df = column(spark, ["10+ years", "< 1 year", "n/a", " 36 months", None])
    assert results(df, S.first_integer("v", {"< 1 year": 0})) == [10, 0, None, 36, None]
    assert results(df, S.first_integer("v")) == [10, 1, None, 36, None]


def test_parse_number(spark):
    df = column(spark, ["13.5%", "1,000", "1.2E7", "  -3 ", ".5", "NA", "", "abc", None])
    assert results(df, S.parse_number("v")) == [13.5, 1000.0, 1.2e7, -3.0, 0.5, None, None, None, None]


def test_numeric_columns_are_not_read_as_text(spark):
    df = column(spark, [12345678.0, 0.0005, float("nan"), None, math.inf], "double")
    assert results(df, S.numeric(df, "v")) == [12345678.0, 0.0005, None, None, math.inf]


def test_months_and_negative_offsets(spark):
    df = column(spark, ["Dec-2015", "Dec-2018", "Jan-2019", "rubbish", None])
    out = P.with_months_since(df, "v", "m", reference="2018-12-01")
    assert [r["m"] for r in out.collect()] == [36, 0, 36, None, None]
    other = column(spark, ["Dec-2008"])
    out = P.with_months_since(df, "v", "m", reference="2018-12-01", fit_on=other)
    assert [r["m"] for r in out.collect()] == [36, 0, 120, None, None]
    dates = column(spark, [dt.date(2018, 11, 1)], "date")
    assert P.with_months_since(dates, "v", "m", fmt=None).first()["m"] == 1


def test_good_bad_counts_null_as_good(spark):
    df = column(spark, [*K.DEFAULT_STATUSES, "Current", None])
    assert results(df, S.good_bad("v")) == [0, 0, 0, 0, 1, 1]
    assert results(df.withColumn("t", S.good_bad("v")), S.bad_label("t"))[:5] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_recode_clamp_and_blank(spark):
    df = column(spark, ["a", "b", " ", None])
    assert results(df, S.recode("v", {"a": 1})) == [1, None, None, None]
    assert results(df, S.missing_flag("v")) == [0, 0, 1, 1]
    assert results(df, S.normalise("v", "missing")) == ["a", "b", "missing", "missing"]
    assert results(df, S.base_class("v")) == ["a", "b", " ", "MISSING"]
    nums = column(spark, [-1.0, 0.4, 7.0, None], "double")
    assert results(nums, S.clamp("v", 0.0, 1.0)) == [0.0, 0.4, 1.0, None]


def test_loss_targets(spark):
    df = spark.createDataFrame([(100.0, 40.0), (100.0, 150.0), (0.0, 5.0)], "funded_amnt double, total_rec_prncp double")
    rows = df.select(*[c.alias(n) for n, c in S.loss_targets().items()]).collect()
    assert [tuple(r) for r in rows] == [(0.4, 0.4, 0.6, 40.0), (1.5, 1.0, 0.001, 100.0), (0.0, 0.0, 0.999, 0.0)]


@pytest.mark.parametrize("label,suffix,plain", [
    ("A B/C.D:5%", "AB_C_D_5pct", "A_B_C_D_5"), ("(0, 1]", "(0,1]", "0_1"), ("__x", "__x", "x"),
])
def test_names(spark, label, suffix, plain):
    assert N.indicator_suffix(label) == suffix
    assert N.plain_name(label) == plain
    df = column(spark, [label])
    assert df.select(N.indicator_suffix_col(F.col("v")), N.plain_name_col(F.col("v"))).first() == (suffix, plain)


def test_unique_names():
    assert N.unique_names(["a", "b", "a"]) == ["a", "b", "a_2"]


def test_large_ids_do_not_overflow(spark):
    df = column(spark, [2**62, 2**63 - 1, 0], "long")
    assert all(0 <= v < 1000 for v in results(df, S.bucket_of_id("v")))


def test_stable_split_covers_every_row_once(spark):
    df = spark.range(5000)
    train, test = P.stable_split(df)
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 0.75 < train.count() / 5000 < 0.85
    texts = df.select(F.col("id").cast("string").alias("id"))
    a, b = P.stable_split(texts)
    assert a.count() + b.count() == 5000


def test_fills_and_types(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, "x")], "id int, n double, s string")
    assert P.split_columns(df) == (["id", "n"], ["s"])
    assert P.integer_columns(df, exclude=[]) == ["id"]
    filled = P.fill_by_type(df, -1.0, "MISSING", skip=["id"]).orderBy("id").collect()
    assert tuple(filled[0]) == (1, -1.0, "MISSING")
    with pytest.raises(ValueError):
        P.check_same_columns(df, df.drop("s"))


def test_dummies(spark):
    df = column(spark, ["a b", "a b", "c", None])
    spec = P.dummy_spec(P.fit_dummies(df, ["v", "absent"], 60))
    assert spec == {"v": ["a b", "c"]}
    out = P.with_dummies(df, spec)
    assert out.columns == ["v", "v:a_b", "v:c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (1, 0), (0, 1), (0, 0)]


def test_missing_summary_and_imputers(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 2.0)], "a double, b double")
    rows = [tuple(r) for r in E.missing_summary(df).collect()]
    assert rows == [("b", 2, pytest.approx(2 / 3)), ("a", 1, pytest.approx(1 / 3))]
    assert E.fit_means(df, ["a"]) == {"a": 2.0}
    assert E.fit_medians(df, ["a"], exact=True) == {"a": 2.0}
    assert E.fit_medians(df, ["a"]) == {"a": 1.0}
    assert E.null_counts(df, ["a", "b", "zz"]).first() == (1, 2)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert E.fit_means(df, ["a"]) == {}
    assert P.fill_values(df, E.fit_means(df, ["a"])).count() == 2
