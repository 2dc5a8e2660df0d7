"""Raw loan book to prepared train and test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creditloom import constants as K
from creditloom.functions import scalars as S
from creditloom.operators import prep as P
from creditloom.operators import profile as E


def derive(df: DataFrame, fit_on: DataFrame, reference: str = K.REFERENCE_DATE,
           fmt: str = K.MONTH_FORMAT) -> DataFrame:
    """Whole numbers from texts and month offsets from dates, where the columns exist."""
    if "emp_length" in df.columns:
        df = P.with_first_integer(df, "emp_length", "emp_length_int", {"< 1 year": 0})
    if "term" in df.columns:
        df = P.with_first_integer(df, "term", "term_int")
    for source, target in (("earliest_cr_line", "mths_since_earliest_cr_line"),
                           ("issue_d", "mths_since_issue_d")):
        if source in df.columns:
            as_text = dict(df.dtypes)[source] == "string"
            df = P.with_months_since(df, source, target, reference=reference,
                                     fmt=fmt if as_text else None, fit_on=fit_on)
    return df


def prepare(train: DataFrame, test: DataFrame, *, status: str = "loan_status",
            default_statuses=K.DEFAULT_STATUSES) -> tuple[DataFrame, DataFrame]:
    """Derived columns, training-fitted fills and the binary target for both parts."""
    raw_train = train
    train, test = (derive(part, fit_on=raw_train) for part in (train, test))
    fills: dict[str, float] = {}
    if "annual_inc" in train.columns:
        fills.update(E.fit_medians(train, ["annual_inc"]))
    if "funded_amnt" in train.columns:
        fills.update(E.fit_means(train, ["funded_amnt"]))

    def finish(part: DataFrame) -> DataFrame:
        part = P.fill_values(part, fills)
        if {"total_rev_hi_lim", "funded_amnt"} <= set(part.columns):
            part = P.fill_from(part, "total_rev_hi_lim", "funded_amnt")
        part = P.fill_zero(part, K.ZERO_FILLED)
        if status in part.columns and "good_bad" not in part.columns:
            part = part.withColumn("good_bad", S.good_bad(status, default_statuses))
        return part

    return finish(train), finish(test)
