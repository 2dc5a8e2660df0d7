"""Column expressions for parsing, recoding, flags and loss targets.

Everything here is built from Spark's own functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import constants as K


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_integer(src: Column | str, overrides: Mapping[str, int] | None = None) -> Column:
    """First run of digits as an integer; exact texts in ``overrides`` win."""
    src = col_of(src)
    value = F.regexp_extract(src, r"(\d+)", 1).try_cast("int")
    if overrides:
        value = F.coalesce(recode(src, overrides), value)
    return value


def parse_number(src: Column | str) -> Column:
    """First number in a text such as ``"13.5%"`` or ``"1,000"``; else NULL."""
    text = F.trim(col_of(src).cast("string"))
    bare = F.regexp_replace(text, "[,%]", "")
    number = F.regexp_extract(bare, K.NUMBER_PATTERN, 0).try_cast("double")
    return F.when(~text.isin(K.NA_WORDS), number)


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double, NaN as NULL; only text is parsed as text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return parse_number(name)


def parse_date(src: Column | str, fmt: str) -> Column:
    """Date from text in ``fmt``; unreadable text gives NULL."""
    return F.try_to_timestamp(col_of(src), F.lit(fmt)).cast("date")


def months_since(date: Column | str, reference: str) -> Column:
    """Whole months from ``date`` to ``reference``; negative for later dates."""
    return F.floor(F.months_between(F.lit(reference).cast("date"), col_of(date))).cast("int")


def good_bad(status: Column | str, default_statuses=K.DEFAULT_STATUSES) -> Column:
    """1 = good, 0 = default. A NULL status is good."""
    bad = F.coalesce(col_of(status).isin(list(default_statuses)), F.lit(False))
    return F.when(bad, 0).otherwise(1)


def good_indicator(target: Column | str, good_value=1) -> Column:
    return F.when(col_of(target) == F.lit(good_value), 1).otherwise(0)


def bad_label(target: Column | str) -> Column:
    return (1 - col_of(target)).cast("double")


def is_blank(text: Column | str) -> Column:
    text = col_of(text)
    return text.isNull() | (F.trim(text) == "")


def missing_flag(text: Column | str) -> Column:
    return F.when(is_blank(text), 1).otherwise(0)


def normalise(text: Column | str, if_blank: str | None = None) -> Column:
    """Lower-case and trimmed; NULL or blank becomes ``if_blank`` when given."""
    text = col_of(text)
    tidy = F.lower(F.trim(text))
    return tidy if if_blank is None else F.when(is_blank(text), F.lit(if_blank)).otherwise(tidy)


def recode(src: Column | str, mapping: Mapping) -> Column:
    """Value of ``mapping`` for ``src``; NULL for an unknown key."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*pairs)[col_of(src)]


def base_class(src: Column | str, missing: str = K.MISSING) -> Column:
    """Discrete base class: the value as text, NULL as its own class."""
    return F.coalesce(col_of(src).cast("string"), F.lit(missing))


def known_or(src: Column, known: list[str], fallback: str) -> Column:
    """``src`` where it is one of ``known``, else ``fallback``."""
    return F.when(src.isin(list(known)), src).otherwise(F.lit(fallback))


def clamp(value: Column | str, low: float, high: float) -> Column:
    """``value`` held in ``[low, high]``; NULL stays NULL."""
    value = col_of(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def element(vector: Column | str, index: int) -> Column:
    """One entry of an ML vector column, without a Python function."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(col_of(vector))[index]


def loss_targets(funded: Column | str = "funded_amnt",
                 recovered: Column | str = "total_rec_prncp") -> dict[str, Column]:
    """Recovery rate, credit conversion factor, loss and exposure targets."""
    funded, recovered = col_of(funded), col_of(recovered)
    rate = F.when(funded > 0, recovered / funded).otherwise(0.0)
    ccf = clamp(rate, 0.0, 1.0)
    return {
        "recovery_rate": rate,
        "ccf": ccf,
        "lgd": clamp(1.0 - rate, 0.001, 0.999),
        "ead": funded * ccf,
    }


def bucket_of_id(id_col: Column | str, buckets: int = 1000) -> Column:
    """Repeatable bucket ``0 … buckets-1`` of an integer key.

    The multiplier works on the key modulo 2^31-1, so no product overflows.
    """
    prime = F.lit(2147483647).cast("long")
    return F.pmod(F.pmod(F.pmod(col_of(id_col).cast("long"), prime) * 48271, prime), F.lit(buckets))
