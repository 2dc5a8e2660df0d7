"""Names made from data values, as Python strings and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def indicator_suffix(label: str) -> str:
    """Column-name part for a class label: no blanks, ``/ . :`` as ``_``, ``%`` as ``pct``."""
    return re.sub(r"[/.:]", "_", str(label).replace(" ", "")).replace("%", "pct")


def indicator_suffix_col(label: Column) -> Column:
    tight = F.regexp_replace(label, " ", "")
    return F.regexp_replace(F.regexp_replace(tight, "[/.:]", "_"), "%", "pct")


def plain_name(value) -> str:
    """Letters, digits and single underscores only, none at either end."""
    return "_".join(re.findall(r"[0-9A-Za-z]+", str(value)))


def plain_name_col(value: Column) -> Column:
    joined = F.regexp_replace(value, "[^0-9A-Za-z]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def unique_names(names: list[str]) -> list[str]:
    """The same names; a repeated one gets ``_2``, ``_3`` … appended."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return result
