"""Missing entries: nulls, NaN, sentinel numbers, blanks and marks such as n/a."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspan.vocab import MISSING_MARKS, SENTINELS


def number_present(c: Column) -> Column:
    """True where a number was recorded; null, NaN, infinities and sentinels count as missing."""
    inf = float("inf")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf) & ~c.isin(SENTINELS)


def squeezed(c: Column) -> Column:
    """Lower-cased text with every kind of white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s​﻿]+", " "))


def text_present(c: Column) -> Column:
    """True where a text was entered; null, blanks and marks count as missing."""
    return F.coalesce(~squeezed(c).isin(MISSING_MARKS), F.lit(False))
