"""Numbers in text: C's %g form, digit containment, literal presence and tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_general(v: Column) -> Column:
    """What C's %g prints: six significant digits, no trailing zeros, an exponent below -4 and from 6 on.

    Null for null, nan and inf as words. Rounding starts from the shortest decimal form, as the JVM does, so subnormal
    numbers and exact ties in the seventh digit can differ in the last digit.
    """
    sci = F.format_string("%.5e", v)
    mantissa, power = F.regexp_extract(sci, r"^(-?[\d.]+)e", 1), F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    with_power = F.concat(bare(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    above = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(9)))
    plain = F.concat(sign, bare(F.when(power < 0, below).otherwise(above)))
    number = F.when((power < -4) | (power > 5), with_power).otherwise(plain)
    words = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
    return F.when(v.isNotNull(), F.coalesce(words, number))


def value_digits(v: Column) -> Column:
    """The digits of the %g form, leading zeros kept; '' for null."""
    return F.regexp_replace(F.coalesce(c_general(v), F.lit("")), r"\D", "")


def digits_inside(v: Column, text: Column) -> Column:
    """Whether the value's digits stand in the text's digits; values of fewer than two digits count as found."""
    d = value_digits(v)
    return (F.length(d) < 2) | F.coalesce(F.regexp_replace(text, r"(?U)\D", "").contains(d), F.lit(False))


def printed_in(v: Column, text: Column) -> Column:
    """Whether the text prints the value, in its %g or integer form, not as part of a longer run of digits.

    Commas between digits are dropped first. 45 counts as printed in 45.16.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r",", "")
    whole = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string"))
    hit = lambda form: F.coalesce(F.regexp_like(t, F.concat(F.lit(r"(?<!\d)\Q"), form, F.lit(r"\E(?!\d)"))), F.lit(False))
    return hit(c_general(v)) | hit(whole)


def first_number(text: Column) -> Column:
    """The first number in a text as double; null if there is none. An exponent is not read."""
    return F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0).try_cast("double")


def salvaged_confidence(text: Column) -> Column:
    """A confidence from 0 to 1 out of a text; null for booleans, words and numbers outside."""
    v = F.when(~F.lower(F.trim(text)).isin("true", "false"), F.coalesce(text.try_cast("double"), first_number(text)))
    return F.when(v.between(0, 1), v)


def distinctive(v: Column) -> Column:
    """Whether a value is unlikely to be printed by chance: no integer, or at least 100 in size."""
    return F.coalesce((v != F.floor(v)) | (F.abs(v) >= 100), F.lit(False))


def tolerance(gold: Column) -> Column:
    return F.greatest(F.abs(gold) * 0.01, F.when(F.abs(gold) >= 1, F.lit(0.5)).otherwise(F.lit(1e-4)))


def within_tolerance(gold: Column, value: Column) -> Column:
    """Whether a value is the gold one within 1 %, or 0.5 (1e-4 below one); false if either is null."""
    return F.coalesce(F.abs(value - gold) <= tolerance(gold), F.lit(False))
