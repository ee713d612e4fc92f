"""Unit signatures, canonical units, magnitude checks and milli re-derivation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factspan.functions.numbers import c_general
from factspan.vocab import CANONICAL_UNIT, MAGNITUDE_CEILING

# Superscripts and their plain digits; spellings that name the same base unit.
_SUPER, _PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"
_SAME = {"dec": "decade", "decades": "decade", "unitless": "dimensionless"}
_TOKEN = r"^([a-zμ%°]+)(-?\d+)?$"


def literal_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def unit_signature(c: Column) -> Column:
    """Sorted array of base^exponent; a blank or null unit is dimensionless.

    Case, markup and subscripts are ignored. Only the first slash divides; an odd token stands for itself with
    exponent one. Units are equal exactly if their signatures are.
    """
    t = F.lower(F.translate(F.coalesce(c, F.lit("")), _SUPER, _PLAIN))
    t = F.regexp_replace(F.regexp_replace(t, r"\\,|\\", " "), r"[{}]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"_[a-z0-9]+", ""), r"\^", ""))
    t = F.when(t == "", F.lit("dimensionless")).otherwise(t)
    halves = F.split(t, "/", 2)

    def tokens(side: Column, sign: int) -> Column:
        raw = F.filter(F.split(F.trim(F.coalesce(side, F.lit(""))), r"[ ·*]+"), lambda x: (x != "") & (x != "1"))

        def one(x: Column) -> Column:
            known = x.rlike(_TOKEN)
            base = F.when(known, F.regexp_extract(x, _TOKEN, 1)).otherwise(x)
            power = F.coalesce(F.when(known, F.regexp_extract(x, _TOKEN, 2).try_cast("int")), F.lit(1))
            same = F.coalesce(F.try_element_at(literal_map(_SAME), base), base)
            return F.struct(same.alias("base"), (power * sign).alias("power"))

        return F.transform(raw, one)

    parts = F.concat(tokens(F.get(halves, F.lit(0)), 1), tokens(F.get(halves, F.lit(1)), -1))
    bases = F.array_distinct(F.transform(parts, lambda x: x["base"]))
    total = lambda b: F.aggregate(F.filter(parts, lambda x: x["base"] == b), F.lit(0), lambda a, x: a + x["power"])
    summed = F.transform(bases, lambda b: F.struct(b.alias("base"), total(b).alias("power")))
    kept = F.filter(summed, lambda x: x["power"] != 0)
    return F.array_sort(F.transform(kept, lambda x: F.concat(x["base"], F.lit("^"), x["power"].cast("string"))))


def units_match(a: Column, b: Column) -> Column:
    return unit_signature(a) == unit_signature(b)


def canonical_unit(type_: Column) -> Column:
    """The canonical unit of a type; null for others."""
    return F.try_element_at(literal_map(CANONICAL_UNIT), type_)


def magnitude_ok(type_: Column, value: Column) -> Column:
    """Whether abs(value) is at most the type's ceiling; true for nulls and types without one."""
    cap = F.try_element_at(literal_map(MAGNITUDE_CEILING), type_)
    return F.coalesce(F.abs(value) <= cap, F.lit(True))


def rederived_milli(value: Column, canonical: Column, text: Column) -> Column:
    """value in the canonical milli unit if the text prints it once, with a micro, nano or milli prefix of the same base.

    Only canonical units in mV or mA are looked at. The number must stand exactly once as a whole token, and a prefix
    with the base must follow it at once; in every other case, a bare V or A included, the value stays as it is.
    """
    base = F.regexp_extract(canonical, r"^m([VA])\b", 1)
    plain = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\mu"), F.lit("µ")), r"\\mathrm|\\,|\\;|[{}\\]", "")
    plain = F.translate(plain, "μ", "µ")
    whole = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string"))
    factor = {"µ": 1e-6 / 1e-3, "u": 1e-6 / 1e-3, "n": 1e-9 / 1e-3, "m": 1.0}
    forms = F.filter(F.array(c_general(value), whole), lambda f: f.isNotNull())
    tokens = F.transform(forms, lambda f: F.struct(F.concat(F.lit(r"(?<!\d)"), F.regexp_replace(f, r"([.+])", r"\\$1"), F.lit(r"(?!\d)(?!\.\d)")).alias("token"), plain.alias("text"), base.alias("base")))

    def prefix(x: Column) -> Column:
        with_unit = F.concat(F.lit("(?U)"), x["token"], F.lit(r"\s*([µunm])\s*"), x["base"])
        said = F.call_function("regexp_extract", x["text"], with_unit, F.lit(1))
        return F.when((F.regexp_count(x["text"], F.concat(F.lit("(?U)"), x["token"])) == 1) & (said != ""), said)

    # at most one of the two forms stands in the text as a whole token
    found = F.get(F.filter(F.transform(tokens, prefix), lambda p: p.isNotNull()), F.lit(0))
    scaled = value * F.try_element_at(literal_map(factor), found)
    return F.when(F.coalesce(base, F.lit("")) != "", F.coalesce(scaled, value)).otherwise(value)
