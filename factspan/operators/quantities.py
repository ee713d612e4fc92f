"""Quantities recorded in different units (problem 4).

Every distinct spelling of a unit is mapped once: exact forms first, then a character n-gram inverted index proposes
known forms and a weighted edit distance verifies them. The alias dictionary made this way is joined to all rows.

Units are exact integer multiples of one small unit of their dimension, so that a conversion is one multiplication and
one division.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.marks import number_present
from factspan.session import staged

# Dimension, size in the dimension's smallest unit, plain forms (lower case, u for micro).
# Numerators are combined with the denominators below by unit_forms().
_POTENTIAL = {"uv": 1, "mv": 1_000, "v": 1_000_000}
_POTENTIAL_WORDS = {"microvolt": 1, "millivolt": 1_000, "volt": 1_000_000}
_CURRENT = {"na": 1, "ua": 1_000, "ma": 1_000_000, "a": 1_000_000_000, "ka": 1_000_000_000_000}
_AREA = {"mm2": 1, "cm2": 100, "m2": 1_000_000}
_TIME = {"s": 1, "min": 60, "h": 3_600, "d": 86_400, "kh": 3_600_000}
_TIME_WORDS = {
    "sec": 1, "second": 1, "seconds": 1, "mins": 60, "minute": 60, "minutes": 60, "hr": 3_600, "hrs": 3_600,
    "hour": 3_600, "hours": 3_600, "day": 86_400, "days": 86_400, "week": 604_800, "weeks": 604_800,
}
_DECADE = ["decade", "dec", "decades"]
_RATIO = {
    "dimensionless": 100, "unitless": 100, "1": 100, "%": 1, "percent": 1, "percentage": 1, "pct": 1, "per cent": 1,
    "/cent": 1,
}
# Units of other dimensions that turn up as labels; known, so that no fuzzy match takes them.
_FOREIGN = {
    "bar": "pressure", "k": "temperature", "c": "temperature", "kg": "mass", "g": "mass", "mg": "mass",
    "mol/l": "concentration", "m": "concentration", "mm": "length", "cm": "length", "nm": "length", "um": "length",
    "ohm": "resistance", "hz": "rate_hz", "ml": "volume", "l": "volume", "w": "power", "kwh": "energy", "rpm": "rate_rpm",
    "mg/cm2": "loading", "mv/s": "scan_rate",
}
NGRAM = 2
MIN_DICE = 0.4
MAX_COST = 1.0


def unit_forms() -> list[tuple[str, str, float]]:
    """(form, dimension, size) of every known unit, generated from the tables above."""
    rows: list[tuple[str, str, float]] = []
    pot = _POTENTIAL | _POTENTIAL_WORDS | {w + "s": n for w, n in _POTENTIAL_WORDS.items()}
    rows += [(f, "potential", n) for f, n in pot.items()]
    rows += [(f"{f}/{d}", "tafel", n) for f, n in pot.items() for d in _DECADE]
    time = _TIME | _TIME_WORDS
    rows += [(f, "time", n) for f, n in time.items()]
    rows += [("x1000 h", "time", 3_600_000), ("1000 h", "time", 3_600_000)]
    # a rate of u V per kh is the smallest here: size = volts * (kh / time)
    rows += [
        (f"{f}/{t}", "drift", n * 3_600_000 / s)
        for f, n in pot.items()
        for t, s in (_TIME | {"hour": 3_600, "hr": 3_600, "day": 86_400, "1000 h": 3_600_000, "1000h": 3_600_000}).items()
        if t != "s"
    ]
    rows += [(f"1/{t}", "frequency", 86_400 / s) for t, s in (_TIME | {"sec": 1, "hour": 3_600, "hr": 3_600, "day": 86_400}).items() if t != "kh"]
    rows += [("hz", "frequency", 86_400)]
    rows += [(f, "area", n) for f, n in _AREA.items()]
    rows += [(f"{c}/{a}", "current_density", n * (1_000_000 / s)) for c, n in _CURRENT.items() for a, s in _AREA.items()]
    rows += [(f"{c}/{m}", "mass_activity", n * (1_000_000 / s)) for c, n in _CURRENT.items() for m, s in {"ug": 1, "mg": 1_000, "g": 1_000_000, "kg": 1_000_000_000}.items()]
    rows += [(f, "ratio", n) for f, n in _RATIO.items()]
    known = {r[0] for r in rows}
    rows += [(f, d, 1) for f, d in _FOREIGN.items() if f not in known]
    return [(f, d, float(n)) for f, d, n in rows]


def unit_catalogue(spark: SparkSession) -> DataFrame:
    """form, dimension, size: a fixed table of some 250 rows, whatever the data."""
    return spark.createDataFrame(unit_forms(), "form string, dimension string, size double")


_FROM = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−–‐‑µμ·⋅∙*×      \t\n^{}$\\"
_TO = "0123456789-----uu    x        "


def plain_unit(c: Column) -> Column:
    """One plain form of a unit's spelling: lower case, u for micro, a/b for a b-1, no markup."""
    c = F.translate(F.regexp_replace(c, r"\\,|\\mathrm|\\text|~", " "), _FROM, _TO)
    c = F.regexp_replace(F.lower(c), r"_[a-z0-9]+", "")
    c = F.regexp_replace(c, r"\bper\b(?! ?cent)", "/")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r" ?/ ?| (?=-\d)", "$0"))
    c = F.regexp_replace(c, r" ?/ ?", "/")
    c = F.regexp_replace(c, r"^([a-z]+) ?-1$", "1/$1")
    c = F.regexp_replace(c, r"^([a-z0-9]+) ([a-z]+) ?-1$", "$1/$2")
    return F.regexp_replace(c, r"^([a-z]+) ?([a-z]+) ?-([23])$", "$1/$2$3")


def weighted_cost(a: str, b: str) -> float:
    """Edit distance in which only long words may vary: signs, digits, prefixes and short symbols are kept as they are.

    A doubled or lost plural s costs 0.5, a swap of neighbours 0.7, any other edit 1; a change of the first letter of a
    word (a unit prefix) or of a symbol of under four letters is never accepted.
    """
    import re

    wa, wb = re.findall(r"[a-z]+|[^a-z]", a.replace(" ", "")), re.findall(r"[a-z]+|[^a-z]", b.replace(" ", ""))
    if len(wa) != len(wb):
        return 99.0
    total = 0.0
    for x, y in zip(wa, wb):
        if x == y:
            continue
        if min(len(x), len(y)) < 4 or x[0] != y[0] or not x.isalpha():
            return 99.0
        d = [[float(i + j) if not i or not j else 0.0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                gap_x = 0.5 if x[i - 1] == "s" and i == len(x) or i > 1 and x[i - 1] == x[i - 2] else 1.0
                gap_y = 0.5 if y[j - 1] == "s" and j == len(y) or j > 1 and y[j - 1] == y[j - 2] else 1.0
                d[i][j] = min(d[i - 1][j] + gap_x, d[i][j - 1] + gap_y, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.7)
        total += d[-1][-1]
    return total


@F.pandas_udf(T.DoubleType())
def _cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_cost(x, y) for x, y in zip(a, b)], dtype="float64")


def _grams(c: Column) -> Column:
    p = F.concat(F.lit("^"), c, F.lit("$"))
    at = F.sequence(F.lit(1), F.length(p) - (NGRAM - 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(p, i, F.lit(NGRAM))))


def alias_dictionary(spellings: DataFrame, spelling: str = "spelling") -> DataFrame:
    """spelling, form, dimension, size of every distinct spelling that is a known unit or close to one.

    Spellings repeat endlessly in the data, so they are first made distinct; what follows works on the vocabulary of
    spellings, not on rows. Null and blank spellings, and those no known form is close to, have no row. Ties of cost
    go to the form that shares more n-grams, then to the alphabetically first.
    """
    known = unit_catalogue(spellings.sparkSession)
    # staged, or else the joins' null checks on the plain form are pushed below distinct() and run on every row
    s = staged(spellings.select(F.col(spelling).alias("spelling")).where("trim(spelling) <> ''").distinct())
    s = s.withColumn("plain", plain_unit(F.col("spelling")))
    exact = s.join(known, s.plain == known.form).select("spelling", "form", "dimension", "size")
    rest = s.join(known, s.plain == known.form, "left_anti").where(F.length("plain").between(4, 24))
    a = rest.withColumn("g", _grams(F.col("plain"))).withColumn("na", F.size("g")).withColumn("gram", F.explode("g"))
    b = known.where(F.length("form") >= 4).withColumn("g", _grams(F.col("form"))).withColumn("nb", F.size("g"))
    b = b.withColumn("gram", F.explode("g")).drop("g")
    shared = a.drop("g").join(b, "gram").groupBy("spelling", "plain", "na", "form", "dimension", "size", "nb").count()
    close = shared.withColumn("dice", 2 * F.col("count") / (F.col("na") + F.col("nb"))).where(F.col("dice") >= MIN_DICE)
    close = close.withColumn("cost", _cost("plain", "form")).where(F.col("cost") <= MAX_COST)
    best = close.groupBy("spelling").agg(F.min_by(F.struct("form", "dimension", "size"), F.struct("cost", -F.col("dice"), "form")).alias("b"))
    return exact.unionByName(best.select("spelling", "b.*"))


# A number with its unit in running text, after clean_text(): an optional at/under/@ before it, the number, the unit.
_UNIT = r"1/[A-Za-z]+|x ?1000 ?h|per ?cent|%|[A-Za-zu]+[23]?(?:/[A-Za-z]+[23]?| per (?:1000 )?[A-Za-z]+| ?-[123]|[ .][A-Za-z]+ ?-[123])?(?:_[A-Za-z]+)?"
_MENTION = rf"((?:\b(?:at|under|bei|bajo) |@ ?)?)(?<![\w.,-])(-?\d+(?:[.,]\d+| (?=\d{{3}}(?!\d))\d{{3}}){{0,40}}) ?((?:{_UNIT})?)(?![A-Za-z])"


def clean_text(c: Column) -> Column:
    """Markup out, one minus sign, plain digits in exponents, single blanks; a raised dot between digits is a point."""
    c = F.replace(F.replace(c, F.lit("\\,\\mathrm{"), F.lit(" ")), F.lit("\\,"), F.lit(" "))
    c = F.translate(c, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−–µμ    \t\n^{}$\\", "0123456789---uu      ")
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)·(?=\d)", "."), r"[ ·]+", " ")


def mentions(text: Column) -> Column:
    """Array of (at, number, other, unit) for each number in a text that may carry a unit, in order.

    number reads commas as thousands, other reads a comma as a decimal point, except where all groups have three
    digits as thousands have (1,000 is not one). A null or empty text gives an empty array.
    """
    marked = F.regexp_replace(clean_text(F.coalesce(text, F.lit(""))), _MENTION, "\u0002$1\u0001$2\u0001$3\u0002")
    parts = F.filter(F.split(marked, "\u0002"), lambda x: x.contains("\u0001"))

    def one(x: Column) -> Column:
        f = F.split(x, "\u0001")
        n = F.get(f, F.lit(1))
        return F.struct(
            (F.length(F.get(f, F.lit(0))) > 0).alias("at"),
            F.translate(n, ", ", "").try_cast("double").alias("number"),
            F.when(~n.rlike(r"^-?[1-9]\d{0,2}(?:,\d{3})+$"), F.translate(n, ", ", ".").try_cast("double")).alias("other"),
            F.get(f, F.lit(2)).alias("unit"),
        )

    return F.transform(parts, one)


def recorded_quantities(facts: DataFrame) -> DataFrame:
    """fact_id, field, number, type, source, at, spelling: each recorded number with each unit it may have.

    source 0: evidence.source_text prints the number with this unit; 1: the recorded label, or mA/cm2 where the field
    has no label. Rows without a recorded number are left out; a number without text or label keeps one row with a
    null spelling.
    """
    base = facts.select(
        "fact_id", "type", "unit_label",
        F.col("value"), F.col("condition.current_density").alias("density"), F.col("evidence.source_text").alias("said"),
    )
    has_value, has_density = number_present(F.col("value")), number_present(F.col("density"))
    base = base.where(has_value | has_density).withColumn("m", mentions(F.col("said")))

    def of(field: str, number: Column, ok: Column, label: Column, at: bool) -> Column:
        hit = F.filter("m", lambda x: (x["unit"] != "") & ((x["number"] == number) | (x["other"] == number)))
        text = F.transform(
            hit,
            lambda x: F.struct(F.lit(field).alias("field"), number.alias("number"), F.lit(0).alias("source"), (x["at"] != F.lit(at)).cast("int").alias("off"), x["unit"].alias("spelling")),
        )
        own = F.array(F.struct(F.lit(field).alias("field"), number.alias("number"), F.lit(1).alias("source"), F.lit(0).alias("off"), label.alias("spelling")))
        return F.when(ok, F.concat(text, own)).otherwise(F.filter(own, lambda x: F.lit(False)))

    all_ = F.concat(
        of("value", F.col("value"), has_value, F.col("unit_label"), False),
        of("current_density", F.col("density"), has_density, F.lit("mA/cm2"), True),
    )
    return base.select("fact_id", "type", F.posexplode(all_).alias("pos", "q")).select("fact_id", "type", "pos", "q.*")


def converted(facts: DataFrame, fact_types: DataFrame) -> DataFrame:
    """fact_id, field, type, number, unit (its known form), source, factor, canonical: recorded numbers in canonical units.

    A fitting unit printed beside the number in the text goes before the label; among several the one whose position
    fits the field (after at/under/@ for current densities), then the first. A number with no known unit of its type's
    dimension has a null unit, factor and canonical. Repeated fact_ids are taken as one fact; extra columns are
    ignored.
    """
    rows = staged(recorded_quantities(facts))
    known = unit_catalogue(facts.sparkSession)
    targets = fact_types.select(F.col("type"), F.lit("value").alias("field"), plain_unit(F.col("canonical_unit")).alias("canon"))
    alias = alias_dictionary(rows)
    canon = known.select(F.col("form").alias("canon"), F.col("dimension").alias("want"), F.col("size").alias("canon_size"))
    goal = targets.join(canon, "canon").select("type", "want", "canon_size")
    q = rows.join(alias, "spelling", "left").join(F.broadcast(goal), "type", "left")  # goal: one row per fact type, 11
    density = F.col("field") == "current_density"
    want = F.when(density, F.lit("current_density")).otherwise(F.col("want"))
    fits = F.coalesce(F.col("dimension") == want, F.lit(False))
    ma_cm2 = next(s for f, _, s in unit_forms() if f == "ma/cm2")
    q = q.withColumn("factor", F.when(fits, F.col("size") / F.when(density, F.lit(ma_cm2)).otherwise(F.col("canon_size"))))
    q = q.withColumn("form", F.when(fits, F.col("form")))
    best = q.groupBy("fact_id", "field").agg(
        F.min_by(
            F.struct("type", "number", "form", "source", "factor"),
            F.struct((~fits).alias("unfit"), "source", "off", "pos"),
        ).alias("b")
    )
    out = best.select("fact_id", "field", "b.type", "b.number", F.col("b.form").alias("unit"), "b.source", "b.factor")
    return out.withColumn("canonical", F.col("number") * F.col("factor"))


def found(facts: DataFrame, fact_types: DataFrame) -> DataFrame:
    """p4_found: recorded numbers that are not in the canonical unit, times one million in that unit."""
    c = converted(facts, fact_types).where((F.col("factor") != 1.0))
    return c.select("fact_id", "field", F.round(F.col("number") * (F.col("factor") * 1e6)).cast("long").alias("canon_e6"))


def unit_report(facts: DataFrame) -> DataFrame:
    """spelling, n, form, dimension: every spelling met and what it was mapped to; null where it is unknown."""
    rows = staged(recorded_quantities(facts))
    n = rows.where("trim(spelling) <> ''").groupBy("spelling").agg(F.count("*").alias("n"))
    return n.join(alias_dictionary(rows), "spelling", "left").select("spelling", "n", "form", "dimension")
