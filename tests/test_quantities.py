"""Problem 4: units from labels and text, on small tables and by brute force."""

import math
import time

import pytest
from pyspark.sql import functions as F

from factspan.operators import quantities as Q

FACTS = (
    "fact_id long, type string, value double, unit_label string, condition struct<current_density double>, evidence struct<source_text string>, extra string"
)
TYPES = [("Overpotential", "mV"), ("Stability", "h"), ("ExchangeCurrentDensity", "mA/cm2"), ("ChargeTransferCoefficient", "dimensionless"), ("DegradationRate", "mV/h"), ("ECSA", "cm2")]


def found(spark, rows):
    f = spark.createDataFrame([(i, t, v, u, (d,), (s,), "x") for i, (t, v, u, d, s) in enumerate(rows)], FACTS)
    return {(r.fact_id, r.field): r.canon_e6 for r in Q.found(f, spark.createDataFrame(TYPES, "type string, canonical_unit string")).collect()}


def test_cases(spark):
    got = found(
        spark,
        [
            ("Overpotential", 0.3, "V", None, None),  # 0: label
            ("Overpotential", 0.3, "mV", None, "it gave 0.3 volt there"),  # 1: the text goes before the label
            ("Overpotential", 300.0, "millivolt", None, None),  # 2: canonical in another spelling
            ("Overpotential", math.nan, "V", 2.0, "at 2 A cm−2"),  # 3: only the density
            ("Overpotential", -999.0, "V", None, None),  # 4: sentinel
            ("Overpotential", 5.0, "bar", None, None),  # 5: another dimension
            ("Stability", 1800.0, "n/a", 10.0, "for 1 800 minutes @ 10 mA/cm2"),  # 6: unit only in the text
            ("ExchangeCurrentDensity", 5.0, None, 5.0, "5 µA/cm2 at 5 kA m⁻²"),  # 7: each number with its own unit
            ("ChargeTransferCoefficient", 45.0, "per cent", None, None),  # 8
            ("DegradationRate", 221.0, "mV per 1000 h", None, ""),  # 9
            ("ECSA", 0.01, "m^{2}", None, "2,5 m2"),  # 10
            ("Overpotential", 470.0, "milivolts", None, None),  # 11: misspelled canonical unit
            ("Overpotential", 0.47, "vollts", None, None),  # 12: fuzzy, other unit
            (None, 1.0, "V", None, None),  # 13: no type
            ("ECSA", None, None, 1.0, "at 1,000 uA/cm2"),  # 14: a thousand is not the 1.0 of the record, which is in mA/cm2
            ("Overpotential", 0.125, "mV", None, "war 0,125 V."),  # 15: a decimal comma
        ],
    )
    assert got == {
        (0, "value"): 300_000_000, (1, "value"): 300_000_000, (3, "current_density"): 2_000_000_000, (6, "value"): 30_000_000,
        (7, "value"): 5_000, (7, "current_density"): 500_000_000, (8, "value"): 450_000, (9, "value"): 221_000, (10, "value"): 100_000_000, (12, "value"): 470_000_000, (15, "value"): 125_000_000,
    }


def test_empty(spark):
    assert found(spark, []) == {}


def test_ties_and_long_text(spark):
    long = "padding words here " * 20_000 + "0.25 V"
    got = found(spark, [("Overpotential", 0.25, "mV", None, long)] * 2)
    assert set(got.values()) == {250_000_000} and len(got) == 2


@pytest.mark.parametrize("text", ["abc def ghi " * 10_000, "a" * 100_000, "1 " * 50_000, "1," * 50_000, "at " * 40_000, "1.000 " * 20_000])
def test_long_texts_take_linear_time(spark, text):
    d = spark.createDataFrame([(text,)], "t string").select(F.size(Q.mentions(F.col("t"))))
    d.collect()
    start = time.time()
    d.collect()
    assert time.time() - start < 2  # with a wildcard before the number, 40,000 characters took 87 s


@pytest.mark.parametrize("a,b,ok", [("millivolts", "millivolt", True), ("mv/h", "mv/kh", False), ("m2", "mm2", False), ("minutes", "minuets", True), ("a/g", "ka/g", False), ("hours", "yours", False)])
def test_weighted_cost(a, b, ok):
    assert (Q.weighted_cost(a, b) <= Q.MAX_COST) == ok
