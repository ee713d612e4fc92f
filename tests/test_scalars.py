"""Scalar functions against tables of cases."""

import math

import pytest
from pyspark.sql import functions as F

from factspan.functions import numbers, text, units


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("values", [[236.0, 0.0237, 1e6, 1234567.0, 0.00001234, -5.5, 100000.0, 0.1, 1e-4, 123456.0, 9.999999, 0.0, -0.00012345678, 1e300, 1.5e-300]])
def test_c_general_is_what_percent_g_prints(spark, values):
    got = one(spark, [(v,) for v in values], "v double", numbers.c_general(F.col("v")))
    assert [g[0] for g in got] == ["%g" % v for v in values]


def test_c_general_of_nothing_and_no_numbers(spark):
    got = one(spark, [(None,), (math.nan,), (math.inf,), (-math.inf,)], "v double", numbers.c_general(F.col("v")))
    assert [g[0] for g in got] == [None, "nan", "inf", "-inf"]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("mV", "mv", True), ("mA cm-2", "mA/cm2", True), ("mA cm⁻²", "mA/cm2", True), ("mA·cm^{-2}", "mA/cm2", True), ("V", "mV", False),
        ("mV/dec", "mV/decade", True), ("mV dec^{-1}", "mV/decade", True), ("s^-1", "1/s", True), ("h-1", "1/s", False), ("", "dimensionless", True),
        (None, "dimensionless", True), (None, "mV", False), ("unitless", "dimensionless", True), ("A g_{Ir}^{-1}", "A/g", True), ("MV", "mV", True),
    ],
)
def test_units_match(spark, a, b, same):
    assert one(spark, [(a, b)], "a string, b string", units.units_match(F.col("a"), F.col("b"))) == [(same,)]


@pytest.mark.parametrize(
    "t,v,ok",
    [("Overpotential", 2000.0, True), ("Overpotential", -2000.1, False), ("PEMWECellVoltage", 1900.0, False), ("ECSA", 1e12, True), ("Overpotential", None, True), ("Unknown", 1e12, True)],
)
def test_magnitude(spark, t, v, ok):
    assert one(spark, [(t, v)], "t string, v double", units.magnitude_ok(F.col("t"), F.col("v"))) == [(ok,)]


@pytest.mark.parametrize(
    "v,canon,said,want",
    [
        (30.0, "mV/h", "a rise of 30 µV/h", 0.03), (0.3, "mV", "an overpotential of 0.3 V", 0.3), (2.8, "mV/h", "2.8\\mu\\mathrm{V}\\mathrm{h}^{-1}", 0.0028), (22.0, "mV/h", "22 μ V/h", 0.022),
        (2.8, "mV/h", "2.3–2.8 µV h -1", 0.0028), (2.3, "mV/h", "2.3–2.8 µV h -1", 2.3), (3.0, "mV/h", "Fig 3-5 µV/h", 3.0), (5.0, "mV", "load 5}{kV", 5.0), (22.0, "mV/h", "22 kV/h", 22.0), (300.0, "mV", "300 mV at 10", 300.0),
        (30.0, "mV/h", "30 µV/h and again 30 µV/h", 30.0), (30.0, "mV/h", "130 µV/h", 30.0), (30.0, "mV/h", "30.5 µV/h", 30.0),
        (30.0, "h", "30 µV", 30.0), (None, "mV", "30 V", None), (30.0, "mV", None, 30.0),
    ],
)
def test_rederived_milli(spark, v, canon, said, want):
    got = one(spark, [(v, canon, said)], "v double, c string, t string", units.rederived_milli(F.col("v"), F.col("c"), F.col("t")))[0][0]
    assert got == want or got == pytest.approx(want)


def test_numbers_in_text(spark):
    rows = [(45.0, "45.16"), (45.0, "145"), (1200.0, "1,200 h"), (0.5, "10.5"), (0.5, None), (None, "5")]
    got = one(spark, rows, "v double, t string", numbers.printed_in(F.col("v"), F.col("t")))
    assert [g[0] for g in got] == [True, False, True, False, False, False]
    got = one(spark, [(237.0, "2 3 7"), (5.0, ""), (0.0237, "00237"), (None, "")], "v double, t string", numbers.digits_inside(F.col("v"), F.col("t")))
    assert [g[0] for g in got] == [True, True, True, True]


def test_salvage(spark):
    rows = [("0.4 mg/cm2",), ("about -3",), ("1e-3",), ("none",), ("",), (None,)]
    assert [g[0] for g in one(spark, rows, "t string", numbers.first_number(F.col("t")))] == [0.4, -3.0, 1.0, None, None, None]
    rows = [("0.8",), ("80",), ("true",), ("p=0.9",), ("x",), (None,)]
    assert [g[0] for g in one(spark, rows, "t string", numbers.salvaged_confidence(F.col("t")))] == [0.8, None, None, 0.9, None, None]


def test_tolerance(spark):
    rows = [(100.0, 101.0), (100.0, 101.1), (0.5, 0.50009), (0.5, 0.51), (None, 1.0), (1.0, None)]
    assert [g[0] for g in one(spark, rows, "g double, v double", numbers.within_tolerance(F.col("g"), F.col("v")))] == [True, False, True, False, False, False]


def test_text(spark):
    rows = [("a\\,b ${x}_{2}$ \\mathrm{mV}  ½",), (None,), ("",)]
    got = [g[0] for g in one(spark, rows, "t string", text.latex_cleaned(F.col("t")))]
    assert got[1:] == [None, ""] and "\\" not in got[0] and "  " not in got[0]
    assert one(spark, [("x" * 300,)], "t string", text.one_line(F.col("t"))) == [("x" * 197 + "...",)]
    got = one(spark, [("we found 236 mV at low load today", "236")], "t string, d string", text.phrase_around(F.col("t"), F.col("d")))
    assert got == [("we found 236 mV at low",)]
