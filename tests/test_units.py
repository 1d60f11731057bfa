import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagekg.operators import units

NAMES = "src string, line_no bigint, triple_ix int, name string, unit_of string"


def converted(spark, names):
    rows = [("gold", i, 0, n, "x") for i, n in enumerate(names)]
    m = units.measurements(spark.createDataFrame(rows, NAMES))
    out = {i: set() for i in range(len(names))}
    for r in units.to_base(m).collect():
        out[r.line_no].add((r.quantity, r.value_base))
    return [out[i] for i in range(len(names))]


CASES = {
    "252,15 K": {("temperature", -2100)}, "41 F": {("temperature", 500)}, "178 oC": {("temperature", 17800)}, "96 °Ｃ": {("temperature", 9600)}, "‑189 F": {("temperature", -12278)},
    "at 106°C / 52 hours": {("temperature", 10600), ("time", 187200)}, "7 h 00 min": {("time", 25200)}, "20:00 h": {("time", 72000)}, "two hours": {("time", 7200)}, "0,25 days": {("time", 21600)},
    "twenty-four hours": {("time", 86400)}, "25–50 h": {("time", 90000), ("time", 180000)}, "between 207 and 212 °C": {("temperature", 20700), ("temperature", 21200)},
    "4e5 Pa": {("pressure", 400000)}, "2 × 10^5 Pa": {("pressure", 200000)}, "2 × 10⁵ Pa": {("pressure", 200000)}, "600,000 Pa": {("pressure", 600000)}, "1 atm": {("pressure", 101325)},
    "19 torr": {("pressure", 2533)}, "760 mmHg": {("pressure", 101325)}, "1 psi": {("pressure", 6895)}, "880 mbаr": {("pressure", 88000)}, "3.7 MPa": {("pressure", 3700000)},
    "SBET = 2.449e3 m2 g‑1": {("surface_area", 2449)}, "1,016 m²/g": {("surface_area", 1016)}, "4732 square metres per gram": {("surface_area", 4732)}, "10160000 cm2/g": {("surface_area", 1016)},
    "435000 m2/kg": {("surface_area", 435)}, "0.435 m2/mg": {("surface_area", 435)}, "Vp = 0,205 cm³ g⁻¹": {("pore_volume", 205)}, "1823 µL/g": {("pore_volume", 1823)},
    "0.299 L/kg": {("pore_volume", 299)}, "1. cc/g": {("pore_volume", 1000)}, "yield = 0.763 (fraction)": {("yield", 763)}, "yield (based on metal) 50.3%": {("yield", 503)},
    "59.2% yield": {("yield", 592)}, "yield 915 per mille": {("yield", 915)}, "isolated yield 32,3 %": {("yield", 323)}, "1.57 cm3 g-1 at 77 K": {("pore_volume", 1570), ("temperature", -19615)},
    "five hourss": {("time", 18000)}, "120 degres celcius": {("temperature", 12000)},
    "pH 6.5": set(), "overnight": set(), "120": set(), "several hours": set(), "under N2": set(), "": set(), "   ": set(), "15 %": set(), "30 mL": set(), None: set(), "x" * 5000: set(),
}


def test_cases(spark):
    got = converted(spark, list(CASES))
    assert {k: v for k, v in zip(CASES, got) if v != CASES[k]} == {}


def test_unknown_units_are_reported(spark):
    rows = [("gold", 1, 0, "5 furlongs", "x"), ("gold", 2, 0, "5 h", "x")]
    m = units.measurements(spark.createDataFrame(rows, NAMES))
    assert [r.unit for r in units.unknown_units(m).collect()] == ["furlongs"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("gold", 1, 0, "5 h", "x", 9, "q")], NAMES + ", value int, quantity string").withColumnRenamed("unit_of", "unit")
    r = units.to_base(units.measurements(df)).first()
    assert (r.value, r.unit, r.quantity, r.value_base) == (5.0, "h", "time", 18000)


def test_empty(spark):
    assert units.to_base(units.measurements(spark.createDataFrame([], NAMES))).count() == 0


@given(st.text(max_size=80))
def test_parser_never_raises(text):
    for value, unit in units.parse(text):
        assert isinstance(value, float) and unit


@pytest.mark.parametrize(("a", "b", "most"), [("hours", "huors", 0.5), ("celsius", "celcius", 1.0), ("minutes", "minuttes", 0.5), ("h", "h", 0.0)])
def test_distance(a, b, most):
    assert units.weighted_distance(a, b) <= most


def test_case_tells_prefixes_apart(spark):
    names = spark.createDataFrame([("5 mPa",), ("5 MPa",), ("5 mpa",), ("5 kpa",)], "name string").withColumn("k", F.col("name"))
    got = {r.k: r.value_base for r in units.to_base(units.measurements(names)).collect()}
    assert got == {"5 mPa": 0, "5 MPa": 5_000_000, "5 mpa": 5_000_000, "5 kpa": 5000}


def test_index_finds_what_comparing_with_every_spelling_finds(spark):
    import random

    rng = random.Random(6)
    known = [units.spelled(s) for _, _, _, names in units.UNITS.values() for s in names]
    words = [w for w in known if re.fullmatch("[A-Za-z ]{5,}", w)]
    typed = set()
    for w in words * 6:
        i = rng.randrange(1, len(w))
        typed.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w[:i] + rng.choice("aeiost") + w[i + 1 :]]))
    typed = sorted(t for t in typed if re.fullmatch("[A-Za-z ]{5,}", t) and t.strip() == t)
    brute = {t for t in typed if any(units.weighted_distance(t.lower(), w.lower()) <= units.FUZZ * len(w) for w in words)}
    found = {r.unit for r in units.unit_aliases(spark.createDataFrame([(t,) for t in typed], "unit string")).collect()}
    assert len(brute - found) <= 0.01 * len(brute)
