from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.functions.units import PHYSICAL, Unit, parse_pay, parse_unit, vector
from leadloom.operators.quantities import PAY, converted, physical, rate_units, yearly_usd

CASES = [
    ("$89,000 — $118,000 a year", [("89000", "USD", "year"), ("118000", "USD", "year")]), ("82 – 106K dollars per annum", [("82000", "USD", "year"), ("106000", "USD", "year")]),
    ("Monthly base: 3.900 - 5.100 EUR", [("3900", "EUR", "month"), ("5100", "EUR", "month")]), ("CHF 146'000 to CHF 163'000 p.a.", [("146000", "CHF", "year"), ("163000", "CHF", "year")]),
    ("38,50,000 INR per annum", [("3850000", "INR", "year")]), ("1.7 to 2.35 lakh per month (INR)", [("170000", "INR", "month"), ("235000", "INR", "month")]), ("CTC 15.5 LPA", [("1550000", "INR", "year")]),
    ("94-123 TEUR", [("94000", "EUR", "year"), ("123000", "EUR", "year")]), ("$62/hr ($128,960 annualized)", [("62", "USD", "hour")]), ("between 74,50 and 80 zł / godz.", [("74.50", "PLN", "hour"), ("80", "PLN", "hour")]),
    ("one hundred and five thousand to one hundred and seventeen thousand US dollars per year", [("105000", "USD", "year"), ("117000", "USD", "year")]),
    ("$106,000–135,000/yr plus $5,000 signing bonus", [("106000", "USD", "year"), ("135000", "USD", "year")]), ("$0.128M/year", [("128000", "USD", "year")]), ("EUR 50 000 brut annuel", [("50000", "EUR", "year")]),
    ("104k", [("104000", "USD", "year")]), ("Bonus: up to 15%", []), ("$40M raised, team of 60", []), ("401(k) with 4% match", []), ("Grade 7", []), ("Learning budget $2,500/year", []), ("", []), ("Up to 0.25% equity", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_pay_grammar(text, want):
    assert [(a.value, a.currency, a.period) for a in parse_pay(text)] == [(Decimal(v), c, p) for v, c, p in want]
    table = {c: Unit(vector(money=1)) for _, c, _ in want} | {p: Unit(vector(time=1)) for _, _, p in want}
    assert all(a.unit(table).dims == vector(money=1, time=-1) and a.unit({}) is None for a in parse_pay(text))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read(text):
    assert isinstance(parse_pay(text), tuple)


@settings(max_examples=60, deadline=None)
@given(st.integers(20, 900), st.integers(1, 300), st.sampled_from([" - ", "–", " to "]), st.sampled_from(["USD", "GBP", "PLN"]))
def test_ranges_keep_their_ends(lo, more, joint, currency):
    got = parse_pay(f"{lo},000{joint}{lo + more},000 {currency} per year")
    assert [a.value for a in got] == [lo * 1000, (lo + more) * 1000] and {a.currency for a in got} == {currency}


def test_units_are_exponent_vectors():
    u = parse_unit("kg*m/s^2")
    assert u.dims == vector(mass=1, length=1, time=-2) and parse_unit("km/h").scale == Fraction(1000, 3600) and parse_unit("parsec") is None
    assert PHYSICAL["°f"].canonical(212) == Fraction("373.15")


def test_yearly_usd(spark):
    cur = spark.createDataFrame([("USD", Decimal("1.0")), ("GBP", Decimal("1.275"))], "currency string, usd_per_unit decimal(10,4)")
    per = spark.createDataFrame([("year", 1), ("hour", 2080)], "period_name string, per_year int")
    rows = [(1, "£44 to £51/h", "x"), (2, None, "x"), (3, "n/a", "x"), (4, "$10.5/hr", "x"), (5, "100 CHF per hour", "x"), (6, "9" * 40 + " USD", "x"), (7, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "id long, salary_text string, currency string")
    got = {r["id"]: (r["usd_min"], r["usd_max"]) for r in yearly_usd(df, "id", "salary_text", cur, per).collect()}
    assert got == {1: (116688, 135252), 4: (21840, 21840)}
    assert yearly_usd(df.limit(0), "id", "salary_text", cur, per).count() == 0


def test_physical(spark):
    df = spark.createDataFrame([("72 km/h",), ("20 °C",), ("nothing",), (None,)], "t string")
    got = [r["p"]["value"] for r in df.select(physical(F.col("t")).alias("p")).collect()]
    assert got[0] == pytest.approx(20) and got[1] == pytest.approx(293.15) and got[2:] == [None, None]


def test_conversion_goes_through_the_vectors(spark):
    cur = spark.createDataFrame([("USD", Decimal("1.0")), ("GBP", Decimal("1.275")), (None, Decimal(1))], "currency string, usd_per_unit decimal(10,4)")
    per = spark.createDataFrame([("year", 1), ("hour", 2080), ("never", None)], "period_name string, per_year int")
    units = rate_units(cur, per)
    assert units["GBP"] / units["hour"] == Unit(PAY, Fraction("1.275") * 2080) and "never" not in units
    df = spark.createDataFrame([("£44/h",)], "t string")
    assert df.select(converted(F.col("t"), units, PAY)).first()[0] == [116688]
    assert df.select(converted(F.col("t"), units | {"hour": Unit(vector(length=1), Fraction(1, 2080))}, PAY)).first()[0] == []
    assert df.select(converted(F.col("t"), units, vector(money=1))).first()[0] == []
