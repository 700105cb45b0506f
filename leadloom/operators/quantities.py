"""Quantities recorded in different units to one unit.

The text is read by the grammar of :mod:`leadloom.functions.units`. Each amount has a unit
built from the units it names, as an exponent vector with a scale and an offset; pay is
money^1 time^-1. The units of money and pay time come from the two rate tables, which are
small by their nature (more than ``MOST_UNITS`` rows raise) and go to the workers with the
parser, so a row is read, converted and rounded where it lies: no join, no shuffle.
Amounts are exact fractions until they are rounded.

Defined results: null, blank and texts without base pay give no amounts; several
amounts keep their order; repeated rows give repeated results; amounts of a currency or
period the tables lack, of another vector than asked for, or beyond 64 bits are left out;
a name given twice in a rate table takes the least rate; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.units import ZERO, Unit, Vector, parse_pay, parse_unit, vector
from leadloom.runtime import bounded_rows

AMOUNTS = T.ArrayType(T.StructType([T.StructField("amount", T.DecimalType(24, 6)), T.StructField("currency", T.StringType()), T.StructField("period", T.StringType())]))
_PHYSICAL = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("dims", T.ArrayType(T.IntegerType()))])
_STEP, _MOST = Decimal("0.000001"), Decimal(10) ** 17
#: Most rows of a rate table.
MOST_UNITS = 10_000
#: Money per time.
PAY = vector(money=1, time=-1)


@F.pandas_udf(AMOUNTS)
def stated_pay(texts: pd.Series) -> pd.Series:
    """Amounts of base pay in each text as they are written; null where there are none."""

    def one(text: str | None) -> list | None:
        found = [(a.value.quantize(_STEP, ROUND_HALF_EVEN), a.currency, a.period) for a in parse_pay(text) if a.value < _MOST] if text else []
        return [{"amount": v, "currency": c, "period": p} for v, c, p in found] or None

    return pd.Series([one(t) for t in texts], dtype=object)


def rate_units(currencies: DataFrame, periods: DataFrame) -> dict[str, Unit]:
    """Units by name from ``currencies`` (currency, usd_per_unit) and ``periods`` (period_name, per_year), canonical in dollars and years."""
    out: dict[str, Unit] = {}
    for r in sorted(bounded_rows(currencies.select("currency", "usd_per_unit").dropna(), MOST_UNITS), reverse=True):
        out[r["currency"]] = Unit(vector(money=1), Fraction(r["usd_per_unit"]))
    for r in sorted(bounded_rows(periods.select("period_name", "per_year").dropna(), MOST_UNITS), reverse=True):
        if r["per_year"]:
            out[r["period_name"]] = Unit(vector(time=1), 1 / Fraction(r["per_year"]))
    return out


def converted(text: Column, units: dict[str, Unit], target: Vector) -> Column:
    """``array<bigint>``: the amounts of a text in the canonical unit of ``target``, rounded half up; amounts of other vectors are left out."""

    @F.pandas_udf("array<bigint>")
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[int]:
            parsed = [(a.value, a.unit(units)) for a in parse_pay(text)] if text else []
            whole = [(u.canonical(v) + Fraction(1, 2)).__floor__() for v, u in parsed if u is not None and u.dims == target]
            return [x for x in whole if abs(x) < 1 << 63]

        return pd.Series([one(t) for t in texts], dtype=object)

    return read(text)


def yearly_usd(df: DataFrame, id_col: str, text_col: str, currencies: DataFrame, periods: DataFrame) -> DataFrame:
    """One row per row of ``df`` that states base pay: id, usd_min, usd_max (whole dollars per year, half up)."""
    stated = df.filter(F.col(text_col).rlike(r"\d|(?i)hundred|thousand|million"))
    usd = converted(F.col(text_col), rate_units(currencies, periods), PAY)
    # A generator and no filter drops rows without amounts: a filter would be moved below and read the text again.
    range_ = F.when(F.size(usd) > 0, F.array(F.struct(F.array_min(usd).alias("usd_min"), F.array_max(usd).alias("usd_max"))))
    return stated.select(id_col, F.inline(range_))


_QUANTITY = r"^\s*(?P<n>[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)\s*(?P<u>\S.*?)\s*$"


@F.pandas_udf(_PHYSICAL)
def physical(texts: pd.Series) -> pd.DataFrame:
    """A physical quantity such as ``72 km/h`` in the canonical unit of its vector, and the vector; null if unreadable."""

    def one(text: str | None) -> dict:
        m = re.match(_QUANTITY, text) if text else None
        unit = parse_unit(m["u"]) if m else None
        if m is None or unit is None or unit.dims == ZERO:
            return {"value": None, "dims": None}
        return {"value": float(unit.canonical(Decimal(m["n"].replace(",", ".")))), "dims": list(unit.dims)}

    return pd.DataFrame([one(t) for t in texts], columns=["value", "dims"])
