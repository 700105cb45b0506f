"""A grammar for quantities in text, with dimensions as exponent vectors.

A unit is an exponent vector over base dimensions with a scale and an offset to the
canonical unit of that vector, so ``km/h``, ``kg*m/s^2`` or ``USD/hour`` are built
from their parts by adding and subtracting vectors and multiplying scales, which are
exact fractions. The units of money and of the time pay counts by come from rate tables,
because their scales are data.

Grammar of a clause (``[x]`` optional, ``{x}`` repeated, ``|`` choice), read by recursive
descent over the tokens of :data:`_TOKEN`::

    clause     = { amount | currency | period | word }
    amount     = number [ suffix | "%" ]
    suffix     = multiplier | multiplier currency | composite
    number     = digits with group and decimal signs | number words
    composite  = word for a multiplier with units ("LPA", "TEUR")
    period     = time unit or time adverb of any language known

A currency, period or multiplier that only one amount of a clause states holds for
all of them (the first stated one, for multipliers the last); a bracketed clause may add
the currency, but its amounts are equivalents of the ones before and are not read again. A
clause that speaks of something else than base pay (:data:`NOT_BASE`) states none.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

BASE = ("money", "time", "length", "mass", "temperature")
Vector = tuple[int, int, int, int, int]
ZERO: Vector = (0, 0, 0, 0, 0)


def vector(**powers: int) -> Vector:
    return tuple(powers.get(b, 0) for b in BASE)  # type: ignore[return-value]


@dataclass(frozen=True)
class Unit:
    """``canonical = value * scale + offset`` in the canonical unit of ``dims``."""

    dims: Vector
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.dims, other.dims, strict=True)), self.scale * other.scale)  # type: ignore[arg-type]

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, n: int) -> Unit:
        return Unit(tuple(a * n for a in self.dims), self.scale**n)  # type: ignore[arg-type]

    def canonical(self, value: Decimal | int | Fraction) -> Fraction:
        return Fraction(value) * self.scale + self.offset


def _unit(dims: Vector, scale: str = "1", offset: str = "0") -> Unit:
    return Unit(dims, Fraction(scale), Fraction(offset))


_T, _L, _M, _K = vector(time=1), vector(length=1), vector(mass=1), vector(temperature=1)
#: Units and their scale to second, metre, kilogram and kelvin.
PHYSICAL = {
    "s": _unit(_T), "sec": _unit(_T), "second": _unit(_T), "min": _unit(_T, "60"), "minute": _unit(_T, "60"),
    "h": _unit(_T, "3600"), "hour": _unit(_T, "3600"), "day": _unit(_T, "86400"), "week": _unit(_T, "604800"),
    "m": _unit(_L), "metre": _unit(_L), "meter": _unit(_L), "mm": _unit(_L, "0.001"), "cm": _unit(_L, "0.01"), "km": _unit(_L, "1000"),
    "in": _unit(_L, "0.0254"), "inch": _unit(_L, "0.0254"), "ft": _unit(_L, "0.3048"), "foot": _unit(_L, "0.3048"),
    "yd": _unit(_L, "0.9144"), "mi": _unit(_L, "1609.344"), "mile": _unit(_L, "1609.344"),
    "kg": _unit(_M), "g": _unit(_M, "0.001"), "mg": _unit(_M, "0.000001"), "t": _unit(_M, "1000"),
    "lb": _unit(_M, "0.45359237"), "oz": _unit(_M, "0.028349523125"),
    "k": _unit(_K), "°c": _unit(_K, "1", "273.15"), "°f": _unit(_K, "5/9", "45967/180"),
}


def parse_unit(text: str, table: dict[str, Unit] | None = None) -> Unit | None:
    """A unit expression such as ``kg*m/s^2``; null if a part is unknown."""
    table = PHYSICAL if table is None else table
    out, sign = Unit(ZERO), 1
    parts = re.findall(r"[*·/]|[^\s*·/^]+(?:\^-?\d+)?", text.strip().lower())
    if not parts:
        return None
    for part in parts:
        if part in "*·/":
            sign = -1 if part == "/" else 1
            continue
        name, _, power = part.partition("^")
        unit = table.get(name) or table.get(name.rstrip("s"))
        if unit is None:
            return None
        n = sign * int(power or 1)
        out = unit if len(parts) == 1 and n == 1 else out * unit**n
        sign = 1
    return out


#: Currency signs and words.
CURRENCIES = {
    "$": "USD", "us$": "USD", "usd": "USD", "usd$": "USD", "dollar": "USD", "dollars": "USD", "us dollar": "USD", "us dollars": "USD",
    "c$": "CAD", "ca$": "CAD", "cad": "CAD", "canadian dollars": "CAD", "a$": "AUD", "au$": "AUD", "aud": "AUD", "australian dollars": "AUD",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "pounds sterling": "GBP", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "₹": "INR", "inr": "INR", "rs.": "INR", "rs": "INR", "rupees": "INR", "chf": "CHF", "sfr": "CHF", "fr.": "CHF", "francs": "CHF", "franken": "CHF",
    "pln": "PLN", "zł": "PLN", "zl": "PLN", "zlotys": "PLN", "złotych": "PLN",
}
#: Words for the time a rate counts by.
PERIODS = {
    "year": "year years yr yrs annum annual annually yearly annualized annualised p.a. pa p/a jahr jahre jährlich jaehrlich annuel annuels annuelle année annee año ano anual anno annuo jaar jaarlijks rok rocznie roku",
    "month": "month months mo monthly pcm p.m. monat monatlich mois mensuel mensuels mes mese mensual mensile mês maand maandelijks mies. mies miesiąc miesięcznie",
    "fortnight": "fortnight fortnightly biweekly",
    "week": "week weeks weekly wk p.w. pw woche wöchentlich semaine semana settimana tydz. tydz tydzień tygodniowo",
    "day": "day daily p.d. pd tag täglich jour día dia giorno dag dzień dziennie",
    "hour": "hour hours hourly hr hrs h p.h. ph stunde std. std stündlich heure hora ora uur godz. godz godzinę",
}
PERIOD_OF = {w: p for p, words in PERIODS.items() for w in words.split()}
#: Number multipliers.
MULTIPLIERS = {
    "k": 1000, "thousand": 1000, "tsd.": 1000, "tsd": 1000, "mille": 1000, "tys.": 1000, "tys": 1000, "m": 1000000, "mn": 1000000, "mio": 1000000, "mio.": 1000000, "million": 1000000,
    "l": 100000, "lakh": 100000, "lakhs": 100000, "lac": 100000, "lacs": 100000, "crore": 10000000, "crores": 10000000, "cr": 10000000,
}
#: Words that carry a multiplier and units at once.
COMPOSITE = {"lpa": (100000, "INR", "year"), "teur": (1000, "EUR", None), "t€": (1000, "EUR", None), "tchf": (1000, "CHF", None)}
#: English number words.
UNITS_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS_WORDS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: What a clause speaks of if it isn't base pay.
NOT_BASE = (
    r"bonus|equity|stock|shares?\b|rsu|options?\b|relocation|sign(?:ing)?[- ]?on|signing|referral|raised|funding|\bmatch|401kplan|budget|stipend|allowance|holiday|"
    r"\bpto\b|vacation|require|experience|grade|level|\bteam\b|headcount|commission|\bote\b|pension|insurance|reimburs|per diem|days? off|zuschuss|urlaub|prämie|umzug"
)

_WORD = {w: i for i, w in enumerate(UNITS_WORDS)} | {w: 10 * i for i, w in enumerate(TENS_WORDS, 2)}
_ANY = "|".join(sorted(_WORD, key=len, reverse=True))
_WORDS = re.compile(rf"\b(?:{_ANY})(?:[\s-]+(?:(?:hundred\s+and|hundred|thousand|million|{_ANY})\b))*", re.I)
_NUMBER = (
    r"\d{1,3}(?:[ \u00a0\u2009\u202f'’]\d{3})+(?:[.,]\d{1,2})?(?!\d)"
    r"|\d{1,2}(?:,\d{2})*,\d{3}(?:\.\d+)?(?!\d)|\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d{1,3}(?:\.\d{3})+(?:,\d+)?(?!\d)|\d+(?:[.,]\d+)?"
)
_TOKEN = re.compile(
    rf"(?P<num>{_NUMBER})|(?P<cur>us dollars?|us\$|usd|ca\$|c\$|au\$|a\$|\$|£|€|₹|rs\.?(?!\w)|[^\W\d_]+(?:\.[^\W\d_]+\.)?\.?)|(?P<pct>%)|(?P<sym>[^\s\w])",
    re.I,
)


def _words_to_number(text: str) -> str:
    total, part = 0, 0
    for w in re.findall(r"[a-z]+", text.lower()):
        if w in _WORD:
            part += _WORD[w]
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in ("thousand", "million"):
            total += max(part, 1) * (1000 if w == "thousand" else 1000000)
            part = 0
    return str(total + part)


def _to_decimal(text: str, multiplied: bool) -> Decimal:
    s = re.sub(r"[ \u00a0\u2009\u202f'’]", "", text)
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0 and dot >= 0:
        mark = max(comma, dot)
        return Decimal(re.sub(r"[.,]", "", s[:mark]) + "." + s[mark + 1 :])
    mark = max(comma, dot)
    if mark >= 0:
        sign = s[mark]
        after = len(s) - mark - 1
        grouped = s.count(sign) > 1 or (after == 3 and not s.startswith("0") and not (sign == "." and multiplied))
        s = s.replace(sign, "") if grouped else s[:mark].replace(sign, "") + "." + s[mark + 1 :]
    return Decimal(s)


@dataclass(frozen=True)
class Amount:
    """An amount with the unit a text gives it: ``currency`` per ``period``."""

    value: Decimal
    currency: str
    period: str

    def unit(self, table: dict[str, Unit]) -> Unit | None:
        """The unit built from its parts; null if the table lacks one of them."""
        money, time = table.get(self.currency), table.get(self.period)
        return money / time if money is not None and time is not None else None


@dataclass
class _Number:
    text: str
    multiplier: int | None = None
    percent: bool = False


class _Clause:
    """Recursive descent over the tokens of one clause."""

    def __init__(self, text: str) -> None:
        self.tokens = list(_TOKEN.finditer(text))
        self.at = 0
        self.numbers: list[_Number] = []
        self.currency: str | None = None
        self.period: str | None = None

    def parse(self) -> _Clause:
        while self.at < len(self.tokens):
            if self.tokens[self.at]["num"]:
                self.amount()
            else:
                self.unit_or_word()
        return self

    def word(self) -> str:
        """The token at hand in small letters, empty at the end and for numbers."""
        return self.tokens[self.at][0].lower() if self.at < len(self.tokens) and not self.tokens[self.at]["num"] else ""

    def amount(self) -> None:
        self.numbers.append(_Number(self.tokens[self.at][0]))
        self.at += 1
        self.suffix(self.numbers[-1])

    def suffix(self, number: _Number) -> None:
        """What stands right after a number and belongs to it alone."""
        token = self.word()
        if token == "%":
            number.percent = True
        elif token in MULTIPLIERS and token not in COMPOSITE:
            number.multiplier = MULTIPLIERS[token]
        elif token[:1] in ("k", "m", "l") and token[1:] in CURRENCIES and token not in PERIOD_OF and token not in COMPOSITE:
            number.multiplier, self.currency = MULTIPLIERS[token[0]], CURRENCIES[token[1:]]
        else:
            return
        self.at += 1

    def unit_or_word(self) -> None:
        token = self.word()
        self.at += 1
        if token == "%" and self.numbers:
            self.numbers[-1].percent = True
        elif token in COMPOSITE:
            multiplier, currency, period = COMPOSITE[token]
            if self.numbers:
                self.numbers[-1].multiplier = multiplier
            self.currency, self.period = self.currency or currency, self.period or period
        elif token in CURRENCIES:
            self.currency = self.currency or CURRENCIES[token]
        else:
            self.period = self.period or PERIOD_OF.get(token) or PERIOD_OF.get(token.rstrip("."))

    def amounts(self, outer_currency: str | None) -> list[Amount]:
        plain = [n for n in self.numbers if not n.percent]
        currency = self.currency or outer_currency
        shared = next((n.multiplier for n in reversed(plain) if n.multiplier), None)
        out = []
        for n in plain:
            value = _to_decimal(n.text, bool(n.multiplier or shared))
            value *= n.multiplier or (shared if shared and value < 1000 else 1)
            if currency is None and self.period is None and shared is None and value < 1000:
                continue  # a bare small number is no pay
            if value > 0:
                out.append(Amount(value, currency or "USD", self.period or "year"))
        return out


def _clause(text: str, outer_currency: str | None) -> list[Amount]:
    """The amounts a clause states, with the units it gives them; may be empty."""
    return _Clause(re.sub(r"\bpar\s+an\b", "annuel", text)).parse().amounts(outer_currency)


@lru_cache(maxsize=65536)
def parse_pay(text: str) -> tuple[Amount, ...]:
    """Every stated amount of base pay in a text, in the order of the text."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    s = _WORDS.sub(lambda m: _words_to_number(m[0]) if re.search(r"hundred|thousand|million", m[0], re.I) else m[0], s)
    s = re.sub(r"401\s*\(k\)|\b401k\b(?=\s+(?:with|match|plan))", "401kplan", s, flags=re.I)
    inner = re.findall(r"\(([^()]*)\)", s)
    outer = re.sub(r"\([^()]*\)", " ", s)
    outer_currency = next((CURRENCIES[w.lower()] for x in inner for w in re.findall(r"[^\s\d/]+", x) if w.lower() in CURRENCIES and not re.search(r"\d", x)), None)
    amounts: list[Amount] = []
    for clause in re.split(r";|\bplus\b|\s\+\s|,\s+(?=\d+(?:\.\d+)?\s*%)|\s(?=OTE\b)|\n", outer):
        if re.search(NOT_BASE, clause, re.I):
            continue
        amounts += _clause(clause, outer_currency)
    if not amounts and inner:
        for clause in inner:
            if not re.search(NOT_BASE, clause, re.I):
                amounts += _clause(clause, outer_currency)
    return tuple(amounts)
