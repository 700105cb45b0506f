"""Mixed timestamp notations and zones to one UTC moment.

Every value is read by Catalyst expressions only. A value has up to two valid
readings (month first, day first); which one holds is decided per source by
expectation-maximisation over the mixture of the two formats:

* each reading has a likelihood: how usual its distance from the row's reference
  moment is, learned from the values with one valid reading;
* a source's share of month-first values is re-estimated from the posteriors of
  its values. A declared order of the source is a prior that no count outweighs;
* the posterior of a value chooses its reading; where neither reaches
  ``min_posterior`` the result is null and ``ambiguous`` is true.

The loop runs inside Catalyst on one row per source that holds the counts by
likelihood class (at most ``_CLASSES`` squared), so nothing comes to the driver.

Defined results: null, blank, vague, relative and year-only values give null and
``ambiguous`` false; impossible dates (Feb 30) give null; a wall-clock time that
occurs twice is its first occurrence and a skipped one is read with the offset
before the change (both are the rules of ``java.time``); repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets in minutes of zone abbreviations, all year.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240,
    "ADT": -180, "NST": -210, "NDT": -150, "BRT": -180, "ART": -180, "JST": 540,
    "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "NZST": 720, "NZDT": 780,
}
#: First letters of month names (en, de, fr, es, it, pt, nl, pl), accents folded.
MONTHS = {
    "jan": 1, "ene": 1, "gen": 1, "sty": 1, "feb": 2, "fev": 2, "lut": 2, "mar": 3, "mrz": 3, "maa": 3,
    "mrt": 3, "apr": 4, "avr": 4, "abr": 4, "kwi": 4, "may": 5, "mai": 5, "mei": 5, "mag": 5, "maj": 5,
    "jun": 6, "juin": 6, "giu": 6, "cze": 6, "jul": 7, "juil": 7, "lug": 7, "lip": 7, "aug": 8, "aou": 8,
    "ago": 8, "sie": 8, "sep": 9, "set": 9, "wrz": 9, "oct": 10, "okt": 10, "ott": 10, "out": 10,
    "paz": 10, "nov": 11, "lis": 11, "dec": 12, "dez": 12, "dic": 12, "gru": 12,
}

_CLASSES = 24
_NO_SOURCE = "\u0000none"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _at(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)"))


def _month_number(name: Column) -> Column:
    folded = F.translate(F.lower(name), "äéèêûôç", "aeeeuoc")
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring(folded, 1, 4)), F.try_element_at(table, F.substring(folded, 1, 3)))


def _known_zone(name: Column) -> Column:
    return F.when(name.isin(sorted(available_timezones())), name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable.

    The value is computed once however often the body names it, and predicates
    pushed below a projection copy the expression at most once per use instead of
    once per path.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_moment(text: Column) -> Column:
    """Struct of the readings of a text.

    ``ymd`` / ``mdy`` / ``dmy``: wall-clock ``timestamp_ntz`` under each valid
    date order (``ymd`` stands for every notation with one reading), ``epoch``:
    UTC ``timestamp_ntz``, ``offset``: minutes east or null, ``zone``: a named
    zone or null, ``ok``: zone text understood.

    A notation is rewritten once to ``kind|year|month|day|rest``; later steps only
    split that text.
    """
    blank = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\ufeff]+"
    clean = F.regexp_replace(F.translate(text, "０１２３４５６７８９", "0123456789"), f"^{blank}|{blank}$", "")
    clean = F.regexp_replace(clean, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    return let(clean, lambda v: let(F.split(_shape(v), r"\|", 5), lambda s: let(_clock(s), lambda t: let(_parts(v, s, t), _readings))))


def _shape(v: Column) -> Column:
    iso = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)(.*)$"
    basic = r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(\d{2})?(.*))?$"
    numeric = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?!\d)(.*)$"
    day_first = r"^(\d{1,2})(?:\.|st|nd|rd|th)?\s+(\p{L}{3,})\.?,?\s+(\d{4})(?!\d)(.*)$"
    month_first = r"^(\p{L}{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)(.*)$"
    return (
        F.when(v.rlike(r"^(?:\d{10}|\d{13}|\d{16})$"), F.concat(F.lit("e|"), v))
        .when(v.rlike(iso), F.regexp_replace(v, iso, "y|$1|$3|$4|$5"))
        .when(v.rlike(numeric), F.regexp_replace(v, numeric, "n|$4|$1|$3|$5"))
        .when(v.rlike(basic), F.regexp_replace(v, basic, "y|$1|$2|$3|$4:$5:$6 $7"))
        .when(v.rlike(day_first), F.regexp_replace(v, day_first, "w|$3|$2|$1|$4"))
        .when(v.rlike(month_first), F.regexp_replace(v, month_first, "w|$3|$1|$2|$4"))
    )


def _clock(s: Column) -> Column:
    """Hour, minute, second, a or p, zone text."""
    time_of = r"^(?:[\s,]*|[Tt])(\d{1,2}):(\d{2}):?(\d{2})?(?:[.,]\d+)?\s*(?i:uhr\b)?\s*(?i:([ap])\.?m\.?(?![a-z]))?\s*(.*)$"
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.get(s, F.lit(4)), r"^::\s*$", ""), r":\s", ":00 "))
    return F.split(let(rest, lambda r: F.when(r.rlike(time_of), F.regexp_replace(r, time_of, "$1|$2|$3|$4|$5")).otherwise(F.concat(F.lit("0|0|0||"), r))), r"\|", 5)


def _parts(v: Column, s: Column, t: Column) -> Column:
    off = r"(?i)^(?:UTC|GMT)?\s*([+\-−])(\d{1,2}):?(\d{2})?(?:\[[^\]]*\])?$"
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    kind, tail, half = F.get(s, F.lit(0)), F.trim(F.get(t, F.lit(4))), F.upper(F.get(t, F.lit(3)))
    minutes = _int(F.regexp_extract(tail, off, 2)) * 60 + F.coalesce(_int(F.regexp_extract(tail, off, 3)), F.lit(0))
    hour = let(_int(F.get(t, F.lit(0))), lambda h: F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "P", 12).otherwise(0)))
    month = F.get(s, F.lit(2))
    number = F.when(kind == "e", v).try_cast("decimal(20,0)")
    return F.struct(
        kind.alias("k"), _int(F.get(s, F.lit(1))).alias("y"), F.when(kind == "w", _month_number(month)).otherwise(_int(month)).alias("m"), _int(F.get(s, F.lit(3))).alias("d"),
        hour.alias("h"), _int(F.get(t, F.lit(1))).alias("mi"), F.coalesce(_int(F.get(t, F.lit(2))), F.lit(0)).alias("se"), tail.alias("tail"),
        F.when(tail.rlike(off), F.when(tail.rlike(r"^[^+]*[-−]\d"), -minutes).otherwise(minutes)).otherwise(F.try_element_at(fixed, F.upper(tail))).alias("offset"),
        F.when(tail.contains("/"), _known_zone(F.regexp_extract(tail, r"^\[?([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\]?$", 1))).alias("zone"),
        F.when(F.length(v) == 10, number).when(F.length(v) == 13, F.floor(number / 1000)).otherwise(F.floor(number / 1000000)).alias("s"),
    )


def _readings(x: Column) -> Column:
    clock = (x["h"], x["mi"], x["se"])
    first, second = _at(x["y"], x["m"], x["d"], *clock), _at(x["y"], x["d"], x["m"], *clock)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x["s"].cast("decimal(18,6)"))
    return F.struct(
        F.when(x["k"].isin("y", "w"), first).alias("ymd"),
        F.when(x["k"] == "n", first).alias("mdy"),
        F.when(x["k"] == "n", second).alias("dmy"),
        F.when(x["k"] == "e", epoch).alias("epoch"),
        x["offset"].alias("offset"),
        x["zone"].alias("zone"),
        (F.coalesce(x["tail"] == "", F.lit(True)) | x["offset"].isNotNull() | x["zone"].isNotNull()).alias("ok"),
    )


def _to_utc(wall: Column, p: Column, zone: Column) -> Column:
    shifted = wall - F.make_dt_interval(F.lit(0), F.lit(0), p["offset"], F.lit(0).cast("decimal(18,6)"))
    return F.when(p["offset"].isNotNull(), shifted).otherwise(F.convert_timezone(F.coalesce(p["zone"], zone), F.lit("UTC"), wall))


def utc_text(moment: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a UTC ``timestamp_ntz``, fractions dropped, in any session zone."""
    s = moment.cast("string")
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("Z"))


def _gap_class(moment: Column, reference: Column) -> Column:
    """Signed log2 class of the days between a reading and the reference moment; null without a reading."""
    days = F.datediff(moment, reference).cast("double")
    size = F.least(F.floor(F.log2(F.abs(days) + 1) * 2), F.lit(_CLASSES // 2 - 1))
    return F.when(moment.isNotNull(), F.coalesce(F.signum(days) * size, F.lit(_CLASSES // 2))).cast("int")


def source_orders(readings: DataFrame, feeds: DataFrame, iterations: int = 20) -> DataFrame:
    """Share of month-first values of each source, by expectation-maximisation.

    ``readings``: source, mdy, dmy, reference. ``feeds``: source, date_order.
    One row per source that has numeric dates: source, p_mdy, and the likelihood
    table ``like`` (class to probability) that the posteriors use.
    """
    # No filter on the readings: it would be pushed into the parser's projections.
    r = readings.select("source", _gap_class(F.col("mdy"), F.col("reference")).alias("cm"), _gap_class(F.col("dmy"), F.col("reference")).alias("cd"))
    cells = r.groupBy("source", "cm", "cd").agg(F.count(F.coalesce("cm", "cd")).alias("n"))
    single = F.col("cm").isNull() | F.col("cd").isNull() | (F.col("cm") == F.col("cd"))
    hist = cells.groupBy(F.coalesce("cm", "cd").alias("c")).agg(F.coalesce(F.sum(F.when(single, F.col("n"))), F.lit(0)).alias("n"))
    like = hist.agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", F.col("n").cast("double").alias("n"))))).alias("counts"))
    like = like.select((F.size("counts") >= 0).alias("one"), "counts", F.expr("aggregate(map_values(counts), 0D, (a, x) -> a + x)").alias("total"))
    per = cells.groupBy("source").agg(F.collect_list(F.struct("cm", "cd", "n")).alias("cells")).withColumn("one", F.size("cells") >= 0)
    per = per.join(like, "one", "left").drop("one")
    per = per.join(feeds.select("source", "date_order"), "source", "left")

    def lk(c: Column, counts: Column, total: Column) -> Column:
        n = F.coalesce(F.try_element_at(counts, c), F.lit(0.0))
        return F.when(c.isNull(), F.lit(0.0)).otherwise((n + 1e-3) / (F.coalesce(total, F.lit(0.0)) + 1e-3 * 2 * _CLASSES))

    pairs = F.transform("cells", lambda x: F.struct(lk(x["cm"], F.col("counts"), F.col("total")).alias("m"), lk(x["cd"], F.col("counts"), F.col("total")).alias("d"), x["n"].cast("double").alias("n")))
    per = per.withColumn("pairs", pairs).withColumn("size", F.expr("aggregate(pairs, 0D, (a, x) -> a + x.n)"))
    em = F.expr(
        f"aggregate(sequence(1, {int(iterations)}), 0.5D, (p, i) -> "
        "(1D + aggregate(pairs, 0D, (a, x) -> a + x.n * coalesce(try_divide(p * x.m, p * x.m + (1D - p) * x.d), 0.5D))) / (2D + size))"
    )
    p = F.when(F.col("date_order") == "mdy", 1 - 1e-9).when(F.col("date_order") == "dmy", 1e-9).otherwise(em)
    return per.select("source", p.alias("p_mdy"), "counts", "total")


def normalise_moments(
    df: DataFrame,
    id_col: str,
    fields: Sequence[str],
    source_col: str,
    reference_col: str,
    feeds: DataFrame,
    min_posterior: float = 0.8,
) -> DataFrame:
    """One row per row of ``df`` and field: id, field_name, raw, moment (UTC ``timestamp_ntz``), ambiguous.

    ``feeds``: import_source, time_zone, date_order. Extra columns of ``df`` are not
    read, so names that clash cannot matter.
    """
    feeds = feeds.groupBy(F.col("import_source").alias("source")).agg(F.first("time_zone", True).alias("time_zone"), F.first("date_order", True).alias("date_order"))
    feeds = feeds.filter(F.col("source").isNotNull()).withColumn("time_zone", _known_zone(F.col("time_zone")))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])
    long = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit(_NO_SOURCE)).alias("source"),
        F.regexp_extract(F.col(reference_col), r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", 0).try_cast("timestamp_ntz").alias("reference"),
        F.explode(pairs).alias("x"),
    ).select("_id", "source", "reference", "x.field_name", "x.raw").filter(F.col("raw").isNotNull())
    parsed = long.withColumn("p", parse_moment(F.col("raw")))
    numeric = long.filter(F.col("raw").rlike(r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"))
    numeric = numeric.withColumn("p", parse_moment(F.col("raw"))).select("source", "reference", "p.mdy", "p.dmy")
    orders = source_orders(numeric, feeds)
    per_source = feeds.select("source", "time_zone", "date_order").join(orders, "source", "full_outer")
    j = parsed.join(per_source, "source", "left")
    zone = F.coalesce(F.col("time_zone"), F.lit("UTC"))

    def lk(c: Column) -> Column:
        n = F.coalesce(F.try_element_at(F.col("counts"), c), F.lit(0.0))
        return (n + 1e-3) / (F.coalesce(F.col("total"), F.lit(0.0)) + 1e-3 * 2 * _CLASSES)

    p, ref = F.col("p"), F.col("reference")
    share = F.coalesce(F.col("p_mdy"), F.lit(0.5))

    def weights(x: Column) -> Column:
        return F.struct(
            F.when(x["mdy"].isNull(), 0.0).otherwise(share * lk(_gap_class(x["mdy"], ref))).alias("m"),
            F.when(x["dmy"].isNull(), 0.0).otherwise((1 - share) * lk(_gap_class(x["dmy"], ref))).alias("d"),
        )

    def decide(x: Column) -> Column:
        posterior = let(weights(x), lambda w: F.when(x["mdy"].eqNullSafe(x["dmy"]), 1.0).otherwise(F.try_divide(w["m"], w["m"] + w["d"])))
        numeric_wall = let(posterior, lambda q: F.when(F.greatest(q, 1 - q) >= min_posterior, F.when(q >= 0.5, x["mdy"]).otherwise(x["dmy"])))
        # A declared order holds wherever its reading is valid, whatever the counts say.
        declared = F.when(F.col("date_order") == "mdy", x["mdy"]).when(F.col("date_order") == "dmy", x["dmy"])
        return F.coalesce(x["ymd"], declared, numeric_wall)

    wall = let(p, decide)
    moment = F.when(F.col("p.epoch").isNotNull(), F.col("p.epoch")).when(F.col("p.ok"), let(wall, lambda w: _to_utc(w, p, zone)))
    unsure = F.col("p.ok") & (F.col("p.mdy").isNotNull() | F.col("p.dmy").isNotNull()) & wall.isNull()
    return j.select(F.col("_id").alias(id_col), "field_name", "raw", moment.alias("moment"), F.coalesce(unsure, F.lit(False)).alias("ambiguous"))
