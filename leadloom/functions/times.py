"""Column functions over timestamps kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_moment(c: Column) -> Column:
    """A text timestamp of any stored style as ``timestamp_ntz`` in UTC; unreadable gives null."""
    shape = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:Z|\+00(?::?00)?)?$"
    day = r"^\d{4}-\d{2}-\d{2}$"
    return F.when(c.rlike(shape), F.regexp_replace(c, shape, "$1 $2")).when(c.rlike(day), c).try_cast("timestamp_ntz")


def iso_z(moment: Column) -> Column:
    s = moment.cast("string")
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("Z"))


def freshness(posted: Column, found: Column) -> Column:
    """Whole seconds since 1970 of the posting moment, else of the finding moment, else 0."""
    seconds = [F.unix_seconds(text_moment(c).cast("timestamp")) for c in (posted, found)]
    return F.coalesce(F.nullif(seconds[0], F.lit(0)), seconds[1], F.lit(0))


def earliest(*columns: Column) -> Column:
    return F.least(*columns)


def latest(*columns: Column) -> Column:
    return F.greatest(*columns)


def within_days(c: Column, as_of: Column, days: int) -> Column:
    """Whether a text timestamp lies in the last ``days`` days before ``as_of``."""
    return text_moment(c) >= as_of - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))


def batch_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def is_strict_iso(c: Column) -> Column:
    """Whether a text is a full ISO timestamp with a zone that names a real moment."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
    return F.coalesce(c.rlike(shape) & F.regexp_replace(F.substring(c, 1, 19), "T", " ").try_cast("timestamp_ntz").isNotNull(), F.lit(False))
