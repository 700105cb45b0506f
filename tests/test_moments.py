from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from leadloom.operators.moments import normalise_moments, utc_text

FEEDS = "import_source string, time_zone string, date_order string"
ROWS = "id long, import_source string, posted_at string, created_at string, extra string"
CASES = [
    ("us", "2024-06-05T14:47", "2024-06-05T18:47:00Z"), ("us", "06/04/2024 18:23", "2024-06-04T22:23:00Z"), ("de", "04.06.2024 02:49", "2024-06-04T00:49:00Z"),
    ("de", "4/6/2024 2:49 PM", "2024-06-04T12:49:00Z"), ("us", "1717366227", "2024-06-02T22:10:27Z"), ("us", "1717413513175", "2024-06-03T11:18:33Z"), ("us", "1712826091769577", "2024-04-11T09:01:31Z"),
    (None, "2024-06-02T09:00:00.5+02:00", "2024-06-02T07:00:00Z"), (None, "Sun, 02 Jun 2024 18:38:10 -0400", "2024-06-02T22:38:10Z"), (None, "20240602T135118Z", "2024-06-02T13:51:18Z"),
    ("us", "20240602", "2024-06-02T04:00:00Z"), ("de", "12. Mai 2024", "2024-05-11T22:00:00Z"), ("de", "21. September 2024, 11:23 Uhr", "2024-09-21T09:23:00Z"), ("us", "May 29th, 2024", "2024-05-29T04:00:00Z"),
    (None, "2024-06-04 13:05 UTC+08:00", "2024-06-04T05:05:00Z"), (None, "2024-12-04 10:00 BST", "2024-12-04T09:00:00Z"), ("us", "2024-06-05 09:43 CST", "2024-06-05T15:43:00Z"),
    ("us", "2024-06-04T15:33:02[Europe/Berlin]", "2024-06-04T13:33:02Z"), ("us", "2024-11-03 01:30:00", "2024-11-03T05:30:00Z"), ("us", "2024-03-10 02:30:00", "2024-03-10T07:30:00Z"),
    ("us", "  2024-06-05T08:10:58Z\n", "2024-06-05T08:10:58Z"), ("us", "12/31/2024 12:00 AM", "2024-12-31T05:00:00Z"),
    ("us", "yesterday", None), ("us", "2025", None), ("us", "", None), ("us", "Posted 30+ Days Ago", None), ("us", "2024-02-30", None), ("us", "25:99", None), ("us", "x" * 100000, None), ("us", "2024-06-04T15:33:02[No/Where]", None),
]


def run(spark, rows, feeds=(("us", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"))):
    df = spark.createDataFrame(rows, ROWS)
    out = normalise_moments(df, "id", ["posted_at"], "import_source", "created_at", spark.createDataFrame(list(feeds), FEEDS))
    return {r["id"]: (r["t"], r["ambiguous"]) for r in out.withColumn("t", utc_text(F.col("moment"))).collect()}


def test_notations(spark):
    got = run(spark, [(i, s, v, "2024-06-05 00:00:00", "x") for i, (s, v, _) in enumerate(CASES)])
    for i, (s, v, want) in enumerate(CASES):
        assert got[i] == (want, False), (s, v[:60], got[i])


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, None), (2, "us", "2024-06-02", None, None), (2, "us", "2024-06-02", None, None)]
    assert run(spark, rows) == {2: ("2024-06-02T04:00:00Z", False)}
    assert run(spark, []) == {}


def test_mixture_learns_an_undeclared_order(spark):
    rows = [(i, "x", f"{13 + i % 15}/0{1 + i % 9}/2024", "2024-06-05 00:00:00", None) for i in range(60)] + [(99, "x", "03/04/2024", "2024-06-05 00:00:00", None)]
    assert run(spark, rows, [("us", "UTC", "mdy")])[99] == ("2024-04-03T00:00:00Z", False)


def test_no_count_outweighs_a_declared_order(spark):
    others = spark.range(300_000).selectExpr("id", "'de' import_source", "'13.01.2024' posted_at", "'2024-06-05 00:00:00' created_at")
    one = spark.createDataFrame([(-1, "us", "03/01/2024", "2024-06-05 00:00:00")], others.schema)
    feeds = spark.createDataFrame([("us", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy")], FEEDS)
    out = normalise_moments(others.unionByName(one), "id", ["posted_at"], "import_source", "created_at", feeds).filter("id = -1")
    assert [(r["t"], r["ambiguous"]) for r in out.withColumn("t", utc_text(F.col("moment"))).collect()] == [("2024-03-01T05:00:00Z", False)]


def test_even_mixture_is_marked_ambiguous(spark):
    assert run(spark, [(1, "x", "03/04/2024", None, None)], [("us", "UTC", "mdy")])[1] == (None, True)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Europe/London"])
def test_zone_against_zoneinfo(spark, zone):
    start = datetime(2024, 1, 1, 0, 30)
    walls = [start + timedelta(hours=37 * k) for k in range(240)]
    got = run(spark, [(i, "z", w.strftime("%Y-%m-%d %H:%M:%S"), None, None) for i, w in enumerate(walls)], [("z", zone, "mdy")])
    for i, w in enumerate(walls):
        assert got[i][0] == w.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
