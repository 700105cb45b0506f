import json

from pyspark.sql import functions as F

from leadloom.operators import dedupe, merging, selection, timeline
from leadloom.plans.queries import portal_canonical_urls
from leadloom.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merging(spark):
    a = spark.createDataFrame([("x", "1", None), ("y", "2", "b")], "k string, p string, q string")
    b = spark.createDataFrame([("x", "0", "z"), ("w", "9", None)], "k string, p string, q string")
    assert rows(merging.merge_snapshots(a, b, "k", {"p": "min", "q": "fill"})) == [("w", "9", None), ("x", "0", "z"), ("y", "2", "b")]
    assert rows(merging.merge_snapshots(a, a, "k", {"p": "max", "q": "source"})) == rows(a)
    assert dict(rows(merging.classify_upsert(a, b, "k", ["p", "q"]))) == {"x": "updated", "y": "untouched", "w": "created"}
    assert set(dict(rows(merging.classify_upsert(a, a, "k", ["p", "q"]))).values()) == {"unchanged"}
    done = merging.backfill(a, {"q": F.col("p")})
    assert rows(merging.change_counts(done)) == [("q", 1)] and rows(done.select("k", "q")) == [("x", "1"), ("y", "b")]
    kids = spark.createDataFrame([(1, None), (2, "n")], "job_id long, note string")
    moved = merging.remap_children(kids, "job_id", spark.createDataFrame([(1, 10), (2, 10)], "old long, new long"), spark.createDataFrame([(10, None)], "job_id long, note string"), ["job_id", "note"])
    assert rows(moved.select("job_id", "note")) == [(10, "n")]


def test_dedupe_and_timeline(spark):
    old = spark.createDataFrame([(1, "u", None), (2, None, "k"), (3, "u", "k")], "id long, url string, ident string")
    new = spark.createDataFrame([("u", "k"), (None, "k"), (None, None)], "url string, ident string")
    assert rows(dedupe.lookup(new, old, "id", [("url", ["url"]), ("ident", ["ident"])]).select("match_id", "match_rule")) == [(1, "url"), (2, "ident"), (None, None)]
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "k long, s string, t long")
    assert rows(timeline.latest_per_key(log, "k", "s", [F.col("t")])) == [(1, "b"), (2, "x")]
    assert rows(timeline.transitions(log, "k", "s", [F.col("t")], [("b", "a")]).select("s", "allowed")) == [("a", True), ("b", False), ("x", True)]
    assert rows(timeline.first_wins(log.withColumn("n", F.lit(None).cast("string")), ["n"], [F.col("t"), F.col("k")]).select("s", "kept")) == [("a", True), ("b", False), ("x", False)]


def test_limits_come_before_ranks(spark, sf):
    df = selection.ranked(spark.read.parquet(f"{sf}/jobs.parquet").select("id"), [F.asc("id")], 3)
    assert [r["rank"] for r in df.orderBy("id").collect()] == [1, 2, 3]
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_files(spark, tmp_path):
    leads = [{"source": "s", "company": " A  B ", "title": "t", "location": "l", "portal_type": "LEVER", "apply_url": 5}, {"source": "s"}, 7]
    (tmp_path / "a.json").write_text(json.dumps(leads))
    got = {r["record_number"]: r for r in readers.lead_records(spark, str(tmp_path / "a.json")).collect()}
    assert got[1]["company"] == "A B" and got[1]["portal_type"] == "lever" and got[1]["apply_url"] is None and got[1]["error"] is None
    assert got[2]["error"] == "missing: company, title, location" and got[3]["error"] == "record is no object"
    (tmp_path / "l.txt").write_text("# c\n\nAcme | acme.com | x | y\nhttps://www.b.org/jobs\nJust A Name\n")
    lines = readers.company_lines(readers.lines(spark, str(tmp_path / "l.txt"))).collect()
    assert [tuple(r) for r in lines] == [("Acme", "acme.com", "x | y"), (None, "b.org", None), ("Just A Name", None, None)]
    (tmp_path / "r.json").write_text(json.dumps(["https://a", {"url": "https://b", "company": "B"}, {"x": 1}]))
    assert rows(readers.registry_json(spark, str(tmp_path / "r.json"))) == [("https://a", None), ("https://b", "B")]
    (tmp_path / "m.json").write_text(json.dumps({"created_at": "2024-01-01T00:00:00Z", "item_count": 2, "items": [{"rank": 1}]}))
    assert readers.manifests(spark, str(tmp_path / "m.json")).first()["problem"] == "item_count differs from items"
    df = spark.createDataFrame([("a", ["x", "y"]), (None, [])], "k string, v array<string>")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).select("v").dropna().toPandas()["v"]) == ["x; y"]
    writers.write_lines(df, "k", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 1
    assert spark.read.parquet(writers.write_version(df, str(tmp_path / "t"), "1")).count() == 2


def test_portal_forms(spark, sf):
    for r in portal_canonical_urls(spark, sf).filter("portal = 'greenhouse'").collect():
        assert r["canonical"].startswith(("http://boards.hireglade.example/", "https://boards.hireglade.example/")) and "utm_" not in r["canonical"] and r["job_id"]


def test_stream_counts_each_event_once(spark, tmp_path, sf):
    from leadloom.streaming import log

    part = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    part.coalesce(1).write.parquet(str(tmp_path / "in"))
    part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = log.deduplicated(log.read_log(spark, str(tmp_path / "in"), part._jdf.schema().toDDL()), "event_id", "ts", "400 days")
    q = s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("once").count() == part.count()
