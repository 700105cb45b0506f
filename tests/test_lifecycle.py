"""Small cases of resolution, selection and page parsing that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html, text, urls
from leadloom.operators import dedupe, merging, resolution, selection
from leadloom.sources import writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


JOBS = "g string, id long, status string, logged string, applied boolean, title string"


def test_group_plan(spark):
    r = [
        ("a", 1, "offer", None, False, "x y"), ("a", 2, " Opened ", None, True, "x"), ("b", 3, "superseded", "interview", False, "x"), ("b", 4, None, None, False, "x y z"),
        ("c", 5, "new", None, False, "x"), (None, 6, "new", None, False, "x"), (None, 7, "new", None, False, "x"), ("d", 8, "superseded", None, False, "x"), ("d", 9, "weird", None, False, "x"),
    ]
    df = spark.createDataFrame(r, JOBS)
    to = resolution.resolved_status(F.col("status"), F.col("logged"), F.col("applied"))
    q = text.title_quality(F.col("title"))
    got = {x["g"]: (x["rows"], x["winner"], x["winner_status"], x["superseded"], x["reactivated"], x["changed"]) for x in resolution.group_plan(df, "g", "id", F.col("status"), to, [q["words"], q["chars"]]).collect()}
    assert got == {"a": (2, 2, "applied", [1], [2], [1, 2]), "b": (2, 3, "interview", [4], [3], [3, 4]), "d": (2, 8, "new", [9], [8], [8, 9])}
    assert resolution.group_plan(df.limit(0), "g", "id", F.col("status"), to, [q["words"]]).count() == 0
    assert rows(resolution.preferred_rows(df, "g", "id", F.col("status"), [q["words"]])) == [("a", 1), ("b", 4), ("c", 5), ("d", 8)]


def test_change_statuses(spark):
    jobs = spark.createDataFrame([(1, "new"), (2, "applied"), (3, "offer"), (4, "odd"), (5, "interview")], "id long, status string")
    r = spark.createDataFrame(list(enumerate([1, 1, 2, 3, 4, 5, 99])), "seq long, id long")
    got = [x["reason"] for x in resolution.change_statuses(r, jobs, "interview").orderBy("seq").collect()]
    assert got == [None, "duplicate target ignored", None, "cannot move from offer to interview", "unsupported current status", "already interview", "job id was not found"]


def test_import_plan(spark):
    stored = spark.createDataFrame([(1, "u1", "c1", "k1"), (2, None, None, "k2")], "id long, apply_url string, canonical string, identity string")
    new = [(1, "u9", "c1", "k9", None), (2, None, None, "k2", None), (3, "u1", None, "k3", None), (4, None, None, "k4", None), (5, None, None, "k4", None), (6, "u8", None, "k1", None), (7, "u8", None, "k7", None), (8, "u7", None, "k1", "j")]
    got = {x[0]: x[1:] for x in map(tuple, resolution.import_plan(spark.createDataFrame(new, "seq long, apply_url string, canonical string, identity string, source_job_id string"), stored).collect())}
    ins = ("inserted", None, None)
    assert got == {1: ins, 2: ("duplicate", 2, "identity key match"), 3: ("duplicate", 1, "exact apply_url match"), 4: ins, 5: ("duplicate", None, "identity key match"), 6: ins, 7: ("duplicate", None, "exact apply_url match"), 8: ("duplicate", 1, "identity key match")}


def test_migration_and_limits(spark):
    t = spark.createDataFrame([(1, "a"), (7, "b")], "id long, k string")
    s = spark.createDataFrame([(1, "b"), (2, "c")], "id long, k string")
    added, mapping = resolution.migrate(t, s, "k", "id")
    assert rows(mapping) == [(1, 7), (2, 9)] and rows(added) == [(9, "c")]
    added, mapping = resolution.migrate(t.limit(0), s, "k", "id")
    assert rows(added) == rows(s) and rows(mapping) == [(1, 1), (2, 2)]
    assert resolution.clamped(50, 20)[0] == 20 and resolution.clamped(20, 20) == (20, None)
    with pytest.raises(ValueError, match="at least 1"):
        resolution.clamped(0, 20)


def test_numbered_over_many_tasks(spark):
    df = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("k")).repartition(7)
    got = [r["n"] for r in selection.numbered(df, [F.asc("k"), F.desc("id")], "n").orderBy(F.asc("k"), F.desc("id")).collect()]
    assert got == list(range(1, 5001)) and selection.numbered(df.limit(0), [F.asc("k")], "n").count() == 0


def test_references_columns_and_logs(spark):
    jobs = spark.createDataFrame([(17, "https://a", None), (18, None, "https://a")], "id long, apply_url string, canonical_apply_url string")
    assert [r["id"] for r in dedupe.by_reference(jobs, " 17 ").collect()] == [17] and dedupe.by_reference(jobs, "https://a").count() == 2
    with pytest.raises(ValueError, match="absolute URL"):
        dedupe.by_reference(jobs, "nothing")
    assert selection.with_columns(jobs, ["id", "nope"]).columns == ["id", "nope"]
    log = spark.createDataFrame([(1, "x")], "k long, v string")
    new = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "k long, v string")
    assert rows(writers.append_once(log, new, ["k"], [F.col("v")])) == [(2, "a", True)]
    assert rows(merging.with_defaults(spark.createDataFrame([(None,)], "v string"), {"v": F.lit("new")})) == [("new",)]


def test_urls_of_boards_and_tenants(spark):
    root = lambda u: one(spark, u, urls.board_root)
    assert root("https://boards.greenhouse.io/embed/job_app?for=acme&token=1") == "https://boards.greenhouse.io/acme" and root("https://boards.greenhouse.io/embed/job_app?token=1") is None
    hint = one(spark, "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/Ulm/Data-Engineer_R-77", urls.tenant_hints)
    assert tuple(hint) == ("acme", "Careers", "R-77")
    assert tuple(one(spark, "https://wd.workday.com/recruiting/acme/External", urls.tenant_hints)) == ("acme", "External", "External")
    assert [tuple(one(spark, u, urls.registry_url)) for u in ("ftp://x", " ", "https://h.example/a#b")] == [(None, "unsupported_scheme"), (None, "blank_source"), ("https://h.example/a", None)]
    assert one(spark, "x.gov.uk", urls.registrable_domain) == "x.gov.uk" and one(spark, "jobs.acme.com.sg", urls.domain_label) == "acme" and one(spark, "jobs.acme", urls.domain_label) == "jobs"
    assert one(spark, " ", lambda c: urls.search_plans(c, "https://s/")) is None
    assert one(spark, "The Acme Labs Inc", lambda c: text.short_slugs(c, F.lit("acme-io"))) == ["acme-io", "acmeio", "acme", "acme-labs-inc", "acmelabsinc"]


def test_page_parsers(spark):
    lever = f"<script>window.__leverPostings = {json.dumps({'company': 'Acme', 'postings': [{'id': 'a1', 'text': 'Data Engineer', 'categories': {'location': 'Ulm'}, 'hostedUrl': 'https://h/a1'}]})};</script>"
    attempt = lambda page, k: one(spark, page, lambda c: html.embedded_postings(c, html.LISTINGS[k]))
    got = attempt(lever, "lever")
    assert [(x["title"], x["company"], x["location"], x["apply_url"], x["source_job_id"]) for x in got["leads"]] == [("Data Engineer", "Acme", "Ulm", "https://h/a1", "a1")] and got["ambiguous"] is None
    assert attempt(lever.replace('"Ulm"', '""'), "lever")["ambiguous"] == "1 of 1 postings lack a title, location or address"
    assert attempt("<script>window.__leverPostings = {\"postings\": []};</script>", "lever")["empty"] and attempt("<p>none</p>", "lever")["leads"] == [] and attempt(None, "ashby")["leads"] == []

    def outcome(page, direct, f):
        return one(spark, page, lambda c: f(F.array(html.embedded_postings(c, html.LISTINGS["lever"]), html.linked_postings(c)), *([F.lit(direct)] if direct is not None else [])))

    assert outcome(lever, True, html.resolve_attempts)["outcome"] == "collected"
    assert outcome("<p>", False, html.resolve_attempts)["reason"] == "no complete postings"
    assert outcome("<script>window.__leverPostings = {\"postings\": []};</script>", None, html.count_attempts)["available"] == 0
    assert outcome("<p>", None, html.count_attempts)["outcome"] == "failed"
    title = "<title>Acme Careers - Jobs at Acme</title>"
    assert one(spark, title, lambda c: html.page_company(c, "Board")) == "Acme"
    assert html.place({"jobLocationType": "TELECOMMUTE"}) == "Remote" and html.place(["a", "a "]) == "a" and html.place(["a", "b"]) is None and html.place({"city": "Ulm", "country": {"name": "DE"}}) == "Ulm, DE"
    assert html.places_of([{"name": "A", "address": {"addressLocality": "B"}}, "A", None]) == ["A", "B"]
    assert one(spark, json.dumps({"x": [{"Total": 5}], "y": {"total": True}}), lambda c: html.nested_text(c, ["total"])) == "5" and one(spark, "{", lambda c: html.nested_text(c, ["a"])) is None
