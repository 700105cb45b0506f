import json
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html, text, times, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


def test_text(spark):
    assert one(spark, "  a  b\t", text.clean_text) == "a  b" and one(spark, " \n", text.clean_text) is None
    assert one(spark, " Straße,  X ", text.key_text) == "strasse x"
    assert one(spark, "Remote-first, US", lambda c: text.has_phrase(c, "remote")) and not one(spark, "remotely", lambda c: text.has_phrase(c, "remote"))
    assert one(spark, "The Acme & Sons Co. Ltd.", text.company_tokens) == ["acme", "and", "sons"] and one(spark, "Inc", text.company_key) is None
    assert one(spark, "  ..Run #7!", text.batch_slug) == "Run-7" and one(spark, "Çédille Ünï", text.ascii_slug) == "cedille-uni"
    assert one(spark, "a &amp;  b&eacute;", text.unescape_html) == "a & bé" and one(spark, "<b>x</b><i> y</i>", text.strip_tags) == "x y"
    assert one(spark, "Acme Data", lambda c: text.slug_candidates(c, F.lit("acme-data"))) == ["acme-data", "acmedata", "acme"]
    assert one(spark, "pg://u:secret@h/d?password=x", text.mask_secrets) == "pg://u:***@h/d?password=***"
    assert one(spark, "a", lambda c: text.merge_lines(c, F.lit(None), F.lit("b"), c)) == "a\nb"
    assert text.query_terms("The data JOB, in or with Spark!") == ["data", "job", "spark"]
    assert one(spark, " Visit  Site", text.link_text) is None and one(spark, "Click here", text.link_text) == "Click here" and one(spark, "acme-data", text.display_name) == "Acme Data"


URLS = ["https://Boards.Greenhouse.io/acme/?gh_jid=123&utm_source=x", "HTTP://h.example/a//b/?q=1&q=2#f", "no url", "https://jobs.ashbyhq.com/acme?jobId=ab-1", "https://x.example/", None, "https://jobs.lever.co/acme/1?lever-source=z&a=b"]


def test_urls(spark):
    want = ["https://boards.greenhouse.io/acme/jobs/123", "http://h.example/a//b?q=1&q=2", "no url", "https://jobs.ashbyhq.com/acme/ab-1", "https://x.example/", None, "https://jobs.lever.co/acme/1?a=b"]
    assert [one(spark, u, urls.canonical_url) for u in URLS] == want
    assert [one(spark, u, urls.canonical_url) for u in want] == want  # once is enough
    assert one(spark, URLS[0], urls.board_root) == "https://boards.greenhouse.io/acme" and one(spark, "https://t.wd1.myworkdayjobs.com/en/S/job/X/y_R-1", urls.board_root) is None
    assert [one(spark, u, urls.portal_of) for u in URLS] == ["greenhouse", None, None, "ashby", None, None, "lever"]
    for u in (URLS[0], URLS[1]):
        p, w = one(spark, u, urls.url_parts), urlsplit(u)
        assert (p["scheme"], p["host"], p["path"], p["query"], p["fragment"]) == (w.scheme, w.netloc.lower(), w.path, w.query, w.fragment)
    assert one(spark, "a.b.co.uk", urls.registrable_domain) == "b.co.uk" and one(spark, "careers.acme.com", urls.domain_label) == "acme"
    assert one(spark, "https://www.acme.com/x", urls.company_domain) == "acme.com" and one(spark, "10.0.0.1", urls.company_domain) is None
    base = F.lit("https://h.example/a/b?c")
    assert [one(spark, h, lambda c: urls.absolute_href(c, base)) for h in ("x", "/x#f", "//o.example/y", "?q", "mailto:a@b")] == ["https://h.example/a/x", "https://h.example/x", "https://o.example/y", "https://h.example/a/b?q", None]
    assert one(spark, "https://s.example/l/?uddg=https%3A%2F%2Fa.example%2F", urls.redirect_target) == "https://a.example/"
    assert one(spark, "(https://a.example/x).", lambda c: urls.extracted_url(F.regexp_replace(c, "^[(]", ""))) == "https://a.example/x"
    assert one(spark, "ftp://a", urls.source_problem) == "unsupported_scheme" and one(spark, "https://h/jobs.xml", urls.machine_readable)


def test_html(spark):
    ld = {"@graph": [{"@type": "JobPosting", "title": "A &amp; B", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Ulm", "addressCountry": {"name": "DE"}}}], "identifier": {"value": "7"}, "url": "https://h/7",
                      "baseSalary": {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2, "unitText": "YEAR"}}}, {"@type": "JobPosting", "title": "R", "jobLocationType": "TELECOMMUTE"}]}
    page = f"""<html><head><title> Jobs | <b>Acme</b> </title><META name="X" content=" m  n "><script type="application/ld+json">{json.dumps(ld)}</script>
    <script>window.__d = {{"a": ["}}", 1]}};</script><script type="application/ld+json">{{broken</script></head><body><a href="/x">Ap<i>ply</i> now</a> //cdn.example/y https://h/z).</body></html>"""
    assert one(spark, page, html.page_title) == "Jobs | Acme" and one(spark, page, lambda c: html.meta_content(c, "x")) == "m n"
    assert one(spark, page, lambda c: F.size(html.json_ld(c))) == 1 and len(one(spark, page, html.scripts)) == 3
    assert [tuple(a) for a in one(spark, page, html.anchors)] == [("/x", "Ap ply now")]
    assert json.loads(one(spark, page, lambda c: html.json_after(c, "__d ="))) == {"a": ["}", 1]} and one(spark, "no", lambda c: html.json_after(c, "__d =")) is None
    got = [p.asDict() for p in one(spark, page, html.postings)]
    assert got[0] == {"title": "A & B", "company": "Acme", "location": "Ulm, DE", "apply_url": "https://h/7", "source_job_id": "7", "posted_at": None, "salary_text": "1 - 2 EUR per YEAR"} and got[1]["location"] == "Remote"
    assert "https://h/z" in one(spark, page, html.urls_in) and "https://cdn.example/y" in one(spark, page, html.urls_in)
    skip = lambda c: html.skip_reason(c, F.lit(200), F.lit("text/html"))
    assert [one(spark, p, skip) for p in (" ", "<html>Access denied", "plain", page)] == ["empty_response_body", "blocked_or_access_denied", "non_html_content", None]


@pytest.mark.parametrize(("v", "want"), [("2024-06-08 08:12:13", 1717834333), ("2024-06-08T08:12:13Z", 1717834333), ("2024-06-08", 1717804800), ("soon", 0), (None, 0)])
def test_freshness(spark, v, want):
    assert one(spark, v, lambda c: times.freshness(F.lit(None).cast("string"), c)) == want
