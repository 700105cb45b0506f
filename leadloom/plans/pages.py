"""Queries of the text, URL, page and file functions over whole tables, each with the SQL that checks it.

There is no table of pages, so pages are written from the rows of jobs and read again: what
a page says is known, and the SQL states it from the columns. Files are written under the
shared folder and read again in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import html, text, times, urls
from leadloom.operators import merging, selection
from leadloom.plans.lifecycle import _CLEAN, _KEY, _SPACE
from leadloom.plans.queries import _ITEMS, BOARDS, _session_items, query
from leadloom.runtime import scratch_path, table
from leadloom.sources import readers, writers

_RUN = _SPACE.replace("{{", "{").replace("}}", "}") + "+"


def _one(column: str) -> str:
    """SQL of a text on one line."""
    return f"regexp_replace({_CLEAN.format(column)}, '{_RUN}', ' ', 'g')"


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per job: id, page, and the columns it was written from."""
    jobs = table(spark, d, "jobs").select("id", "title", "company", "location", "apply_url", "source_job_id", "status", "portal_type", "source")
    c = F.col
    posting = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), c("title"), F.struct(c("company").alias("name")).alias("hiringOrganization"), F.struct(F.struct(c("location").alias("addressLocality")).alias("address")).alias("jobLocation"),
        c("apply_url").alias("url"), F.struct(c("source_job_id").alias("value")).alias("identifier"), c("id").cast("string").alias("datePosted"),
    ))
    listed = F.to_json(F.struct(F.struct(c("company").alias("name")).alias("organization"), F.array(F.struct(c("id"), c("title"), F.coalesce("location", F.lit("Remote")).alias("location"), F.concat(F.lit("https://h.example/jobs/"), c("id")).alias("applyUrl"))).alias("jobs")))
    page = F.concat(
        F.lit("<!doctype html><html><head><title> "), _escaped(c("title")), F.lit(" | <b>"), _escaped(c("company")), F.lit('</b></title><META Content="'), _escaped(c("company")), F.lit('" property="OG:site_name"><script type="application/ld+json">'),
        F.replace(posting, F.lit("</"), F.lit("<\\/")), F.lit('</script><script id="__NEXT_DATA__" type="application/json">'), F.replace(listed, F.lit("</"), F.lit("<\\/")), F.lit("</script></head><body>"),
        F.lit("<a class='x' href=\"/jobs/"), c("id").cast("string"), F.lit('#top">'), _escaped(c("title")), F.lit(" <i>now</i></a><a href='mailto:a@b.example'>Mail</a><script>window.__state = "), listed, F.lit("; var x = {};</script></body></html>"),
    )
    return jobs.withColumn("page", page)


@query(f"SELECT id, {_one(chr(39) + chr(39) + ' || title || ' + chr(39) + ' | ' + chr(39) + ' || company')} AS title FROM jobs")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", html.page_title(F.col("page")).alias("title"))


@query(f"SELECT id, {_one('company')} AS company FROM jobs")
def page_companies(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", html.page_company(F.col("page"), "Board").alias("company"))


@query(f"SELECT id, {_one('title')} AS title, {_one('company')} AS company, {_one('location')} AS location, {_one('apply_url')} AS apply_url, {_one('source_job_id')} AS source_job_id, CAST(id AS VARCHAR) AS posted_at FROM jobs")
def page_postings(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("id", F.explode(html.postings(F.col("page"))).alias("p"))
    return p.select("id", *[F.col(f"p.{c}").alias(c) for c in ("title", "company", "location", "apply_url", "source_job_id", "posted_at")])


@query("SELECT id, 1 AS blocks, 'JobPosting' AS kind FROM jobs")
def page_linked_data(spark: SparkSession, d: str) -> DataFrame:
    ld = html.json_ld(F.col("page"))
    return _pages(spark, d).select("id", F.size(ld).cast("int").alias("blocks"), F.try_variant_get(F.get(ld, F.lit(0)), "$['@type']", "string").alias("kind"))


@query(f"SELECT id, id AS listed, {_CLEAN.format('title')} IS NOT NULL AS titled FROM jobs")
def page_scripts(spark: SparkSession, d: str) -> DataFrame:
    body = F.try_parse_json(F.get(html.scripts(F.col("page"), element_id="__NEXT_DATA__"), F.lit(0)))
    return _pages(spark, d).select("id", F.try_variant_get(body, "$.jobs[0].id", "bigint").alias("listed"), text.clean_text(F.try_variant_get(body, "$.jobs[0].title", "string")).isNotNull().alias("titled"))


@query("SELECT id, id AS listed FROM jobs")
def page_state(spark: SparkSession, d: str) -> DataFrame:
    """JSON after a marker in a script, braces and quotes in texts notwithstanding."""
    return _pages(spark, d).select("id", F.try_variant_get(F.try_parse_json(html.json_after(F.col("page"), "window.__state =")), "$.jobs[0].id", "bigint").alias("listed"))


@query("SELECT id, 'https://h.example/jobs/' || id AS url, true AS now FROM jobs")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to other pages, absolute and without fragments; links to mail are none."""
    a = _pages(spark, d).select("id", F.explode(html.anchors(F.col("page"))).alias("a"))
    out = a.select("id", urls.absolute_href(F.col("a.href"), F.lit("https://h.example/board?x=1")).alias("url"), F.col("a.text").endswith(" now").alias("now"))
    return out.filter("url is not null")


@query(f"SELECT id, 'collected' AS outcome, {_one('title')} AS title, coalesce({_one('location')}, CASE WHEN location IS NULL THEN 'Remote' END) AS location FROM jobs WHERE {_CLEAN.format('title')} IS NOT NULL AND (location IS NULL OR {_CLEAN.format('location')} IS NOT NULL) "
       f"UNION ALL SELECT id, 'manual_review', NULL, NULL FROM jobs WHERE NOT ({_CLEAN.format('title')} IS NOT NULL AND (location IS NULL OR {_CLEAN.format('location')} IS NOT NULL))")  # fmt: skip
def page_leads(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one portal: embedded JSON first, links last; a page of one job must give one posting."""
    page = F.col("page")
    attempts = F.array(html.embedded_postings(page, html.LISTINGS["ashby"]), html.anchored_postings(page, F.lit("https://h.example/"), F.col("company")))
    r = _pages(spark, d).select("id", html.resolve_attempts(attempts, F.lit(True)).alias("r"))
    first = F.get("r.leads", F.lit(0))
    return r.select("id", "r.outcome", first["title"].alias("title"), first["location"].alias("location"))


@query(f"SELECT id, CASE WHEN {_CLEAN.format('title')} IS NOT NULL AND (location IS NULL OR {_CLEAN.format('location')} IS NOT NULL) THEN 1 END AS available FROM jobs")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _pages(spark, d).select("id", html.count_attempts(F.array(html.embedded_postings(F.col("page"), html.LISTINGS["ashby"]))).alias("r"))
    return r.select("id", "r.available")


@query("SELECT id, CASE WHEN status = 'new' THEN 'empty_response_body' WHEN status = 'skipped' THEN 'blocked_or_access_denied' WHEN portal_type = 'lever' THEN 'http_error_status' WHEN portal_type = 'ashby' THEN 'non_html_content' END AS reason FROM jobs")
def page_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why a response isn't read, in order: empty, blocked, status, type."""
    s, p = F.col("status"), F.col("portal_type")
    page = F.when(s == "new", F.lit(" \n")).when(s == "skipped", F.concat(F.lit("<title>Just a Moment</title>"), F.col("page"))).otherwise(F.lit("<html><body>ok</body></html>"))
    return _pages(spark, d).select("id", html.skip_reason(page, F.when(p == "lever", 404).otherwise(200), F.when(p == "ashby", "application/pdf").otherwise("text/html; charset=utf-8")).alias("reason"))


@query("SELECT id, CASE WHEN status = 'skipped' THEN 'captcha,interstitial_wait_room' ELSE '' END AS names FROM jobs")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("status") == "skipped", F.lit("<title>Just a moment...</title><p>Solve the CAPTCHA</p>")).otherwise(F.lit("<title>Jobs</title><p>All good, recaptcha3</p>"))
    return _pages(spark, d).select("id", F.array_join(html.blocked_patterns(page), ",").alias("names"))


@query("SELECT id, CASE status WHEN 'new' THEN 'provider_anomaly' WHEN 'opened' THEN 'success' WHEN 'applied' THEN 'zero_results' WHEN 'skipped' THEN 'parse_failure' ELSE 'provider_anomaly' END AS class FROM jobs")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    page = F.when(s == "new", "<html><div id='challenge-form'>").when(s == "applied", "<html><p>No results found for x</p>").when(s.isin("skipped", "opened"), "<html><a class='result__a'>x</a>").otherwise("<html></html>")
    return _pages(spark, d).select("id", html.search_class(page, F.lit("text/html"), F.when(s == "opened", 1).otherwise(0)).alias("class"))


@query(f"SELECT id, CASE WHEN json_valid(raw_json) THEN {_one(chr(40) + 'json_extract_string(raw_json, ' + chr(39) + '$.description' + chr(39) + ')' + chr(41))} END AS description FROM jobs")
def nested_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", html.nested_text(F.col("raw_json"), ["DESCRIPTION"]).alias("description"))


@query(f"SELECT id, CASE WHEN {_one('location')} IS NOT NULL THEN {_one('location')} || '; ' || {_one('company')} ELSE {_one('company')} END AS a, 'Remote (' || {_one('company')} || ')' AS b FROM jobs WHERE {_one('company')} IS NOT NULL AND {_one('company')} IS DISTINCT FROM {_one('location')}")
def posting_locations(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").filter(text.one_line(F.col("company")).isNotNull() & ~text.one_line(F.col("company")).eqNullSafe(text.one_line(F.col("location"))))
    two = F.to_json(F.array(F.struct(F.col("location").alias("name"), F.struct(F.col("company").alias("addressLocality")).alias("address")), F.struct(F.col("location").alias("name"), F.struct(F.lit(None).cast("string").alias("addressLocality")).alias("address"))))
    none = F.lit(None).cast("string")
    need = F.to_json(F.array(F.struct(F.col("company").alias("name"))))
    return jobs.select("id", html.posting_location(two, none, none).alias("a"), html.posting_location(none, need, F.lit("TELECOMMUTE")).alias("b"))


@query(f"SELECT id, coalesce({_one('title')} || ': ', '') || '1 - 2 EUR; on request' AS pay FROM jobs")
def pay_texts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")

    def row(title: Column, lo: Column, hi: Column, currency: Column, said: Column) -> Column:
        return F.struct(title.alias("title"), lo.alias("min"), hi.alias("max"), currency.alias("currency_type"), said.alias("description"))

    ranges = F.array(row(F.col("title"), F.lit("1"), F.lit("2"), F.lit("EUR"), none), row(none, none, none, none, F.lit(" on request")), row(none, none, none, none, none))
    return table(spark, d, "jobs").select("id", html.pay_ranges(ranges).alias("pay"))


@query(f"SELECT doc_id, {_one('regexp_replace(text, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS plain FROM documents WHERE text IS NOT NULL")
def tags_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.strip_tags(F.col("text")).alias("plain"))


# --- URLs ----------------------------------------------------------------------------


@query("SELECT id, CASE WHEN regexp_matches(lower(u), '^https?://[^/?#]+') THEN CASE WHEN h IN ('boards.hireglade.example', 'jobs.levrano.example', 'jobs.ashwick.example') AND seg <> '' THEN sc || '://' || h || '/' || seg END END AS root, "
       "CASE WHEN u IS NULL THEN 'blank_source' WHEN sc NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN h = '' THEN 'missing_host' END AS problem FROM (SELECT id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sc, "
       f"lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(u, '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1) AS seg FROM (SELECT id, {_CLEAN.format('apply_url')} AS u FROM jobs))")  # fmt: skip
def registered_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("apply_url")
    root = urls.board_root(u, None, BOARDS)
    return table(spark, d, "jobs").select("id", urls.registry_url(u, None, BOARDS).alias("r"), root.alias("root")).select("id", F.when(F.col("r.problem").isNull() & (F.col("r.url") == F.col("root")), F.col("r.url")).alias("root"), "r.problem")


_HOST = "lower(regexp_extract(normalized_url, '^https?://([^/?#]+)', 1))"
_LABEL = "CASE WHEN array_to_string(list_slice(l, -2, -1), '.') IN ('co.in', 'co.jp', 'co.uk', 'com.au', 'com.br', 'com.hk', 'com.mx', 'com.sg') AND len(l) >= 3 THEN l[-3] ELSE l[-2] END"
_WIDE = ("CASE WHEN array_to_string(list_slice(l, -2, -1), '.') IN ('ac.uk', 'co.in', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.hk', 'com.mx', 'com.sg', 'gov.uk', 'net.au', 'org.au', 'org.uk') AND len(l) >= 3 "
         "THEN array_to_string(list_slice(l, -3, -1), '.') ELSE array_to_string(list_slice(l, -2, -1), '.') END")
_ENDS = "['', '.co.uk', '.com.hk', '.org.au', '.com', '.co.nz']"


@query(f"SELECT id, k, {_WIDE} AS domain, {_LABEL} AS label FROM (SELECT id, k, string_split(regexp_replace(h, '^((apply|boards|careers|jobs|www)\\.)+([^.]+\\.[^.]+.*)$', '\\3'), '.') AS l FROM (SELECT id, k, 'jobs.' || regexp_replace(lower(coalesce(label, 'x')), '[^a-z0-9]+', '', 'g') || {_ENDS}[k] AS h FROM source_registry, (SELECT unnest([2, 3, 4, 5, 6]) AS k)))")
def company_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains and labels of hosts under suffixes of one and two labels."""
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("end")) for k, e in ((2, ".co.uk"), (3, ".com.hk"), (4, ".org.au"), (5, ".com"), (6, ".co.nz"))])
    host = F.concat(F.lit("jobs."), F.regexp_replace(F.lower(F.coalesce("label", F.lit("x"))), "[^a-z0-9]+", ""), F.col("e.end"))
    rows = table(spark, d, "source_registry").select("id", "label", F.explode(ends).alias("e")).select("id", F.col("e.k").alias("k"), host.alias("h"))
    bare = F.regexp_replace("h", r"^jobs\.(?=[^.]+\.[^.]+)", "")
    return rows.select("id", "k", urls.registrable_domain(bare).alias("domain"), urls.domain_label(F.col("h")).alias("label"))


@query("SELECT id, k = 1 OR k = 2 OR k = 4 AS excluded, k FROM source_registry, (SELECT unnest([1, 2, 3, 4]) AS k)")
def excluded_links(spark: SparkSession, d: str) -> DataFrame:
    link = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(a), F.col("id").cast("string"), F.lit(b)).alias("u")) for k, a, b in ((1, "https://www.linkedin.com/company/", ""), (2, "https://jobs.seed.example/", "/about"), (3, "https://other.example/x/", "?a=b"), (4, "https://other.example/x/", ".PDF"))])
    return table(spark, d, "source_registry").select("id", F.explode(link).alias("l")).select("id", urls.excluded_link(F.col("l.u"), F.lit("seed.example")).alias("excluded"), F.col("l.k").alias("k"))


@query("SELECT id, apply_url AS target FROM jobs WHERE apply_url IS NOT NULL AND regexp_matches(apply_url, '^https?://[!-~]+$')")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").filter(F.col("apply_url").rlike(r"^https?://[!-~]+\z"))
    return rows.select("id", urls.redirect_target(F.concat(F.lit("https://s.example/l/?k=1&uddg="), F.url_encode("apply_url"))).alias("target"))


_SITES = "[('greenhouse', 'boards.greenhouse.io'), ('greenhouse', 'job-boards.greenhouse.io'), ('lever', 'jobs.lever.co'), ('ashby', 'jobs.ashbyhq.com'), ('workday', 'myworkdayjobs.com'), ('workday', 'workday.com')]"


@query(f"SELECT title_id, s.a AS portal, trim(title_name) || ' site:' || s.b AS search_text, 'https://s.example/?q=' || replace(url_encode(trim(title_name) || ' site:' || s.b), '%20', '+') AS search_url FROM ref_titles, (SELECT unnest({_SITES.replace('(' + chr(39), '{a: ' + chr(39)).replace(', ' + chr(39), ', b: ' + chr(39)).replace(')', '}')}) AS s)")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ref_titles").select("title_id", F.explode(urls.search_plans(F.col("title_name"), "https://s.example/")).alias("p"))
    return p.select("title_id", "p.portal", "p.search_text", "p.search_url")


@query("SELECT id, regexp_extract(u, '://([^./]+)\\.', 1) AS tenant, string_split(regexp_replace(regexp_extract(u, '://[^/]+(/[^?#]*)', 1), '^/[a-z]{2}-[A-Z]{2}/', '/'), '/')[2] AS site, regexp_extract(u, '_([^_/?#]+)(/?([?#].*)?)$', 1) AS requisition "
       "FROM (SELECT id, trim(apply_url, E' \\t\\n\\r') AS u FROM jobs) WHERE regexp_matches(u, '^https://[a-z0-9-]+\\.wd5\\.workmere\\.example/[A-Za-z]{2}-[A-Za-z]{2}/[^/?#]+/job/[^/?#]+/[^/?#]+_[^/?#]+([?#].*)?$')")  # fmt: skip
def tenant_hints(spark: SparkSession, d: str) -> DataFrame:
    u = F.trim(F.regexp_replace("apply_url", r"^[ \t\n\r]+|[ \t\n\r]+$", ""))
    rows = table(spark, d, "jobs").select("id", u.alias("u")).filter(F.col("u").rlike(r"^https://[a-z0-9-]+\.wd5\.workmere\.example/[A-Za-z]{2}-[A-Za-z]{2}/[^/?#]+/job/[^/?#]+/[^/?#]+_[^/?#]+([?#].*)?\z"))
    return rows.select("id", urls.tenant_hints(F.col("u"), r"\.workmere\.example$").alias("h")).select("id", "h.*")


@query("SELECT id, coalesce(nullif(regexp_extract(u, '[?&]gh_jid=([^&#]+)', 1), ''), nullif(regexp_extract(u, '[?&]jobId=([^&#]+)', 1), ''), nullif(regexp_extract(lower(p), '([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})', 1), ''), nullif(regexp_extract(p, '^.*?([0-9]{5,})[^0-9]*$', 1), '')) AS job_id "
       "FROM (SELECT id, apply_url AS u, regexp_extract(apply_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM jobs WHERE regexp_matches(apply_url, '^https://[a-z.]+/[a-z]+/(jobs/)?[0-9a-f-]+(\\?[^A-Z]*)?$'))")  # fmt: skip
def url_job_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").filter(F.col("apply_url").rlike(r"^https://[a-z.]+/[a-z]+/(jobs/)?[0-9a-f-]+(\?[^A-Z]*)?\z"))
    return rows.select("id", urls.job_id_of(F.col("apply_url")).alias("job_id"))


@query("SELECT id, regexp_matches(lower(u), '^[^?#]*://[^/]*(.*)(sitemap|feed|/api/|\\.json|\\.xml)') AND regexp_matches(lower(u), '^[^?#]*://[^/]*/.*(job|career|opening)') AS feed FROM (SELECT id, normalized_url || CASE WHEN status = 'active' THEN '/jobs.xml' ELSE '/about' END AS u FROM source_registry)")
def feed_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.col("normalized_url"), F.when(F.col("status") == "active", "/jobs.xml").otherwise("/about"))
    return table(spark, d, "source_registry").select("id", urls.machine_readable(u).alias("feed"))


_ALL = "regexp_extract_all(lower(company), '[a-z0-9]+')"
_ENDINGS = "ai|ag|bv|co|company|corp|corporation|gmbh|inc|incorporated|io|labs|llc|llp|lp|limited|ltd|oy|plc|pte|pty|sa|systems|tech"


@query(f"WITH w AS (SELECT id, regexp_replace(array_to_string({_ALL}, ' '), '^((a|an|the) )+', '') AS f, regexp_replace(regexp_replace(array_to_string({_ALL}, ' '), '( ({_ENDINGS}))+$', ''), '^((a|an|the) )+', '') AS s FROM source_registry WHERE company IS NOT NULL), "
       "c AS (SELECT id, list_filter([replace(s, ' ', '-'), replace(s, ' ', ''), replace(f, ' ', '-'), replace(f, ' ', '')], lambda x: length(x) >= 2) AS l FROM w), "
       "u AS (SELECT id, x, min(p) AS p FROM (SELECT id, unnest(l) AS x, unnest(range(len(l))) AS p FROM c) GROUP BY 1, 2) SELECT id, x AS slug, row_number() OVER (PARTITION BY id ORDER BY p) AS position FROM u")  # fmt: skip
def short_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_registry").filter("company is not null")
    return rows.select("id", F.posexplode(text.short_slugs(F.col("company"), F.lit(None).cast("string"))).alias("p", "slug")).select("id", "slug", (F.col("p") + 1).cast("long").alias("position"))


@query(f"WITH s AS (SELECT id, lower(array_to_string({_ALL}, '')) AS slug FROM source_registry WHERE company IS NOT NULL) SELECT id, p.a AS portal, p.b || slug AS url FROM s, (SELECT unnest([{{a: 'greenhouse', b: 'https://boards.greenhouse.io/'}}, {{a: 'greenhouse', b: 'https://job-boards.greenhouse.io/'}}, "
       "{a: 'lever', b: 'https://jobs.lever.co/'}, {a: 'ashby', b: 'https://jobs.ashbyhq.com/'}]) AS p) WHERE slug <> ''")  # fmt: skip
def probe_urls(spark: SparkSession, d: str) -> DataFrame:
    slug = F.array_join(text.tokens(F.col("company")), "")
    p = table(spark, d, "source_registry").filter("company is not null").select("id", F.explode(urls.probe_urls(F.array(slug, slug))).alias("p"))
    return p.select("id", "p.portal", "p.url")


# --- texts ---------------------------------------------------------------------------


@query(f"SELECT id, {_one('company')} AS company, {_one('title')} AS title, {_one('location')} AS location, lower({_CLEAN.format('portal_type')}) AS portal_type, {_CLEAN.format('apply_url')} AS apply_url, {_CLEAN.format('salary_text')} IS NOT NULL AS paid FROM jobs")
def import_cleanup(spark: SparkSession, d: str) -> DataFrame:
    one = text.one_line
    return table(spark, d, "jobs").select("id", *[one(F.col(c)).alias(c) for c in ("company", "title", "location")], F.lower(one(F.col("portal_type"))).alias("portal_type"), text.clean_text(F.col("apply_url")).alias("apply_url"), one(F.col("salary_text")).isNotNull().alias("paid"))


@query(f"SELECT id, {_KEY.format('company')} AS company, {_KEY.format('location')} AS location FROM jobs")
def key_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", text.key_text(F.col("company")).alias("company"), text.key_text(F.col("location")).alias("location"))


@query(f"SELECT id, nullif(regexp_replace(regexp_replace({_CLEAN.format('company')}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '') AS slug FROM source_registry")
def batch_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_registry").select("id", text.batch_slug(F.col("company")).alias("slug"))


@query("SELECT location_id, nullif(trim(regexp_replace(lower(strip_accents(location_name)), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM ref_locations")
def ascii_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ref_locations").select("location_id", text.ascii_slug(F.col("location_name")).alias("slug"))


@query(f"SELECT id, {_one('title')} AS title FROM jobs WHERE NOT contains(title, '&')")
def unescaped_titles(spark: SparkSession, d: str) -> DataFrame:
    named = F.replace(F.regexp_replace(_escaped(F.col("title")), "e", "&#101;"), F.lit("a"), F.lit("&#x61;"))
    safe = F.regexp_replace(named, "&#x61;mp;|&&#x61;mp;", "&amp;")
    return table(spark, d, "jobs").filter(~F.col("title").contains("&")).select("id", text.unescape_html(safe).alias("title"))


@query("SELECT id, list_aggregate(list_transform(string_split(trim(regexp_replace(slug, '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name FROM (SELECT id, regexp_extract(normalized_url, '^https?://[^/]+/([a-z0-9-]+)$', 1) AS slug FROM source_registry) WHERE slug <> ''")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    slug = F.regexp_extract("normalized_url", "^https?://[^/]+/([a-z0-9-]+)$", 1)
    return table(spark, d, "source_registry").select("id", slug.alias("s")).filter("s <> ''").select("id", text.display_name(F.col("s")).alias("name"))


_GENERIC = "'apply', 'apply now', 'company', 'company profile', 'details', 'learn more', 'more', 'open roles', 'portfolio', 'profile', 'read more', 'site', 'view company', 'visit site', 'visit website', 'website'"


@query(f"SELECT id, CASE WHEN lower(t) NOT IN ({_GENERIC}) AND length(t) <= 80 THEN t END AS name FROM (SELECT id, {_one('CASE status WHEN ' + chr(39) + 'new' + chr(39) + ' THEN ' + chr(39) + ' Open  Roles' + chr(39) + ' WHEN ' + chr(39) + 'opened' + chr(39) + ' THEN ' + chr(39) + 'home' + chr(39) + ' ELSE title || title || title END')} AS t FROM jobs)")
def link_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("status") == "new", " Open  Roles").when(F.col("status") == "opened", "home").otherwise(F.concat("title", "title", "title"))
    return table(spark, d, "jobs").select("id", text.link_text(t).alias("name"))


@query(f"SELECT id, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE a || chr(10) || b END AS notes FROM (SELECT id, {_CLEAN.format('notes')} AS a, {_CLEAN.format('provenance')} AS b FROM source_registry)")
def merged_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_registry").select("id", text.merge_lines(F.col("notes"), F.col("provenance"), F.col("notes")).alias("notes"))


@query("SELECT id, nullif(concat_ws('; ', CASE WHEN apply_url IS NULL THEN 'no address' END, CASE WHEN status <> 'new' THEN 'not actionable' END), '') AS reasons FROM jobs")
def reason_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", text.reasons({"no address": F.col("apply_url").isNull(), "not actionable": F.col("status") != "new"}).alias("reasons"))


@query("SELECT id, CASE WHEN regexp_matches(lower(title), 'data') THEN 'data' WHEN regexp_matches(lower(title), 'engineer') THEN 'engineering' END AS label FROM jobs")
def title_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", text.first_label(F.lower("title"), {"data": "data", "engineering": "engineer"}).alias("label"))


@query("SELECT id, CASE portal_type WHEN 'greenhouse' THEN 'Greenhouse' WHEN 'lever' THEN 'Lever' WHEN 'ashby' THEN 'Ashby' WHEN 'workday' THEN 'Workday' END AS label FROM jobs")
def portal_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for n in ("greenhouse", "lever", "ashby", "workday") for x in (n, n.capitalize())])
    return table(spark, d, "jobs").select("id", F.try_element_at(labels, F.col("portal_type")).alias("label"))


@query("SELECT id, 'postgresql://user:***@db.example/jobs?sslmode=x&password=***' AS masked FROM source_registry")
def masked_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.lit("postgresql://user:s3"), F.col("id").cast("string"), F.lit("@db.example/jobs?sslmode=x&password=p"), F.col("id").cast("string"))
    return table(spark, d, "source_registry").select("id", text.mask_secrets(u).alias("masked"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS stamp FROM events")
def batch_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", times.batch_stamp(F.col("ts")).alias("stamp"))


@query("SELECT id, coalesce(regexp_matches(found_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$') AND try_cast(substr(found_at, 1, 19) AS TIMESTAMP) IS NOT NULL, false) AS strict FROM jobs")
def strict_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", times.is_strict_iso(F.col("found_at")).alias("strict"))


@query("SELECT id, coalesce(nullif(e, 0), f, 0) AS seconds FROM (SELECT id, CAST(epoch(TRY_CAST(replace(replace(regexp_extract(posted_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|\\+00(:?00)?)?)?$'), 'T', ' '), 'Z', '')[:19] AS TIMESTAMP)) AS BIGINT) AS e, "
       "CAST(epoch(TRY_CAST(replace(replace(created_at, 'T', ' '), 'Z', '')[:19] AS TIMESTAMP)) AS BIGINT) AS f FROM jobs)")  # fmt: skip
def freshness_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", times.freshness(F.col("posted_at"), F.col("created_at")).alias("seconds"))


# --- sources and sinks ---------------------------------------------------------------


@query(f"SELECT id, {_one('source')} AS source, {_one('company')} AS company, {_one('title')} AS title, {_one('location')} AS location, lower({_one('portal_type')}) AS portal_type, {_CLEAN.format('apply_url')} AS apply_url, "
       f"CASE WHEN {_one('location')} IS NULL THEN 'missing: location' END AS error FROM jobs WHERE {_one('source')} IS NOT NULL AND {_one('company')} IS NOT NULL AND {_one('title')} IS NOT NULL")  # fmt: skip
def lead_files(spark: SparkSession, d: str) -> DataFrame:
    """Lead records written as JSON and read again, cleaned and checked."""
    jobs = table(spark, d, "jobs")
    texts = jobs.select("id", F.to_json(F.struct("source", "company", "title", "location", "portal_type", "apply_url", F.col("id").cast("string").alias("source_job_id"))).alias("value"))
    r = readers.lead_rows(texts.select("value"))
    good = F.col("error").isNull() | (F.col("error") == "missing: location")
    return r.filter(good).select(F.col("source_job_id").cast("long").alias("id"), "source", "company", "title", "location", "portal_type", "apply_url", "error")


@query("SELECT normalized_url AS line FROM source_registry")
def line_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    lines = table(spark, d, "source_registry").select(F.concat(F.lit("# note\n\n  "), "normalized_url", F.lit(" ")).alias("line"))
    writers.write_lines(lines, "line", path)
    return readers.lines(spark, path)


@query(f"SELECT {_one('company')} AS company, regexp_replace(lower(regexp_extract(normalized_url, '^https?://([^/?#]+)', 1)), '^.*?([^.]+\\.[^.]+)$', '\\1') AS domain, coalesce(CAST(id AS VARCHAR), '') || ' | x' AS notes FROM source_registry WHERE {_CLEAN.format('company')} IS NOT NULL AND NOT contains(company, '|')")
def company_files(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_registry").filter(text.clean_text(F.col("company")).isNotNull() & ~F.col("company").contains("|"))
    lines = r.select(F.concat_ws(" | ", text.one_line(F.col("company")), F.col("normalized_url"), F.col("id").cast("string"), F.lit("x")).alias("line"))
    return readers.company_lines(lines)


@query("SELECT source_url, trim(company) AS company FROM source_registry WHERE trim(source_url, E' \\t\\n\\r') = source_url AND (company IS NULL OR trim(company, E' \\t\\n\\r') <> '')")
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    """Registry entries written as JSON texts and objects and read again."""
    r = table(spark, d, "source_registry").filter(r"source_url = regexp_replace(source_url, '^[ \t\n\r]+|[ \t\n\r]+$', '') and (company is null or regexp_replace(company, '[ \t\n\r]+', '') <> '')")
    entry = F.when(F.col("company").isNull(), F.to_json(F.array("source_url"))).otherwise(F.to_json(F.array(F.struct(F.col("source_url").alias("url"), F.trim("company").alias("company")))))
    return readers.registry_rows(r.select(entry.alias("value")))


@query(_ITEMS + " SELECT session AS label, CAST(count(*) AS INT) AS item_count, CASE WHEN session < 'batch-000010' THEN 'created_at is no ISO timestamp' END AS problem FROM i GROUP BY 1")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Manifests written one to a line and read again with what is wrong with them; half of them have a month too many."""
    items = _session_items(spark, d).withColumnRenamed("item_index", "rank").select("session", "rank", F.col("id").alias("job_id"), "apply_url")
    m = selection.manifest(items.withColumnRenamed("rank", "item_index"), "session", F.lit("2026-01-01T00:00:00Z"), ["job_id", "apply_url"])
    m = m.withColumn("created_at", F.when(F.col("session") < "batch-000010", "2026-13-01T00:00:00Z").otherwise(F.col("created_at")))
    path = scratch_path(spark, "manifests")
    writers.write_json(m.withColumnRenamed("session", "label"), path)
    return readers.manifests(spark, path, one_per_line=True).select("label", "item_count", "problem")


_CENSUS = ("status", "portal_type", "portal_label", "board_root_url", "available_job_count", "reason_code", "reason", "input_urls", "final_url")


@query("SELECT status, portal_type, upper(portal_type[1]) || portal_type[2:] AS portal_label, normalized_url AS board_root_url, CASE WHEN status = 'active' THEN CAST(id AS VARCHAR) END AS available_job_count, verification_reason_code AS reason_code, NULL::VARCHAR AS reason, "
       "source_url || '; ' || normalized_url AS input_urls, NULL::VARCHAR AS final_url FROM source_registry WHERE trim(source_url, E' \\t\\n\\r') = source_url")  # fmt: skip
def census_files(spark: SparkSession, d: str) -> DataFrame:
    """The nine fixed columns of a census as CSV, written and read again; nulls are empty, lists have ``; `` between."""
    r = table(spark, d, "source_registry").filter(r"source_url = regexp_replace(source_url, '^[ \t\n\r]+|[ \t\n\r]+$', '')")
    none = F.lit(None).cast("string")
    rows = r.select("status", "portal_type", F.initcap("portal_type").alias("portal_label"), F.col("normalized_url").alias("board_root_url"), F.when(F.col("status") == "active", F.col("id")).alias("available_job_count"),
                    F.col("verification_reason_code").alias("reason_code"), none.alias("reason"), F.array("source_url", "normalized_url").alias("input_urls"), none.alias("final_url"))
    path = scratch_path(spark, "census")
    writers.write_csv(rows, path)
    return spark.read.schema(", ".join(f"{c} string" for c in _CENSUS)).option("header", True).csv(path)


@query("SELECT job_id, min(created_at) AS created_at, count(*) > 1 AS refused FROM applications GROUP BY job_id")
def application_log(spark: SparkSession, d: str) -> DataFrame:
    """One record per application; a second one of the same job isn't written over the first."""
    a = table(spark, d, "applications").select("job_id", "created_at")
    return writers.append_once(a.limit(0), a, ["job_id"], [F.col("created_at")])


@query("SELECT id, coalesce(status, 'new') AS status, coalesce(portal_type, 'unknown') AS portal_type FROM jobs")
def inserted_defaults(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", "status", "portal_type")
    return merging.with_defaults(jobs, {"status": F.lit("new"), "portal_type": F.lit("unknown")})


@query("SELECT status, count(*) AS n FROM application_tracking GROUP BY 1")
def written_versions(spark: SparkSession, d: str) -> DataFrame:
    """A new version of a table beside the old one, partitioned, and read again."""
    root = scratch_path(spark, "versions")
    log = table(spark, d, "application_tracking")
    writers.write_version(log.limit(0), root, "1")
    return spark.read.parquet(writers.write_version(log, root, "2", ["status"])).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT id FROM jobs WHERE status = 'applied' AND ingest_batch_id = 'batch-000003'")
def named_arguments(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    return spark.sql("SELECT id FROM {jobs} WHERE status = :status AND ingest_batch_id = :batch", args={"status": "applied", "batch": "batch-000003"}, jobs=jobs)


@query("SELECT column_name AS name FROM (DESCRIBE jobs)")
def column_names(spark: SparkSession, d: str) -> DataFrame:
    return readers.columns_of(table(spark, d, "jobs"))
