"""Queries of imports, duplicate resolution, sessions and merges over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import text, times, urls
from leadloom.operators import counts, dedupe, merging, resolution, selection, timeline
from leadloom.plans.queries import _ITEMS, _TS, _session_items, _when, query
from leadloom.runtime import table

#: White space as the pattern language of the SQL writes it; braces are doubled for ``format``.
_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]".replace("{", "{{").replace("}", "}}")
_CLEAN = "nullif(regexp_replace(regexp_replace({0}, '" + _SPACE + "+$', ''), '^" + _SPACE + "+', ''), '')"
_KEY = "nullif(trim(regexp_replace(replace(lower(" + _CLEAN + "), 'ß', 'ss'), '[," + _SPACE[1:] + "+', ' ', 'g')), '')"
_KNOWN = ("offer", "rejected", "interview", "assessment", "recruiter_screen", "applied", "skipped", "opened", "new", "invalid_location", "superseded")
_STATUS = "CASE WHEN lower(" + _CLEAN + ") IN ('" + "', '".join(_KNOWN) + "') THEN lower(" + _CLEAN + ") ELSE 'new' END"
_WORDS = "len(regexp_extract_all(title, '[A-Za-z0-9]+'))"
_LAST = f"SELECT job_id, arg_max(status, ({_TS.format('created_at')}, id)) AS s FROM application_tracking {{0}} GROUP BY job_id"
_HAS = "SELECT DISTINCT job_id FROM applications WHERE applied_at IS NOT NULL"


def _jobs_with_state(spark: SparkSession, d: str, kept_only: bool) -> DataFrame:
    """Jobs with the latest logged status (replaced ones left out if asked) and whether they were applied for."""
    log = table(spark, d, "application_tracking")
    last = timeline.latest_per_key(log, "job_id", "status", _when(), F.col("status") != "superseded" if kept_only else None, "logged")
    jobs = table(spark, d, "jobs").join(last, F.col("id") == F.col("job_id"), "left").drop("job_id")
    applied = table(spark, d, "applications").filter("applied_at is not null")
    return timeline.flag_exists(jobs, applied, "id", "job_id", "applied")


@query(f"SELECT id, CASE WHEN {_KEY.format('source_job_id')} IS NOT NULL THEN a || '|job_id|' || {_KEY.format('source_job_id')} ELSE a || '|' || coalesce({_KEY.format('company')}, '<missing-company>') || '|' || "
       f"coalesce({_KEY.format('title')}, '<missing-title>') || '|' || coalesce({_KEY.format('location')}, '<missing-location>') END AS identity FROM (SELECT *, coalesce(lower({_CLEAN.format('portal_type')}), "
       f"nullif(lower(regexp_extract({_CLEAN.format('apply_url')}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ''), {_KEY.format('source')}, '<missing-source>') AS a FROM jobs)")  # fmt: skip
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    key = urls.identity_key(c("apply_url"), F.lit(None).cast("string"), c("portal_type"), c("source_job_id"), c("company"), c("title"), c("location"), c("source"))
    return table(spark, d, "jobs").select("id", key.alias("identity"))


@query("WITH n AS (SELECT id AS seq, apply_url, canonical_apply_url AS canonical, identity_key AS identity, source_job_id FROM jobs WHERE ingest_batch_id >= 'batch-000010'), o AS (SELECT * FROM jobs WHERE ingest_batch_id IS NULL OR ingest_batch_id < 'batch-000010'), "
       "l AS (SELECT seq, apply_url, CASE WHEN apply_url IS NULL OR source_job_id IS NOT NULL THEN identity END AS k, (SELECT min(o.id) FROM o WHERE o.apply_url = n.apply_url) AS u, "
       "CASE WHEN apply_url IS NULL OR source_job_id IS NOT NULL THEN (SELECT min(o.id) FROM o WHERE o.identity_key = n.identity) END AS i FROM n WHERE canonical IS NULL), "
       "e AS (SELECT seq, apply_url, identity FROM n WHERE canonical IS NOT NULL UNION ALL SELECT seq, apply_url, (SELECT identity FROM n WHERE n.seq = l.seq) FROM l WHERE u IS NULL AND i IS NULL), "
       "r AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE e.apply_url = l.apply_url AND e.seq < l.seq) AS ru, EXISTS (SELECT 1 FROM e WHERE e.identity = l.k AND e.seq < l.seq) AS ri FROM l) "
       "SELECT seq, 'inserted' AS outcome, NULL::BIGINT AS match_id, NULL::VARCHAR AS match_rule FROM n WHERE canonical IS NOT NULL UNION ALL SELECT seq, CASE WHEN u IS NOT NULL OR i IS NOT NULL OR ru OR ri THEN 'duplicate' ELSE 'inserted' END, "
       "coalesce(u, i), CASE WHEN u IS NOT NULL THEN 'exact apply_url match' WHEN i IS NOT NULL THEN 'identity key match' WHEN ru THEN 'exact apply_url match' WHEN ri THEN 'identity key match' END FROM r")  # fmt: skip
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", "ingest_batch_id", "apply_url", F.col("canonical_apply_url").alias("canonical"), F.col("identity_key").alias("identity"), "source_job_id")
    new = F.coalesce(F.col("ingest_batch_id") >= "batch-000010", F.lit(False))
    return resolution.import_plan(jobs.filter(new).withColumnRenamed("id", "seq"), jobs.filter(~new))


_LAST_KEPT = _LAST.format("WHERE status <> 'superseded'")
_PLAN = (f"WITH l AS ({_LAST_KEPT}), h AS ({_HAS}), j AS (SELECT id, canonical_apply_url AS url, title, {_STATUS.format('jobs.status')} AS now, {_STATUS.format('l.s')} AS logged, h.job_id IS NOT NULL AS has "
         "FROM jobs LEFT JOIN l ON l.job_id = jobs.id LEFT JOIN h ON h.job_id = jobs.id WHERE canonical_apply_url IS NOT NULL), b AS (SELECT *, CASE WHEN now = 'superseded' THEN logged ELSE now END AS base FROM j), "
         "r AS (SELECT *, CASE WHEN has AND base IN ('new', 'opened') THEN 'applied' ELSE base END AS goal FROM b), w AS (SELECT *, count(*) OVER (PARTITION BY url) AS rows, row_number() OVER (PARTITION BY url ORDER BY goal = 'applied' DESC, "
         f"list_position({list(_KNOWN)}, goal), {_WORDS} DESC, length(title) DESC, id) AS place FROM r)")  # fmt: skip


@query(_PLAN + " SELECT url AS canonical_apply_url, any_value(rows) AS rows, max(CASE WHEN place = 1 THEN id END) AS winner, max(CASE WHEN place = 1 THEN goal END) AS winner_status, string_agg(CASE WHEN place > 1 THEN id END, ',' ORDER BY id) AS superseded, "
       "coalesce(string_agg(CASE WHEN place = 1 AND now <> goal AND goal <> 'superseded' THEN id END, ','), '') AS reactivated, coalesce(string_agg(CASE WHEN now <> CASE WHEN place = 1 THEN goal ELSE 'superseded' END THEN id END, ',' ORDER BY id), '') AS changed "
       "FROM w WHERE rows > 1 GROUP BY url")  # fmt: skip
def resolution_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs_with_state(spark, d, True)
    q = text.title_quality(F.col("title"))
    plan = resolution.group_plan(rows, "canonical_apply_url", "id", F.col("status"), resolution.resolved_status(F.col("status"), F.col("logged"), F.col("applied")), [q["words"], q["chars"]])
    return plan.select("canonical_apply_url", "rows", "winner", "winner_status", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("superseded", "reactivated", "changed")])


@query(_PLAN + " SELECT id, goal AS status FROM r")
def resolved_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs_with_state(spark, d, True).filter("canonical_apply_url is not null")
    return rows.select("id", resolution.resolved_status(F.col("status"), F.col("logged"), F.col("applied")).alias("status"))


@query("SELECT canonical_apply_url, arg_max(id, (CASE WHEN s IN ('applied', 'recruiter_screen', 'assessment', 'interview', 'offer', 'rejected') THEN 2 WHEN s = 'opened' THEN 1 ELSE 0 END, " + _WORDS + ", length(title), -id)) AS preferred "
       "FROM (SELECT *, lower(trim(status)) AS s FROM jobs) WHERE canonical_apply_url IS NOT NULL GROUP BY 1")  # fmt: skip
def preferred_rows(spark: SparkSession, d: str) -> DataFrame:
    q = text.title_quality(F.col("title"))
    return resolution.preferred_rows(table(spark, d, "jobs"), "canonical_apply_url", "id", F.col("status"), [q["words"], q["chars"]])


@query(f"WITH l AS ({_LAST.format('')}), h AS ({_HAS}) SELECT id, coalesce(lower({_CLEAN.format('l.s')}), CASE WHEN h.job_id IS NOT NULL AND coalesce(lower({_CLEAN.format('status')}), 'new') IN ('new', 'opened') THEN 'applied' "
       f"ELSE coalesce(lower({_CLEAN.format('status')}), 'new') END) AS status FROM jobs LEFT JOIN l ON l.job_id = id LEFT JOIN h ON h.job_id = id")  # fmt: skip
def reconciled_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs_with_state(spark, d, False)
    return rows.select("id", resolution.reconciled_status(F.col("status"), F.col("logged"), F.col("applied")).alias("status"))


@query("WITH r AS (SELECT a.id AS seq, a.job_id AS id, row_number() OVER (PARTITION BY a.job_id ORDER BY a.id) AS k, j.status AS now, lower(trim(j.status)) AS s FROM applications a LEFT JOIN jobs j ON j.id = a.job_id) SELECT seq, id, CASE WHEN k > 1 THEN 'duplicate target ignored' "
       "WHEN now IS NULL THEN 'job id was not found' WHEN now = 'interview' THEN 'already interview' WHEN s NOT IN ('" + "', '".join(_KNOWN) + "') THEN 'unsupported current status' "
       "WHEN s NOT IN ('new', 'opened', 'applied', 'recruiter_screen', 'assessment', 'superseded', 'interview') THEN 'cannot move from ' || s || ' to interview' END AS reason FROM r")  # fmt: skip
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "applications").select(F.col("id").alias("seq"), F.col("job_id").alias("id"))
    return resolution.change_statuses(requests, table(spark, d, "jobs"), "interview")


@query(f"WITH e AS (SELECT job_id, status, {_TS.format('created_at')} AS moment, id FROM application_tracking UNION ALL SELECT job_id, 'applied', {_TS.format('applied_at')}, id + 1000000000 FROM applications WHERE applied_at IS NOT NULL) "
       "SELECT job_id, arg_max(status, (moment, id)) AS latest FROM e WHERE moment IS NOT NULL GROUP BY job_id")  # fmt: skip
def appended_state(spark: SparkSession, d: str) -> DataFrame:
    """Current state after events are appended to the log: derived, never updated in place."""
    log = table(spark, d, "application_tracking").select("job_id", "status", times.text_moment(F.col("created_at")).alias("at"), "id")
    new = table(spark, d, "applications").filter("applied_at is not null").select("job_id", F.lit("applied").alias("status"), times.text_moment(F.col("applied_at")).alias("at"), (F.col("id") + 1_000_000_000).alias("id"))
    return timeline.latest_per_key(log.unionByName(new).filter("at is not null"), "job_id", "status", [F.col("at"), F.col("id")])


@query(_ITEMS + " SELECT i.session, i.item_index, j.status FROM i LEFT JOIN jobs j ON j.id = i.id")
def manifest_statuses(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", "status")
    return _session_items(spark, d).join(jobs, "id", "left").select("session", "item_index", "status")


@query(_ITEMS + ", r AS (SELECT h.id AS session_id, h.ingest_batch_id, unnest([1, 1, 3, 1, 21, 2]) AS idx, unnest(range(6)) AS seq FROM session_history h), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY seq) AS k FROM r) "
       "SELECT session_id, seq, CASE WHEN k > 1 THEN 'duplicate manifest index ignored' WHEN i.id IS NULL THEN 'manifest index is out of range' END AS reason, CASE WHEN k = 1 THEN i.id END AS job_id FROM k LEFT JOIN i ON i.session = k.ingest_batch_id AND i.item_index = k.idx")  # fmt: skip
def session_marks(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in (1, 1, 3, 1, 21, 2)])
    r = table(spark, d, "session_history").select(F.col("id").alias("session_id"), F.col("ingest_batch_id").alias("session"), F.posexplode(wanted).alias("seq", "item_index"))
    return selection.marked(r, "session_id", _session_items(spark, d)).select("session_id", F.col("seq").cast("long").alias("seq"), "reason", "job_id")


@query(_ITEMS + " SELECT session AS ingest_batch_id, count(*) AS item_count, count(*) FILTER (trim(coalesce(apply_url, '')) <> '') AS launchable_count FROM i GROUP BY 1")
def session_starts(spark: SparkSession, d: str) -> DataFrame:
    """The history row of each session that would start: selected, frozen as a manifest, counted."""
    m = selection.manifest(_session_items(spark, d), "session", F.lit("2026-01-01T00:00:00Z"), ["id", "apply_url"])
    return m.select(F.col("session").alias("ingest_batch_id"), "item_count", F.size(F.filter("items", lambda x: text.clean_text(x["apply_url"]).isNotNull())).cast("long").alias("launchable_count"))


@query(_ITEMS + " SELECT session, CAST(sum((trim(coalesce(i.apply_url, '')) = '')::INT + (j.location IS NULL)::INT) AS BIGINT) AS warnings FROM i JOIN jobs j ON j.id = i.id GROUP BY 1")
def manifest_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the warnings over the items of each manifest."""
    items = _session_items(spark, d).join(table(spark, d, "jobs").select("id", "location"), "id")
    warned = F.array_compact(F.array(F.when(text.clean_text(F.col("apply_url")).isNull(), F.lit("missing apply_url")), F.when(F.col("location").isNull(), F.lit("missing location"))))
    m = selection.manifest(items.withColumn("warnings", warned), "session", F.lit(""), ["id", "warnings"])
    return m.select("session", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.size(x["warnings"])).alias("warnings"))


@query(f"SELECT id, item_count FROM session_history ORDER BY {_TS.format('created_at')} DESC, id DESC LIMIT 5")
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_history").orderBy(times.text_moment(F.col("created_at")).desc(), F.desc("id")).limit(5).select("id", "item_count")


@query(f"WITH l AS ({_LAST.format('')}), m AS (SELECT job_id, max({_TS.format('created_at')}) AS at FROM application_tracking GROUP BY 1) SELECT id, l.s AS latest_status, strftime(m.at, '%Y-%m-%dT%H:%M:%SZ') AS latest_at FROM jobs LEFT JOIN l ON l.job_id = id LEFT JOIN m ON m.job_id = id")
def jobs_with_latest(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "application_tracking")
    last = log.groupBy("job_id").agg(F.max_by("status", F.struct(*_when())).alias("latest_status"), times.iso_z(F.max(times.text_moment(F.col("created_at")))).alias("latest_at"))
    return table(spark, d, "jobs").select("id").join(last, F.col("id") == F.col("job_id"), "left").drop("job_id")


@query("WITH q AS (SELECT id, title, location, row_number() OVER (ORDER BY " + _WORDS + " DESC, length(title) DESC, id) AS rank FROM jobs WHERE status = 'new' QUALIFY rank <= 50) "
       "SELECT id, rank AS prior_rank, row_number() OVER (ORDER BY contains(' ' || trim(regexp_replace(lower(coalesce(location, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' remote ') DESC, rank) AS rank FROM q")  # fmt: skip
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    """A ranked queue of 50 ranked again: remote ones first, then by their rank before."""
    q = text.title_quality(F.col("title"))
    rows = selection.scan(table(spark, d, "jobs"), status="new").select("id", "location", q["words"].alias("w"), q["chars"].alias("c"))
    first = selection.ranked(rows, [F.desc("w"), F.desc("c"), F.asc("id")], 50)
    again = selection.reranked(first, {"hit": text.has_phrase(F.col("location"), "remote")})
    return again.select("id", F.col("prior_rank").cast("long").alias("prior_rank"), F.col("rank").cast("long").alias("rank"))


@query("SELECT id FROM jobs WHERE status = 'new' AND trim(coalesce(apply_url, '')) <> '' ORDER BY id LIMIT 20")
def clamped_selection(spark: SparkSession, d: str) -> DataFrame:
    """A limit of 50 asked for, cut to the hard limit of 20, over rows that can be launched."""
    limit, _ = resolution.clamped(50, 20)
    return selection.scan(table(spark, d, "jobs"), status="new").filter(text.clean_text(F.col("apply_url")).isNotNull()).select("id").orderBy("id").limit(limit)


@query("WITH t AS (SELECT portal_type, apply_url, min(id) AS id FROM jobs WHERE apply_url IS NOT NULL GROUP BY 1, 2) SELECT portal_type, apply_url, row_number() OVER (PARTITION BY portal_type ORDER BY length(apply_url) DESC, id, apply_url) AS position FROM t QUALIFY position <= 3")
def longest_links(spark: SparkSession, d: str) -> DataFrame:
    """Three links of each portal, each URL once."""
    rows = table(spark, d, "jobs").filter("apply_url is not null").groupBy("portal_type", "apply_url").agg(F.min("id").alias("id"))
    top = selection.top_per_group(rows, ["portal_type"], [F.desc(F.length("apply_url")), F.asc("id"), F.asc("apply_url")], 3)
    return top.select("portal_type", "apply_url", F.col("position").cast("long").alias("position"))


_BOARDS = "(SELECT r.id, r.portal_type, r.normalized_url AS url, count(j.id) AS jobs FROM source_registry r LEFT JOIN jobs j ON j.source_registry_id = r.id GROUP BY 1, 2, 3)"
_PORTALS = ("greenhouse", "lever", "ashby", "workday")


def _boards(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "jobs").filter("source_registry_id is not null").groupBy("source_registry_id").agg(F.count("*").alias("jobs"))
    r = table(spark, d, "source_registry").select("id", "portal_type", F.col("normalized_url").alias("url"))
    return r.join(n, F.col("id") == F.col("source_registry_id"), "left").select("id", "portal_type", "url", F.coalesce("jobs", F.lit(0)).alias("jobs"))


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(list_position({list(_PORTALS)}, portal_type), 99), jobs DESC, url) AS position FROM {_BOARDS}")
def census_order(spark: SparkSession, d: str) -> DataFrame:
    """Boards by portal, number of jobs and URL, numbered by a distributed sort (:func:`leadloom.operators.selection.numbered`)."""
    known = resolution.place_in(F.col("portal_type"), _PORTALS)
    return selection.numbered(_boards(spark, d), [F.desc_nulls_last(known), F.desc("jobs"), F.asc("url")], "position").select("id", "position")


@query("SELECT id, row_number() OVER (ORDER BY lower(coalesce(company, label, source_url)), id) AS position FROM source_registry")
def company_order(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.coalesce("company", "label", "source_url"))
    return selection.numbered(table(spark, d, "source_registry").select("id", name.alias("name")), [F.asc("name"), F.asc("id")], "position").select("id", "position")


@query("SELECT id, CASE WHEN row_number() OVER (ORDER BY id) > 25 THEN 'candidate_limit_reached' END AS reason FROM source_registry WHERE status = 'manual_review'")
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates to verify; those beyond the first 25 are kept with the reason they wait."""
    rows = selection.numbered(table(spark, d, "source_registry").filter("status = 'manual_review'").select("id"), [F.asc("id")], "n")
    return rows.select("id", F.when(F.col("n") > 25, "candidate_limit_reached").alias("reason"))


@query(_ITEMS + " SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY item_index) AS step FROM i WHERE trim(coalesce(apply_url, '')) <> ''")
def dry_run_order(spark: SparkSession, d: str) -> DataFrame:
    plan = selection.launch_order(_session_items(spark, d), "session", "item_index", "apply_url")
    return plan.filter("launchable").select("session", "id", F.col("launch_position").alias("step"))


@query("SELECT 'id' AS kind, id FROM jobs WHERE id = 17 UNION ALL SELECT 'url', id FROM jobs WHERE 'https://nowhere.example/x' IN (apply_url, canonical_apply_url)")
def referenced_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    a = dedupe.by_reference(jobs, " 17 ").select(F.lit("id").alias("kind"), "id")
    return a.unionByName(dedupe.by_reference(jobs, "https://nowhere.example/x").select(F.lit("url").alias("kind"), "id"))


@query("SELECT id FROM jobs WHERE status IN ('offer', 'interview', 'assessment') AND ingest_batch_id IN (SELECT ingest_batch_id FROM session_history)")
def listed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A short list as a filter, a table as a half join."""
    sessions = table(spark, d, "session_history").select("ingest_batch_id")
    return table(spark, d, "jobs").filter(F.col("status").isin("offer", "interview", "assessment")).join(sessions, "ingest_batch_id", "left_semi").select("id")


@query("SELECT id, NULL::VARCHAR AS score_text, company FROM jobs")
def with_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return selection.with_columns(table(spark, d, "jobs"), ["id", "score_text", "company"])


@query("SELECT id FROM jobs WHERE status = 'new' AND ingest_batch_id = 'batch-000005' AND contains(lower(concat_ws(' ', company, title)), 'engineer') UNION ALL SELECT id FROM jobs WHERE status = 'new' AND ingest_batch_id = 'batch-000006'")
def batch_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue of one batch with a query, and one of another without; a condition that isn't asked for is not in the plan."""
    jobs = table(spark, d, "jobs")
    one = selection.scan(jobs, status="new", batch="batch-000005", query="an Engineer with the or", text_columns=("company", "title"))
    return one.select("id").unionByName(selection.scan(jobs, status="new", batch="batch-000006").select("id"))


@query("SELECT count(*) AS rows, count(*) FILTER (status = 'active') AS collected, count(*) FILTER (status = 'manual_review') AS manual_review, count(*) FILTER (status NOT IN ('active', 'manual_review')) AS skipped, count(DISTINCT portal_type) AS portals FROM source_registry")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    r = table(spark, d, "source_registry")
    return r.agg(F.count("*").alias("rows"), F.count_if(s == "active").alias("collected"), F.count_if(s == "manual_review").alias("manual_review"), F.count_if(~s.isin("active", "manual_review")).alias("skipped"), F.countDistinct("portal_type").alias("portals"))


@query("SELECT company, count(*) AS n FROM jobs WHERE contains(lower(title), 'data') GROUP BY company ORDER BY n DESC, lower(company), company LIMIT 10")
def top_matching(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").filter(F.lower("title").contains("data")).groupBy("company").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.lower("company"), "company").limit(10)


@query("SELECT coalesce(portal_type, 'all') AS portal_type, count(*) AS rows FROM (SELECT portal_type FROM jobs WHERE portal_type IN ('greenhouse', 'lever', 'ashby', 'workday')) GROUP BY ROLLUP (portal_type)")
def totals_with_grand_total(spark: SparkSession, d: str) -> DataFrame:
    each = counts.totals_with_zeros(table(spark, d, "jobs"), "portal_type", list(_PORTALS), F.lit(1))
    return each.rollup("portal_type").agg(F.sum("rows").alias("rows")).select(F.coalesce("portal_type", F.lit("all")).alias("portal_type"), "rows")


@query("WITH n AS (SELECT * FROM jobs WHERE ingest_batch_id >= 'batch-000010'), o AS (SELECT * FROM jobs WHERE ingest_batch_id IS NULL OR ingest_batch_id < 'batch-000010'), "
       "r AS (SELECT CASE WHEN apply_url IN (SELECT apply_url FROM o WHERE apply_url IS NOT NULL) THEN 'url' WHEN canonical_apply_url IN (SELECT canonical_apply_url FROM o WHERE canonical_apply_url IS NOT NULL) THEN 'canonical' "
       "WHEN identity_key IN (SELECT identity_key FROM o WHERE identity_key IS NOT NULL) THEN 'identity' ELSE 'inserted' END AS rule FROM n) SELECT rule, count(*) AS n FROM r GROUP BY 1")  # fmt: skip
def merge_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a merge by what becomes of them: matched under each rule, or inserted."""
    jobs = table(spark, d, "jobs").select("id", "ingest_batch_id", "apply_url", "canonical_apply_url", "identity_key")
    new = F.coalesce(F.col("ingest_batch_id") >= "batch-000010", F.lit(False))
    rules = [("url", ["apply_url"]), ("canonical", ["canonical_apply_url"]), ("identity", ["identity_key"])]
    return dedupe.lookup(jobs.filter(new), jobs.filter(~new), "id", rules).groupBy(F.coalesce("match_rule", F.lit("inserted")).alias("rule")).agg(F.count("*").alias("n"))


_SIDES = ("WITH t AS (SELECT normalized_url AS url, company, label, status, last_verified_at AS at, verification_reason AS reason FROM source_registry WHERE id <= 500), s AS (SELECT normalized_url AS url, coalesce(label, company) AS company, label, "
          "CASE status WHEN 'active' THEN 'inactive' ELSE 'active' END AS status, coalesce(last_verified_at, '2024-01-01') AS at, 'again' AS reason FROM source_registry WHERE id > 250)")  # fmt: skip


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping snapshots of the registry."""
    r = table(spark, d, "source_registry")
    t = r.filter("id <= 500").select(F.col("normalized_url").alias("url"), "company", "label", "status", F.col("last_verified_at").alias("at"), F.col("verification_reason").alias("reason"))
    s = r.filter("id > 250").select(F.col("normalized_url").alias("url"), F.coalesce("label", "company").alias("company"), "label", F.when(F.col("status") == "active", "inactive").otherwise("active").alias("status"), F.coalesce("last_verified_at", F.lit("2024-01-01")).alias("at"), F.lit("again").alias("reason"))
    return t, s


@query(_SIDES + " SELECT url, coalesce(t.company, s.company) AS company, CASE WHEN greatest(coalesce(list_position(['inactive', 'manual_review', 'active'], t.status), 0), coalesce(list_position(['inactive', 'manual_review', 'active'], s.status), 0)) = 0 THEN 'manual_review' "
       "ELSE ['inactive', 'manual_review', 'active'][greatest(coalesce(list_position(['inactive', 'manual_review', 'active'], t.status), 0), coalesce(list_position(['inactive', 'manual_review', 'active'], s.status), 0))] END AS status, "
       "CASE WHEN s.at IS NOT NULL AND (t.at IS NULL OR s.at >= t.at) THEN coalesce(s.reason, t.reason) ELSE coalesce(t.reason, s.reason) END AS reason FROM t FULL JOIN s USING (url)")  # fmt: skip
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields filled, the better status, and the verification of the side verified last."""
    t, s = _sides(spark, d)
    j = t.select("url", *[F.col(c).alias(f"t_{c}") for c in t.columns if c != "url"]).join(s.select("url", *[F.col(c).alias(f"s_{c}") for c in s.columns if c != "url"]), "url", "full_outer")
    order = ("active", "manual_review", "inactive")
    a, b = F.coalesce(resolution.place_in(F.col("t_status"), order), F.lit(0)), F.coalesce(resolution.place_in(F.col("s_status"), order), F.lit(0))
    status = F.coalesce(F.when(b > a, F.col("s_status")).when(a > 0, F.col("t_status")), F.lit("manual_review"))
    return j.select("url", F.coalesce("t_company", "s_company").alias("company"), status.alias("status"), resolution.newer_side(F.col("t_reason"), F.col("s_reason"), F.col("t_at"), F.col("s_at")).alias("reason"))


@query(_SIDES + " SELECT url, CASE WHEN t.url IS NULL THEN 'created' WHEN s.url IS NULL THEN 'untouched' WHEN t.status = 'active' OR t.status = s.status THEN 'unchanged' ELSE 'updated' END AS outcome FROM t FULL JOIN s USING (url)")
def registry_upsert_keeping_active(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of statuses that leaves active rows active."""
    t, s = _sides(spark, d)
    return merging.classify_upsert(t, merging.keep_where(t, s, "url", "status", F.lit("active")), "url", ["status"])


@query(f"WITH t AS (SELECT * FROM jobs WHERE canonical_apply_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_apply_url ORDER BY id) = 1), s AS (SELECT * FROM jobs WHERE canonical_apply_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_apply_url ORDER BY id DESC) = 1) "
       f"SELECT t.id, coalesce(t.salary_text, s.salary_text) AS salary_text, least(t.created_at, s.created_at) AS created_at, CASE WHEN coalesce(lower({_CLEAN.format('t.status')}), 'new') = 'new' THEN coalesce(lower({_CLEAN.format('s.status')}), 'new') "
       f"ELSE lower({_CLEAN.format('t.status')}) END AS status FROM t JOIN s ON t.canonical_apply_url = s.canonical_apply_url")  # fmt: skip
def job_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each URL filled from the last one; its status gives way only while it is new."""
    row = F.struct("id", "salary_text", "created_at", "status")
    g = table(spark, d, "jobs").filter("canonical_apply_url is not null").groupBy("canonical_apply_url").agg(F.min_by(row, "id").alias("t"), F.max_by(row, "id").alias("s"))
    return g.select("t.id", F.coalesce("t.salary_text", "s.salary_text").alias("salary_text"), times.earliest(F.col("t.created_at"), F.col("s.created_at")).alias("created_at"), resolution.filled_status(F.col("t.status"), F.col("s.status")).alias("status"))


@query("WITH t AS (SELECT * FROM jobs WHERE ingest_batch_id IS NULL OR ingest_batch_id < 'batch-000010'), s AS (SELECT * FROM jobs WHERE ingest_batch_id >= 'batch-000010') "
       "SELECT s.id AS old, coalesce((SELECT min(t.id) FROM t WHERE t.canonical_apply_url IS NOT DISTINCT FROM s.canonical_apply_url), s.id + (SELECT max(id) FROM t)) AS new FROM s")  # fmt: skip
def migrated_ids(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", "ingest_batch_id", "canonical_apply_url", "title")
    new = F.coalesce(F.col("ingest_batch_id") >= "batch-000010", F.lit(False))
    return resolution.migrate(jobs.filter(~new), jobs.filter(new), "canonical_apply_url", "id")[1]


@query("WITH t AS (SELECT * FROM jobs WHERE ingest_batch_id IS NULL OR ingest_batch_id < 'batch-000010'), s AS (SELECT * FROM jobs WHERE ingest_batch_id >= 'batch-000010'), m AS (SELECT s.id AS old, "
       "coalesce((SELECT min(t.id) FROM t WHERE t.canonical_apply_url IS NOT DISTINCT FROM s.canonical_apply_url), s.id + (SELECT max(id) FROM t)) AS new FROM s), j AS (SELECT id, status FROM t UNION ALL SELECT new, status FROM s JOIN m ON m.old = s.id WHERE new NOT IN (SELECT id FROM t)), "
       f"e AS (SELECT coalesce(m.new, a.job_id) AS job_id, status, {_TS.format('created_at')} AS moment, id FROM application_tracking a LEFT JOIN m ON m.old = a.job_id), l AS (SELECT job_id, arg_max(status, (moment, id)) AS s FROM e GROUP BY 1) "
       f"SELECT j.id, coalesce(lower({_CLEAN.format('l.s')}), lower({_CLEAN.format('j.status')}), 'new') AS status FROM j LEFT JOIN l ON l.job_id = j.id")  # fmt: skip
def merge_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of jobs to one: ids mapped, rows added, logs moved to the new ids, statuses reconciled; whatever the added rows and children refer to exists."""
    jobs = table(spark, d, "jobs").select("id", "ingest_batch_id", "canonical_apply_url", "status")
    new = F.coalesce(F.col("ingest_batch_id") >= "batch-000010", F.lit(False))
    target = jobs.filter(~new)
    added, mapping = resolution.migrate(target, jobs.filter(new), "canonical_apply_url", "id")
    log = table(spark, d, "application_tracking").join(mapping, F.col("job_id") == F.col("old"), "left").select(F.coalesce("new", "job_id").alias("job_id"), "status", "created_at", "id")
    last = timeline.latest_per_key(log, "job_id", "status", _when(), None, "logged")
    merged = target.unionByName(added).join(last, F.col("id") == F.col("job_id"), "left")
    return merged.select("id", resolution.reconciled_status(F.col("status"), F.col("logged"), F.lit(False)).alias("status"))


_NAME = "trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[''’\"]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_FORMS = "ag|bv|co|company|corp|corporation|gmbh|inc|incorporated|limited|llc|llp|lp|ltd|oy|plc|pte|pty|sa"
_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(" + _NAME + ", '^the(\\s+|$)', ''), '((^|\\s+)(" + _FORMS + "))+$', ''), ' '), lambda w: w <> '')"


@query(f"WITH p AS (SELECT DISTINCT source_registry_id AS registry_id, company FROM jobs WHERE source_registry_id IS NOT NULL), t AS (SELECT p.registry_id, p.company, {_TOKENS.format('p.company')} AS a, {_TOKENS.format('r.company')} AS b FROM p JOIN source_registry r ON r.id = p.registry_id) "
       "SELECT registry_id, company, CASE WHEN b IS NULL OR len(b) = 0 THEN 'missing' WHEN list_aggregate(a, 'string_agg', '') = list_aggregate(b, 'string_agg', '') THEN 'exact' WHEN len(list_intersect(a, b)) > 0 THEN 'overlap' ELSE 'mismatch' END AS verdict, len(list_distinct(list_intersect(a, b))) AS shared FROM t")  # fmt: skip
def company_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names of the jobs of a registry row against its own: equal keys, shared words, or neither."""
    pairs = table(spark, d, "jobs").filter("source_registry_id is not null").select(F.col("source_registry_id").alias("registry_id"), "company").distinct()
    r = table(spark, d, "source_registry").select(F.col("id").alias("registry_id"), F.col("company").alias("known"))
    return counts.name_verdicts(pairs.join(r, "registry_id"), "company", "known").select("registry_id", "company", "verdict", F.col("shared").cast("long").alias("shared"))


@query(f"WITH r AS (SELECT id, list_aggregate({_TOKENS.format('company')}, 'string_agg', '') AS k, status FROM source_registry) SELECT j.id, r.registry_id FROM (SELECT id, list_aggregate({_TOKENS.format('company')}, 'string_agg', '') AS k FROM jobs) j "
       "LEFT JOIN (SELECT k, arg_min(id, (CASE status WHEN 'active' THEN 0 WHEN 'manual_review' THEN 1 ELSE 2 END, id)) AS registry_id FROM r WHERE k IS NOT NULL AND k <> '' GROUP BY k) r ON r.k = j.k")  # fmt: skip
def company_probes(spark: SparkSession, d: str) -> DataFrame:
    """Each job with the registry row that answers for its company: an active one first, then one in review, then the first."""
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "manual_review", 1).otherwise(2)
    best = table(spark, d, "source_registry").select("id", text.company_key(F.col("company")).alias("key"), rank.alias("rank")).filter("key is not null")
    best = best.groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("registry_id"))
    return table(spark, d, "jobs").select("id", text.company_key(F.col("company")).alias("key")).join(best, "key", "left").select("id", "registry_id")
