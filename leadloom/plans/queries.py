"""Queries of the data-processing operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import html, text, times, urls
from leadloom.operators import counts, dedupe, merging, selection, timeline
from leadloom.runtime import table

#: The invented boards of the test tables.
BOARDS = (
    urls.Portal("greenhouse", r"^boards\.hireglade\.example$", ("gh_src",), "gh_jid", "jobs/"),
    urls.Portal("lever", r"^jobs\.levrano\.example$", ("lever-source",)),
    urls.Portal("ashby", r"^jobs\.ashwick\.example$", ("ashby_source",), "jobid", ""),
    urls.Portal("workday", r"\.workmere\.example$", ("source",), root=False, job_marker="/job/", trims_apply=True),
)
STEPS = (("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "signup"), ("click", "view"))
Q, S = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_TS = "TRY_CAST(replace(replace({0}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


@query("SELECT 'jobs' AS table_name, count(*) AS n FROM jobs UNION ALL SELECT 'source_registry', count(*) FROM source_registry UNION ALL SELECT 'applications', count(*) FROM applications "
       "UNION ALL SELECT 'application_tracking', count(*) FROM application_tracking UNION ALL SELECT 'session_history', count(*) FROM session_history")  # fmt: skip
def total_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("jobs", "source_registry", "applications", "application_tracking", "session_history")
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


@query(f"WITH a AS (SELECT max({_TS.format('created_at')}) m FROM session_history) SELECT count(*) AS sessions, count(DISTINCT ingest_batch_id) AS batches FROM session_history, a "
       f"WHERE {_TS.format('created_at')} >= m - INTERVAL 180 DAY")  # fmt: skip
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "session_history")
    as_of = h.agg(F.max(times.text_moment(F.col("created_at"))).alias("as_of"))
    rows = h.join(F.broadcast(as_of), times.within_days(F.col("created_at"), F.col("as_of"), 180))
    return rows.agg(F.count("*").alias("sessions"), F.countDistinct("ingest_batch_id").alias("batches"))


@query("SELECT coalesce(portal_type, 'unknown') AS portal, count(*) AS n FROM jobs GROUP BY 1")
def portal_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy(F.coalesce("portal_type", F.lit("unknown")).alias("portal")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "portal")


@query("SELECT company, count(*) AS n FROM jobs GROUP BY company ORDER BY n DESC, company LIMIT 5")
def top_companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(5)


@query("SELECT ingest_batch_id, min(source_query) AS source_query, min(import_source) AS import_source, count(*) AS n FROM jobs GROUP BY ingest_batch_id")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("ingest_batch_id").agg(F.min("source_query").alias("source_query"), F.min("import_source").alias("import_source"), F.count("*").alias("n"))


@query("SELECT canonical_apply_url, min(id) AS first_id, count(*) AS n FROM jobs WHERE canonical_apply_url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").filter("canonical_apply_url is not null").groupBy("canonical_apply_url")
    return g.agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT coalesce(max(j.id), 0) AS jobs, (SELECT coalesce(max(id), 0) FROM applications) AS applications FROM jobs j")
def max_ids(spark: SparkSession, d: str) -> DataFrame:
    def top(t: str) -> DataFrame:
        return table(spark, d, t).agg(F.coalesce(F.max("id"), F.lit(0)).alias(t), F.count("*").alias(f"_{t}"))

    a, b = top("jobs").withColumn("k", F.col("_jobs") >= 0), top("applications").withColumn("k", F.col("_applications") >= 0)
    return a.join(b, "k").select("jobs", "applications")


@query("SELECT h.id AS session_id, j.status, count(*) AS n FROM session_history h JOIN jobs j ON j.ingest_batch_id = h.ingest_batch_id WHERE j.status IS NOT NULL GROUP BY 1, 2")
def session_status_counts(spark: SparkSession, d: str) -> DataFrame:
    per_batch = table(spark, d, "jobs").filter("status is not null").groupBy("ingest_batch_id", "status").agg(F.count("*").alias("n"))
    sessions = table(spark, d, "session_history").select(F.col("id").alias("session_id"), "ingest_batch_id")
    return sessions.join(per_batch, "ingest_batch_id").select("session_id", "status", "n")


def _when() -> list[Column]:
    return [times.text_moment(F.col("created_at")), F.col("id")]


@query(f"SELECT job_id, arg_max(status, ({_TS.format('created_at')}, id)) AS latest FROM application_tracking GROUP BY job_id")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return timeline.latest_per_key(table(spark, d, "application_tracking"), "job_id", "status", _when())


@query(f"SELECT job_id, arg_max(status, ({_TS.format('created_at')}, id)) AS latest FROM application_tracking WHERE status <> 'superseded' GROUP BY job_id")
def latest_status_kept(spark: SparkSession, d: str) -> DataFrame:
    return timeline.latest_per_key(table(spark, d, "application_tracking"), "job_id", "status", _when(), F.col("status") != "superseded")


@query(f"SELECT job_id, strftime(max({_TS.format('created_at')}), '%Y-%m-%dT%H:%M:%SZ') AS applied_at FROM application_tracking WHERE status = 'applied' GROUP BY job_id")
def latest_applied(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "application_tracking").filter("status = 'applied'")
    return log.groupBy("job_id").agg(times.iso_z(F.max(times.text_moment(F.col("created_at")))).alias("applied_at"))


@query("SELECT id, EXISTS (SELECT 1 FROM applications a WHERE a.job_id = j.id AND a.applied_at IS NOT NULL) AS has_applied FROM jobs j")
def applied_flag(spark: SparkSession, d: str) -> DataFrame:
    applied = table(spark, d, "applications").filter("applied_at is not null")
    return timeline.flag_exists(table(spark, d, "jobs").select("id"), applied, "id", "job_id", "has_applied")


@query("SELECT id, job_id FROM applications a WHERE NOT EXISTS (SELECT 1 FROM application_tracking t WHERE t.job_id = a.job_id)")
def orphan_applications(spark: SparkSession, d: str) -> DataFrame:
    return timeline.orphans(table(spark, d, "applications").select("id", "job_id"), table(spark, d, "application_tracking"), "job_id", "job_id")


@query("SELECT id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.job_id = j.id)")
def jobs_without_application(spark: SparkSession, d: str) -> DataFrame:
    return timeline.orphans(table(spark, d, "jobs").select("id"), table(spark, d, "applications"), "id", "job_id")


@query("SELECT 'jobs.source_registry_id' AS reference, count(*) AS broken FROM jobs j WHERE source_registry_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_registry r WHERE r.id = j.source_registry_id) "
       "UNION ALL SELECT 'applications.job_id', count(*) FROM applications a WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id) "
       "UNION ALL SELECT 'application_tracking.job_id', count(*) FROM application_tracking a WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id)")  # fmt: skip
def broken_references(spark: SparkSession, d: str) -> DataFrame:
    checks = (("jobs", "source_registry_id", "source_registry"), ("applications", "job_id", "jobs"), ("application_tracking", "job_id", "jobs"))
    out = None
    for child, key, parent in checks:
        bad = timeline.orphans(table(spark, d, child).filter(F.col(key).isNotNull()).select(key), table(spark, d, parent), key, "id")
        part = bad.agg(F.count("*").alias("broken")).select(F.lit(f"{child}.{key}").alias("reference"), "broken")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT event_id, previous, "
       "previous IS NULL OR previous = event_type OR (previous, event_type) IN (('view','click'), ('click','purchase'), ('signup','view'), ('view','signup'), ('click','view')) AS allowed FROM s")  # fmt: skip
def transition_audit(spark: SparkSession, d: str) -> DataFrame:
    out = timeline.transitions(table(spark, d, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], STEPS)
    return out.select("event_id", "previous", "allowed")


@query(f"SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY {_TS.format('created_at')}, id) AS place FROM application_tracking")
def log_timeline(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.rank_in_group(table(spark, d, "application_tracking"), ["job_id"], _when()).select("id", "job_id", F.col("place").cast("long").alias("place"))


_TEXT = ("company", "title", "location", "source", "portal_type", "apply_url", "raw_json")
_HAY = "lower(concat_ws(' ', " + ", ".join(f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')" for c in _TEXT) + "))"


@query(f"SELECT id FROM jobs WHERE contains({_HAY}, 'senior') AND contains({_HAY}, 'data') AND status = 'new'")
def query_filter(spark: SparkSession, d: str) -> DataFrame:
    return selection.scan(table(spark, d, "jobs"), status="new", query="the senior or with Data on", text_columns=_TEXT).select("id")


@query("SELECT id FROM jobs WHERE contains(' ' || trim(regexp_replace(lower(coalesce(location, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' remote ')")
def remote_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").filter(text.has_phrase(F.col("location"), "remote")).select("id")


@query("SELECT id FROM jobs WHERE NOT regexp_matches(coalesce(apply_url, ''), '^[\\s\\x{a0}\\x{3000}]*$')")
def launchable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").filter(text.clean_text(F.col("apply_url")).isNotNull()).select("id")


@query("SELECT id, CASE status WHEN 'active' THEN 0 WHEN 'manual_review' THEN 1 ELSE 2 END AS status_rank, coalesce(company, label, source_url) AS name FROM source_registry")
def registry_listing(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "manual_review", 1).otherwise(2)
    out = table(spark, d, "source_registry").select("id", rank.alias("status_rank"), F.coalesce("company", "label", "source_url").alias("name"))
    return out.orderBy("status_rank", "name", "id")


@query("SELECT id, row_number() OVER (ORDER BY len(regexp_extract_all(title, '[A-Za-z0-9]+')) DESC, length(title) DESC, id) AS rank FROM jobs WHERE status = 'new' QUALIFY rank <= 20")
def ranked_queue(spark: SparkSession, d: str) -> DataFrame:
    q = text.title_quality(F.col("title"))
    rows = selection.scan(table(spark, d, "jobs"), status="new").select("id", q["words"].alias("w"), q["chars"].alias("c"))
    return selection.ranked(rows, [F.desc("w"), F.desc("c"), F.asc("id")], 20).select("id", F.col("rank").cast("long").alias("rank"))


@query("SELECT least(count(*), 500) AS selected, greatest(count(*) - 500, 0) AS deferred FROM jobs WHERE status = 'new'")
def limit_report(spark: SparkSession, d: str) -> DataFrame:
    return selection.applied_and_deferred(selection.scan(table(spark, d, "jobs"), status="new"), 500)


@query("SELECT portal_type, id, row_number() OVER (PARTITION BY portal_type ORDER BY last_verified_at DESC NULLS LAST, id) AS position FROM source_registry QUALIFY position <= 3")
def registry_top(spark: SparkSession, d: str) -> DataFrame:
    top = selection.top_per_group(table(spark, d, "source_registry"), ["portal_type"], [F.desc_nulls_last("last_verified_at"), F.asc("id")], 3)
    return top.select("portal_type", "id", F.col("position").cast("long").alias("position"))


@query("SELECT id, row_number() OVER (PARTITION BY apply_url, source_job_id, company, title ORDER BY id) = 1 AS kept FROM jobs")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return timeline.first_wins(table(spark, d, "jobs"), ["apply_url", "source_job_id", "company", "title"], [F.col("id")]).select("id", "kept")


_ITEMS = ("WITH i AS (SELECT ingest_batch_id AS session, id, apply_url, row_number() OVER (PARTITION BY ingest_batch_id ORDER BY id) AS item_index FROM jobs WHERE ingest_batch_id IS NOT NULL QUALIFY item_index <= 20)")


def _session_items(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").filter("ingest_batch_id is not null").select(F.col("ingest_batch_id").alias("session"), "id", "apply_url")
    return selection.top_per_group(jobs, ["session"], [F.asc("id")], 20).withColumn("item_index", F.col("position").cast("long")).drop("position")


@query(_ITEMS + " SELECT id, trim(coalesce(apply_url, '')) <> '' AS launchable, CASE WHEN trim(coalesce(apply_url, '')) <> '' THEN "
       "CAST(sum(CAST(trim(coalesce(apply_url, '')) <> '' AS INT)) OVER (PARTITION BY session ORDER BY item_index) AS BIGINT) END AS launch_position FROM i")  # fmt: skip
def launch_plan(spark: SparkSession, d: str) -> DataFrame:
    return selection.launch_order(_session_items(spark, d), "session", "item_index", "apply_url").select("id", "launchable", "launch_position")


@query(_ITEMS + " SELECT session, item_index AS manifest_index, id FROM i")
def manifest_items(spark: SparkSession, d: str) -> DataFrame:
    m = selection.manifest(_session_items(spark, d), "session", F.lit("2026-01-01T00:00:00Z"), ["id", "apply_url"])
    return selection.manifest_items(m, "session").select("session", F.col("manifest_index").cast("long").alias("manifest_index"), "id")


@query("WITH c(position, portal_type) AS (VALUES (0, 'greenhouse'), (1, 'lever'), (2, 'ashby'), (3, 'workday'), (4, 'otherboard')) SELECT CAST(position AS INT) AS position, c.portal_type, "
       "count(j.id) AS rows, CAST(coalesce(sum(length(j.title)), 0) AS BIGINT) AS total FROM c LEFT JOIN jobs j ON j.portal_type = c.portal_type GROUP BY 1, 2")  # fmt: skip
def portal_totals(spark: SparkSession, d: str) -> DataFrame:
    return counts.totals_with_zeros(table(spark, d, "jobs"), "portal_type", ["greenhouse", "lever", "ashby", "workday", "otherboard"], F.length("title"))


@query("SELECT portal_type, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'manual_review') AS manual_review, count(*) FILTER (status = 'inactive') AS inactive FROM source_registry GROUP BY 1")
def provider_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return counts.pivot_counts(table(spark, d, "source_registry"), "portal_type", "status", ["active", "manual_review", "inactive"])


@query("SELECT count(*) FILTER (location IS NULL) AS no_location, count(*) FILTER (apply_url IS NULL) AS no_url, count(*) FILTER (source_job_id IS NULL AND apply_url IS NULL) AS no_requisition FROM jobs")
def condition_counters(spark: SparkSession, d: str) -> DataFrame:
    no_url = F.col("apply_url").isNull()
    return counts.counters(table(spark, d, "jobs"), {"no_location": F.col("location").isNull(), "no_url": no_url, "no_requisition": no_url & F.col("source_job_id").isNull()})


@query("SELECT regexp_replace(normalized_url, '-[0-9]+$', '') AS key, arg_min(source_url, id) AS first, count(*) - 1 AS duplicates FROM source_registry GROUP BY 1")
def collapsed_inputs(spark: SparkSession, d: str) -> DataFrame:
    out = dedupe.collapse_by_key(table(spark, d, "source_registry"), F.regexp_replace("normalized_url", "-[0-9]+$", ""), "id", "source_url")
    return out.select("key", "first", F.col("duplicates").cast("long").alias("duplicates"))


@query("SELECT company, count(*) AS n, round(count(*) FILTER (contains(lower(title), 'data')) * 100.0 / count(*), 1) AS percent FROM jobs GROUP BY company")
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").groupBy("company").agg(F.count("*").alias("n"), F.count_if(F.lower("title").contains("data")).alias("m"))
    return g.select("company", "n", counts.rate(F.col("m"), F.col("n")).alias("percent"))


@query("SELECT source_registry_id, CASE WHEN min(company) = max(company) THEN min(company) END AS company FROM jobs WHERE source_registry_id IS NOT NULL GROUP BY 1")
def single_company(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.only_value(table(spark, d, "jobs").filter("source_registry_id is not null"), "source_registry_id", "company")


@query("WITH n AS (SELECT * FROM jobs WHERE ingest_batch_id >= 'batch-000010'), o AS (SELECT * FROM jobs WHERE ingest_batch_id IS NULL OR ingest_batch_id < 'batch-000010'), "
       "a AS (SELECT apply_url k, min(id) i FROM o WHERE apply_url IS NOT NULL GROUP BY 1), b AS (SELECT canonical_apply_url k, min(id) i FROM o WHERE canonical_apply_url IS NOT NULL GROUP BY 1), "
       "c AS (SELECT identity_key k, min(id) i FROM o WHERE identity_key IS NOT NULL GROUP BY 1) SELECT n.id, coalesce(a.i, b.i, c.i) AS match_id, "
       "CASE WHEN a.i IS NOT NULL THEN 'url' WHEN b.i IS NOT NULL THEN 'canonical' WHEN c.i IS NOT NULL THEN 'identity' END AS match_rule "
       "FROM n LEFT JOIN a ON n.apply_url = a.k LEFT JOIN b ON n.canonical_apply_url = b.k LEFT JOIN c ON n.identity_key = c.k")  # fmt: skip
def duplicate_lookup(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", "ingest_batch_id", "apply_url", "canonical_apply_url", "identity_key")
    new = jobs.filter("ingest_batch_id >= 'batch-000010'")
    old = jobs.filter("ingest_batch_id is null or ingest_batch_id < 'batch-000010'")
    rules = [("url", ["apply_url"]), ("canonical", ["canonical_apply_url"]), ("identity", ["identity_key"])]
    return dedupe.lookup(new, old, "id", rules).select("id", "match_id", "match_rule")


@query("WITH w AS (SELECT DISTINCT apply_url AS wanted FROM jobs WHERE status = 'offer' AND apply_url IS NOT NULL), m AS (SELECT wanted, id, 'exact' AS match FROM w JOIN jobs ON wanted = apply_url "
       "UNION ALL SELECT wanted, id, 'canonical' FROM w JOIN jobs ON wanted = canonical_apply_url) SELECT wanted, id, max(match) AS match FROM m GROUP BY 1, 2")  # fmt: skip
def url_matches(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    wanted = jobs.filter("status = 'offer' and apply_url is not null").select(F.col("apply_url").alias("wanted")).distinct()
    return dedupe.exact_or_canonical(jobs, wanted, "id", "apply_url", "canonical_apply_url")


@query("SELECT canonical_apply_url, arg_max(id, (len(regexp_extract_all(title, '[A-Za-z0-9]+')), length(title), -id)) AS winner, count(*) - 1 AS losers FROM jobs WHERE canonical_apply_url IS NOT NULL "
       "GROUP BY 1 HAVING count(*) > 1")  # fmt: skip
def duplicate_winners(spark: SparkSession, d: str) -> DataFrame:
    q = text.title_quality(F.col("title"))
    return dedupe.group_winners(table(spark, d, "jobs"), "canonical_apply_url", "id", [q["words"], q["chars"]])


@query("WITH p AS (SELECT id, regexp_extract_all(trim(apply_url, E' \\t\\n\\r'), '^([A-Za-z]+)://([^/?#]*)/+([^/?#]+)', 1) s, lower(regexp_extract(trim(apply_url, E' \\t\\n\\r'), '^([A-Za-z]+)://([^/?#]*)', 1)) sc, "
       "lower(regexp_extract(trim(apply_url, E' \\t\\n\\r'), '^([A-Za-z]+)://([^/?#]*)', 2)) h, regexp_extract(trim(apply_url, E' \\t\\n\\r'), '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1) seg FROM jobs) "
       "SELECT p.id, r.id AS registry_id FROM p JOIN source_registry r ON r.normalized_url = sc || '://' || h || '/' || seg "
       "WHERE h IN ('boards.hireglade.example', 'jobs.levrano.example', 'jobs.ashwick.example') AND seg <> ''")  # fmt: skip
def registry_links(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", urls.board_root(F.col("apply_url"), None, BOARDS).alias("root")).filter("root is not null")
    registry = table(spark, d, "source_registry").select(F.col("id").alias("registry_id"), "normalized_url")
    return jobs.join(registry, jobs["root"] == registry["normalized_url"]).select("id", "registry_id")


@query("WITH m AS (SELECT id AS old, min(id) OVER (PARTITION BY canonical_apply_url) AS new FROM jobs WHERE canonical_apply_url IS NOT NULL) SELECT a.id, m.new AS job_id FROM applications a JOIN m ON a.job_id = m.old "
       "WHERE NOT EXISTS (SELECT 1 FROM applications b WHERE b.job_id = m.new AND b.state IS NOT DISTINCT FROM a.state AND b.resume_variant IS NOT DISTINCT FROM a.resume_variant)")  # fmt: skip
def child_remap(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").filter("canonical_apply_url is not null").select("id", "canonical_apply_url")
    first = jobs.groupBy("canonical_apply_url").agg(F.min("id").alias("new"))
    mapping = jobs.join(first, "canonical_apply_url").select(F.col("id").alias("old"), "new")
    apps = table(spark, d, "applications").select("id", "job_id", "state", "resume_variant")
    return merging.remap_children(apps, "job_id", mapping, apps, ["job_id", "state", "resume_variant"]).select("id", "job_id")


_EDGES = ("WITH t AS (SELECT canonical_apply_url AS url, title, status, found_at, created_at FROM jobs WHERE canonical_apply_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_apply_url ORDER BY id) = 1), "
          "s AS (SELECT canonical_apply_url AS url, title, status, found_at, created_at FROM jobs WHERE canonical_apply_url IS NOT NULL AND status <> 'superseded' "
          "QUALIFY row_number() OVER (PARTITION BY canonical_apply_url ORDER BY id DESC) = 1)")  # fmt: skip


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = table(spark, d, "jobs").filter("canonical_apply_url is not null")
    row = F.struct("title", "status", "found_at", "created_at")

    def edge(df: DataFrame, pick) -> DataFrame:  # noqa: ANN001
        return df.groupBy(F.col("canonical_apply_url").alias("url")).agg(pick(row, "id").alias("r")).select("url", "r.*")

    return edge(jobs, F.min_by), edge(jobs.filter("status <> 'superseded'"), F.max_by)


@query(_EDGES + " SELECT coalesce(t.url, s.url) AS url, coalesce(t.title, s.title) AS title, coalesce(s.status, t.status) AS status, least(t.created_at, s.created_at) AS created_at FROM t FULL JOIN s ON t.url = s.url")
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    t, s = _edges(spark, d)
    return merging.merge_snapshots(t, s, "url", {"title": "fill", "status": "source", "created_at": "min"})


@query(_EDGES + " SELECT coalesce(t.url, s.url) AS url, CASE WHEN t.url IS NULL THEN 'created' WHEN s.url IS NULL THEN 'untouched' WHEN t.title IS NOT DISTINCT FROM s.title AND t.status IS NOT DISTINCT FROM s.status "
       "THEN 'unchanged' ELSE 'updated' END AS outcome FROM t FULL JOIN s ON t.url = s.url")  # fmt: skip
def upsert_classes(spark: SparkSession, d: str) -> DataFrame:
    t, s = _edges(spark, d)
    return merging.classify_upsert(t, s, "url", ["title", "status"])


_TRIM = "nullif(regexp_replace(regexp_replace({0}, '[\\s\\x{{a0}}\\x{{2009}}\\x{{3000}}]+$', ''), '^[\\s\\x{{a0}}\\x{{2009}}\\x{{3000}}]+', ''), '')"


@query("SELECT field, count(*) AS rows FROM (SELECT unnest([CASE WHEN canonical_apply_url IS NULL AND " + _TRIM.format("apply_url") + " IS NOT NULL THEN 'canonical_apply_url' END, "
       "CASE WHEN location IS NULL AND title ILIKE '%remote%' THEN 'location' END]) AS field FROM jobs) WHERE field IS NOT NULL GROUP BY 1")  # fmt: skip
def backfill_report(spark: SparkSession, d: str) -> DataFrame:
    values = {"canonical_apply_url": urls.canonical_url(F.col("apply_url"), F.col("portal_type"), BOARDS), "location": F.when(F.lower("title").contains("remote"), F.lit("Remote"))}
    return merging.change_counts(merging.backfill(table(spark, d, "jobs").select("apply_url", "portal_type", "title", "canonical_apply_url", "location"), values))


_U = "regexp_replace(regexp_replace(apply_url, '\\s+$', ''), '^\\s+', '')"


@query(f"SELECT id, lower(regexp_extract({_U}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, "
       f"regexp_extract({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract({_U}, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract({_U}, '#(.*)$', 1) AS fragment FROM jobs WHERE apply_url IS NOT NULL")  # fmt: skip
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").filter("apply_url is not null").select("id", urls.url_parts(F.col("apply_url")).alias("p")).select("id", "p.*")


@query(f"SELECT id, coalesce(array_to_string(list_filter(string_split(regexp_extract({_U}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('gh_src', 'ref')), '&'), '') AS kept "
       "FROM jobs WHERE apply_url IS NOT NULL")  # fmt: skip
def tracking_dropped(spark: SparkSession, d: str) -> DataFrame:
    query_text = urls.url_parts(F.col("apply_url"))["query"]
    return table(spark, d, "jobs").filter("apply_url is not null").select("id", urls.drop_params(query_text, ["gh_src", "ref"]).alias("kept"))


@query(f"WITH u AS (SELECT id, {_U} AS u FROM jobs WHERE apply_url IS NOT NULL) SELECT id, lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*', 0)) || CASE WHEN regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '/' THEN '/' "
       "ELSE regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END || regexp_extract(u, '^[^?#]*(\\?[^#]+)', 1) AS canonical FROM u")  # fmt: skip
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").filter("apply_url is not null").select("id", urls.canonical_plain(F.col("apply_url")).alias("canonical"))


@query()
def portal_canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Portal forms of URLs. SQL has no per-portal rules to say it by; the tests check examples and what the forms must keep."""
    u, t = F.col("apply_url"), F.col("portal_type")
    return table(spark, d, "jobs").filter("apply_url is not null").select("id", urls.portal_of(u, None, BOARDS).alias("portal"), urls.canonical_url(u, t, BOARDS).alias("canonical"), urls.job_id_of(u).alias("job_id"))


@query("SELECT id, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS domain, string_split(h, '.')[-2] AS label FROM (SELECT id, lower(regexp_extract(normalized_url, '^https?://([^/?#]+)', 1)) AS h FROM source_registry)")
def registry_domains(spark: SparkSession, d: str) -> DataFrame:
    host = urls.url_parts(F.col("normalized_url"))["host"]
    return table(spark, d, "source_registry").select("id", urls.registrable_domain(host).alias("domain"), urls.domain_label(host).alias("label"))


_WORDS = ("trim(regexp_replace(regexp_replace(replace(lower(company), '&', ' and '), '[''’\"]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))")


@query(f"WITH w AS (SELECT id, regexp_replace(regexp_replace({_WORDS}, '^the(\\s+|$)', ''), '((^|\\s+)(ag|bv|co|company|corp|corporation|gmbh|inc|incorporated|limited|llc|llp|lp|ltd|oy|plc|pte|pty|sa))+$', '') AS w FROM source_registry WHERE company IS NOT NULL) "
       "SELECT id, w AS words, nullif(replace(w, ' ', ''), '') AS key FROM w")  # fmt: skip
def company_words(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("company")
    return table(spark, d, "source_registry").filter("company is not null").select("id", F.array_join(text.company_tokens(c), " ").alias("words"), text.company_key(c).alias("key"))


@query(f"WITH w AS (SELECT id, regexp_replace(regexp_replace({_WORDS}, '^the(\\s+|$)', ''), '((^|\\s+)(ag|bv|co|company|corp|corporation|gmbh|inc|incorporated|limited|llc|llp|lp|ltd|oy|plc|pte|pty|sa))+$', '') AS w FROM source_registry WHERE company IS NOT NULL), "
       "s AS (SELECT id, list_filter([replace(w, ' ', ''), CASE WHEN contains(w, ' ') THEN replace(w, ' ', '-') END, CASE WHEN contains(w, ' ') THEN split_part(w, ' ', 1) END], lambda x: x IS NOT NULL AND x <> '') AS s FROM w) "
       "SELECT id, unnest(s) AS slug, unnest(range(1, len(s) + 1)) AS position FROM s")  # fmt: skip
def slug_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_registry").filter("company is not null")
    slugs = rows.select("id", F.posexplode(text.slug_candidates(F.col("company"), F.lit(None).cast("string"))).alias("p", "slug"))
    return slugs.select("id", "slug", (F.col("p") + 1).cast("long").alias("position"))


_SIGNAL = {n: p for n, p in html.SIGNALS.items()}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in _SIGNAL.items()) + "], lambda x: x IS NOT NULL), ',') AS signals FROM documents WHERE text IS NOT NULL")
def text_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(html.page_signals(F.col("text")), ",").alias("signals"))


@query("SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)https?://[^\\s\"''<>]+'), lambda u: regexp_replace(regexp_replace(u, '[),.;]+$', ''), '#.*$', '')))) AS url FROM documents WHERE text IS NOT NULL")
def urls_in_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.explode(html.urls_in(F.col("text"))).alias("url"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT id, CASE WHEN json_valid(raw_json) THEN json_extract_string(raw_json, '$.description') END AS description, coalesce(json_valid(raw_json), false) AS readable FROM jobs")
def raw_descriptions(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("raw_json")
    return table(spark, d, "jobs").select("id", F.try_variant_get(v, "$.description", "string").alias("description"), v.isNotNull().alias("readable"))


@query(f"SELECT id, CAST(epoch({_TS.format('created_at')}) AS BIGINT) AS seconds FROM application_tracking")
def log_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "application_tracking").select("id", times.freshness(F.lit(None).cast("string"), F.col("created_at")).alias("seconds"))


@query("SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
       "JOIN customer ON o_custkey = c_custkey GROUP BY 1")  # fmt: skip
def segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("segment").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))
