"""Queries of the training-data problems over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import formatting, history, language, mapping, names, packing, tokens
from leadloom.llm.common import encode_fields, encode_join, field_entry
from leadloom.llm.survivors import STEP, Field, survivors
from leadloom.operators.moments import normalise_moments, utc_text
from leadloom.operators.quantities import stated_pay
from leadloom.runtime import bounded_rows, broadcast_if_small, durable, release, table

#: Statuses of a job, best first.
STATUS_ORDER = ("offer", "rejected", "interview", "assessment", "recruiter_screen", "applied", "skipped", "opened", "new", "invalid_location", "superseded")
#: Parameters: trust in a source of a row.
SOURCE_TRUST = {"greenhouse": 1.0, "lever": 1.0, "ashby": 1.0, "workday": 1.0, "company_site": 0.9, "referral": 0.6, "newsletter": 0.5, "manual": 0.5}
TOKENIZER = "byte_bpe_50k.json"


def _openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a canonical URL, with found_at as a moment, the stated pay and the trust in the source."""
    jobs = table(spark, sf_dir, "jobs").filter(F.col("canonical_apply_url").isNotNull())
    found = normalise_moments(jobs, "id", ["found_at"], "import_source", "created_at", table(spark, sf_dir, "import_feeds")).select("id", "moment")
    trust = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TRUST.items() for x in kv]), F.col("source")), F.lit(0.3))
    rows = jobs.select("id", "canonical_apply_url", "status", "salary_text", trust.alias("trust"), stated_pay(F.col("salary_text")).isNotNull().alias("pay"))
    return rows.join(found, "id")


def _fields(ordered: bool) -> list[Field]:
    """The three fields; ``ordered``: the stated order of statuses, and the later moment, as priors in steps no votes outweigh."""
    micros = F.unix_micros(F.col("moment").cast("timestamp"))
    at = micros / F.lit(1e6)
    status = F.lower(F.regexp_replace("status", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    places = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, STEP * (len(STATUS_ORDER) - i))])
    later = micros.cast("decimal(20,0)") * STEP
    return [
        Field("status", status, F.coalesce(F.try_element_at(places, status), F.lit(0)) if ordered else None, at),
        Field("found_at", F.col("moment").cast("string") if ordered else utc_text(F.col("moment")), later if ordered else None, at),
        Field("salary_text", F.when(F.col("pay"), F.col("salary_text")), later if ordered else None, at),
    ]


def _survivors(spark: SparkSession, sf_dir: str, ordered: bool) -> DataFrame:
    return survivors(_openings(spark, sf_dir), "canonical_apply_url", "id", _fields(ordered), F.col("trust"), F.col("moment"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survivors(spark, sf_dir, True)
    return s.select(
        "canonical_apply_url", F.col("status_id").alias("status_job_id"), F.col("found_at_id").alias("found_job_id"), F.coalesce("salary_text_id", F.lit(0)).cast("long").alias("salary_job_id")
    )


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per opening by votes alone: source trust times a half-life of 90 days."""
    return _survivors(spark, sf_dir, False)


def _organisations(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spellings of jobs (id, name, tenant), of the registry (the same), and their attribution."""
    jobs = table(spark, sf_dir, "jobs").select("id", "company", "source_job_id", "apply_url", *keep)
    typed = durable(names.with_tenants(jobs, "company", "source_job_id", "apply_url", keep))
    registry = table(spark, sf_dir, "source_registry").select("id", F.coalesce("company", "label").alias("name"), names.tenant(F.col("normalized_url")).alias("tenant"))
    seen = typed.select("name", "tenant").unionByName(registry.select("name", "tenant")).groupBy("name", "tenant").agg(F.count("*").alias("n"))
    return typed, registry, names.attribute(seen)


def _with_org(rows: DataFrame, attributed: DataFrame) -> DataFrame:
    """Rows (id, name, tenant) with org and posterior; joined on one key that is never null, so that no hot null is shuffled."""
    key = F.concat_ws("\u0001", F.coalesce("name", F.lit("\u0000")), F.coalesce("tenant", F.lit("\u0000"))).alias("pair")
    keyed = rows.select("*", key)
    counts = keyed.groupBy("pair").agg(F.count("*").alias("n"))
    dictionary = durable(attributed.select(key, "org", "posterior").join(counts, "pair"))
    return encode_join(keyed, "pair", dictionary, "n", rows.count()).drop("pair")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, registry, attributed = _organisations(spark, sf_dir)
    by_hand = table(spark, sf_dir, "jobs").filter("source_registry_id is null").select("id")
    jobs = _with_org(typed.drop("req").join(by_hand, "id", "left_semi"), attributed).filter(F.col("posterior") >= names.MIN_POSTERIOR)
    listed = table(spark, sf_dir, "source_registry").filter("company is not null").select("id", "company")
    owners = _with_org(registry, attributed).select("id", "org").join(listed, "id").select(F.col("id").alias("registry_id"), "company", "org")
    owners = broadcast_if_small(owners, 100_000)
    return jobs.join(owners, "org").filter(F.col("name") != F.col("company")).select(F.col("id").alias("job_id"), "registry_id")


def _field_values(rows: DataFrame, field: str, ref: DataFrame, name: str) -> DataFrame:
    """value, n: distinct values of a field to map: not null, not blank, no entry's exact name."""
    usable = rows.filter(F.col(field).isNotNull() & F.col(field).rlike(r"[^\s\u00a0\u2000-\u200b\u202f\u3000]"))
    values = usable.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return values.join(ref.select(F.col(name).alias("value")).distinct(), "value", "left_anti")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("id", "location", "title")
    places, titles = table(spark, sf_dir, "ref_locations"), table(spark, sf_dir, "ref_titles")
    total = jobs.count()
    out = []
    for field, ref, name in (("location", places, "location_name"), ("title", titles, "title_name")):
        values = _field_values(jobs, field, ref, name)
        if field == "location":
            mapped = mapping.map_locations(spark, values.select("value"), places).select("value", "ref_ids")
        else:
            mapped = mapping.map_titles(spark, values.select("value"), titles).select("value", F.array("ref_id").alias("ref_ids"))
        mapped = durable(values.join(mapped, "value", "left").withColumn("ref_ids", F.when(F.size("ref_ids") > 0, F.col("ref_ids")).otherwise(F.array(F.lit(0)))))
        rows = encode_join(jobs.select("id", F.col(field).alias("value")).filter("value is not null"), "value", mapped, "n", total)
        out.append(rows.select(F.col("id").alias("job_id"), F.lit(field).alias("field_name"), F.explode("ref_ids").alias("ref_id")))
    return out[0].unionByName(out[1])


def _signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every job (id, batch (empty for null), req, code of its organisation, title with team, and location), and the tokens of each code.

    Codes are the integers of distinct token lists, so rows stay small: only the codes
    meet the rows, the tokens meet the distinct combinations later.
    """
    typed, _, attributed = _organisations(spark, sf_dir, ("title", "location", "ingest_batch_id"))
    jobs = typed.withColumn("batch", F.coalesce("ingest_batch_id", F.lit("")))
    total = jobs.count()
    release(spark)
    pair = F.concat_ws("\u0001", F.coalesce("name", F.lit("\u0000")), F.coalesce("tenant", F.lit("\u0000")))
    rows = jobs.select("id", "req", pair.alias("pair"), "batch", "title", "location")
    orgs = attributed.select(pair.alias("value"), F.array(F.concat(F.lit("o:"), F.coalesce("org", F.lit("")))).alias("tokens"))
    orgs = orgs.join(rows.groupBy(F.col("pair").alias("value")).agg(F.count("*").alias("n")), "value")

    titles = jobs.filter("title is not null").groupBy(F.col("title").alias("value")).agg(F.count("*").alias("n"))
    mapped = durable(mapping.map_titles(spark, titles.select("value"), table(spark, sf_dir, "ref_titles")).join(titles, "value"))
    rare = mapping.settle_spellings(mapped.select("n", F.explode("extra").alias("word")))
    each = mapped.select("value", "n", F.explode("tokens").alias("word")).filter(~F.col("word").rlike(r"^\d+$")).join(rare, "word", "left")
    words = each.groupBy("value", "n").agg(F.array_sort(F.collect_set(F.concat(F.lit("t:"), F.coalesce("settled", "word")))).alias("tokens"))

    words = durable(words)
    release(spark)
    places = jobs.filter("location is not null").groupBy(F.col("location").alias("value")).agg(F.count("*").alias("n"))
    found = mapping.map_locations(spark, places.select("value"), table(spark, sf_dir, "ref_locations"))
    noise = F.array(*[F.lit(w) for w in sorted(set(mapping.PLACE_NOISE.split()) - {"remote", "city"})])
    known = F.array_sort(F.transform("ref_ids", lambda i: F.concat(F.lit("l:"), i)))
    other = F.array_sort(F.transform(F.array_except("tokens", noise), lambda w: F.concat(F.lit("l:"), w)))
    spots = found.join(places, "value").select("value", "n", F.when(F.size("ref_ids") > 0, known).otherwise(other).alias("tokens"))

    entries = [d.select(field_entry(i, F.col("value")).alias("entry"), "n", "tokens") for i, d in enumerate((orgs, words, spots))]
    entries = durable(entries[0].unionByName(entries[1]).unionByName(entries[2]).filter(F.size("tokens") > 0))
    codes = durable(entries.groupBy("tokens").agg(F.lit(1).alias("_")).select("tokens", F.monotonically_increasing_id().alias("code")))
    release(spark)
    dictionary = durable(entries.join(codes, "tokens").select("entry", "n", "code"))
    coded = encode_fields(rows, {"o": "pair", "t": "title", "l": "location"}, dictionary, total)
    return rows.select("id", "batch", "req").join(coded, "id"), codes


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.repeats(*_signatures(spark, sf_dir))
    return found.select(F.col("first_id").alias("first_job_id"), F.col("id").alias("job_id"))


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return formatting.collapse(table(spark, sf_dir, "jobs"), "id", ["company", "title", "location"], "apply_url")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[1].select(F.col("first_id").alias("first_job_id"), F.col("id").alias("job_id"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with a URL: its first job and its number of copies."""
    return _collapsed(spark, sf_dir)[0].select(F.col("first_id").alias("first_job_id"), "copies")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tokens.encode(F.col("text"), tokens.vocabulary(TOKENIZER)).alias("ids"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: number of ids and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokens.vocabulary(TOKENIZER)
    coded = docs.withColumn("ids", tokens.encode(F.col("text"), path))
    back = tokens.decode(F.col("ids"), path)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), (back == F.coalesce("text", F.lit(""))).alias("same"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, or its pieces, in containers of each size."""
    sizes = {r["container_id"]: r["capacity_tokens"] for r in bounded_rows(table(spark, sf_dir, "container_sizes"), 1000)}
    docs = table(spark, sf_dir, "documents")
    items = docs.filter(F.col("text") != "").select(F.col("doc_id").alias("id"), tokens.count_tokens(F.col("text"), tokens.vocabulary(TOKENIZER)).alias("size"))
    packed = packing.pack(items, sizes, docs.count())
    return packed.select("container_id", F.col("capacity").alias("capacity_tokens"), F.col("bin").alias("container"), F.col("id").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("size").alias("n_tokens"))


def p9_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each size, tokens in them, and the share of their space that is unused."""
    per = p9_containers(spark, sf_dir).groupBy("container_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n"))
    n = F.count("*")
    return per.groupBy("container_id", "capacity_tokens").agg(n.alias("containers"), F.sum("n").alias("tokens"), F.round(1 - F.sum("n") / (n * F.first("capacity_tokens")), 6).alias("unused"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return language.label_documents(docs)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label names no language or another one, and every block of mixed ones."""
    found = _languages(spark, sf_dir)
    named = F.col("lang") != language.UNKNOWN
    wrong = named & ~F.col("mixed") & (F.col("block_no") == 0) & ~F.col("code").eqNullSafe(F.col("lang"))
    block = F.col("mixed") & (F.col("block_no") > 0)
    return found.filter(wrong | block).select(F.col("id").alias("doc_id"), F.col("block_no").cast("int").alias("block_no"), "lang")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with sentences, and every block of a mixed one, with its language and confidence."""
    return _languages(spark, sf_dir).select(F.col("id").alias("doc_id"), "block_no", "lang", F.round("confidence", 4).alias("confidence"), "mixed")


QUERIES = {
    "p1_found": p1_found, "p1_survivors": p1_survivors, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_records": p7_records,
    "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_containers": p9_containers, "p9_unused": p9_unused, "p10_found": p10_found, "p10_languages": p10_languages,
}
SQL: dict[str, str] = {}
