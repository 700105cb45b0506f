"""Readers of the reference's input files; broken records become rows with an error, never failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import clean_text, one_line
from leadloom.functions.times import is_strict_iso
from leadloom.functions.urls import company_domain

REQUIRED = ("source", "company", "title", "location")
OPTIONAL = ("apply_url", "source_job_id", "portal_type", "salary_text", "posted_at", "found_at")


def lead_records(spark: SparkSession, path: str) -> DataFrame:
    """Lead JSON files (each an array or one object, read whole): record_number, the fields, raw_json, error."""
    return lead_rows(spark.read.text(path, wholetext=True))


def lead_rows(texts: DataFrame) -> DataFrame:
    """The records of lead JSON ``texts`` (value), each an array or one object."""
    whole = texts.withColumn("v", F.try_parse_json("value"))
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    items = F.when(is_array, F.expr("try_cast(v as array<variant>)")).otherwise(F.array("v"))
    each = whole.select(F.posexplode_outer(F.when(F.col("v").isNotNull(), items)).alias("pos", "r"))

    def field(name: str) -> Column:
        value = F.try_variant_get("r", f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get("r", f"$.{name}", "variant"))
        text = F.when(kind == "STRING", value)
        return (F.lower(one_line(text)) if name == "portal_type" else one_line(text) if name in (*REQUIRED, "salary_text") else clean_text(text)).alias(name)

    out = each.select((F.col("pos") + 1).alias("record_number"), F.to_json("r").alias("raw_json"), F.schema_of_variant("r").startswith("OBJECT").alias("_object"), *[field(f) for f in (*REQUIRED, *OPTIONAL)])
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    error = F.when(F.col("record_number").isNull(), "no records").when(~F.col("_object"), "record is no object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return out.withColumn("error", error).drop("_object")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without blanks and ``#`` comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def company_lines(df: DataFrame) -> DataFrame:
    """``name | domain | notes`` lines, or a bare name or domain: company, domain, notes."""
    parts = F.split("line", r"\|")
    bare = F.size(parts) == 1
    is_domain = F.col("line").rlike(r"^(?:https?://)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/\S*)?$")
    notes = F.array_join(F.filter(F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x)), lambda x: x != ""), " | ")
    return df.select(
        one_line(F.when(~bare | ~is_domain, F.get(parts, F.lit(0)))).alias("company"),
        company_domain(F.when(bare & is_domain, F.col("line")).when(~bare, F.get(parts, F.lit(1)))).alias("domain"),
        F.nullif(F.when(~bare, notes), F.lit("")).alias("notes"),
    )


def registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Registry JSON: an array of texts or of objects with ``source_url`` or ``url``: source_url, company."""
    return registry_rows(spark.read.text(path, wholetext=True))


def registry_rows(texts: DataFrame) -> DataFrame:
    """The entries of registry JSON ``texts`` (value)."""
    v = texts.select(F.explode(F.expr("try_cast(try_parse_json(value) as array<variant>)")).alias("r"))
    text = F.when(F.schema_of_variant("r") == "STRING", F.expr("try_cast(r as string)"))
    url = F.coalesce(text, F.try_variant_get("r", "$.source_url", "string"), F.try_variant_get("r", "$.url", "string"))
    return v.select(clean_text(url).alias("source_url"), clean_text(F.try_variant_get("r", "$.company", "string")).alias("company")).filter("source_url is not null")


MANIFEST = "created_at string, label string, item_count int, items array<struct<rank: int, job_id: bigint, company: string, title: string, apply_url: string>>"


def manifests(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Manifest JSON files with ``problem``: why a manifest is not valid, or null."""
    df = spark.read.schema(MANIFEST).option("multiLine", not one_per_line).json(path)
    iso = is_strict_iso(F.col("created_at"))
    return df.withColumn("problem", F.when(~iso, "created_at is no ISO timestamp").when(F.col("item_count") != F.size("items"), "item_count differs from items").when(F.col("items").isNull(), "items missing"))


def columns_of(df: DataFrame) -> DataFrame:
    """name of each column of a table."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
