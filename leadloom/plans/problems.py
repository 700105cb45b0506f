"""Queries of the general data problems (p2, p3) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.moments import normalise_moments, utc_text
from leadloom.operators.quantities import physical, yearly_usd
from leadloom.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base pay of each job that states it, in whole US dollars per year."""
    pay = yearly_usd(table(spark, sf_dir, "jobs"), "id", "salary_text", table(spark, sf_dir, "pay_currencies"), table(spark, sf_dir, "pay_periods"))
    return pay.select(F.col("id").alias("job_id"), "usd_min", "usd_max")


def p2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts, written in four units of length and as lengths per hour, in metres and metres per second."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "in", "ft")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), F.lit(" "), unit, F.when(F.col("p_partkey") % 3 == 0, "/h").otherwise(""))
    q = table(spark, sf_dir, "part").select("p_partkey", physical(text).alias("q"))
    return q.select("p_partkey", F.round("q.value", 9).alias("value"), F.array_join(F.col("q.dims").cast("array<string>"), ",").alias("dims"))


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs")
    return normalise_moments(jobs, "id", ["posted_at", "found_at"], "import_source", "created_at", table(spark, sf_dir, "import_feeds"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of posted_at and found_at that name a moment and are not yet written as UTC."""
    m = _moments(spark, sf_dir).select(F.col("id").alias("job_id"), "field_name", "raw", utc_text(F.col("moment")).alias("utc_text"))
    return m.filter(F.col("utc_text") != F.col("raw")).drop("raw")


def p3_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose date order stays ambiguous, and counts of what could not be read."""
    m = _moments(spark, sf_dir)
    return m.groupBy("field_name").agg(
        F.count("*").alias("values_read"), F.count("moment").alias("moments"), F.count(F.when(F.col("ambiguous"), 1)).alias("ambiguous")
    )


QUERIES = {"p2_found": p2_found, "p2_units": p2_units, "p3_found": p3_found, "p3_unresolved": p3_unresolved}
SQL = {
    "p2_units": "SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 WHEN 2 THEN 0.0254 ELSE 0.3048 END / CASE WHEN p_partkey % 3 = 0 THEN 3600.0 ELSE 1.0 END, 9) AS value, "
    "CASE WHEN p_partkey % 3 = 0 THEN '0,-1,1,0,0' ELSE '0,0,1,0,0' END AS dims FROM part",
}
