"""Duplicate lookups by prioritised keys and winners of duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(incoming: DataFrame, existing: DataFrame, id_col: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """``incoming`` with the least id of ``existing`` that agrees under the first rule that finds one, and that rule's name.

    A rule is a name and columns; rows with a null in any of them match nothing under it.
    """
    out = incoming
    for name, columns in rules:
        known = existing
        for c in columns:
            known = known.filter(F.col(c).isNotNull())
        known = known.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.min(id_col).alias(f"_id_{name}"))
        on = F.lit(True)
        for c in columns:
            on = on & (F.col(c) == F.col(f"_{c}"))
        out = out.join(known, on, "left").drop(*[f"_{c}" for c in columns])
    ids = [F.col(f"_id_{name}") for name, _ in rules]
    rule = F.coalesce(*[F.when(i.isNotNull(), F.lit(name)) for i, (name, _) in zip(ids, rules, strict=True)])
    return out.withColumn("match_id", F.coalesce(*ids)).withColumn("match_rule", rule).drop(*[f"_id_{name}" for name, _ in rules])


def group_winners(df: DataFrame, group: str, id_col: str, order: list[Column]) -> DataFrame:
    """One row per group of two or more: group, winner, losers (count). ``order``: larger is better, then the least id; an aggregate, so a hot group is no single task's window."""
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (-F.col(id_col)).alias("neg"))
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(id_col, best).alias("winner"), (F.count("*") - 1).alias("losers")).filter("losers > 0")


def exact_or_canonical(jobs: DataFrame, wanted: DataFrame, id_col: str, url: str, canonical: str) -> DataFrame:
    """wanted, id, match: rows that have a wanted URL, as it is or in canonical form; a row that has both counts as exact."""
    a = wanted.join(jobs, F.col("wanted") == F.col(url)).select("wanted", F.col(id_col).alias("id"), F.lit("exact").alias("match"))
    b = wanted.join(jobs, F.col("wanted") == F.col(canonical)).select("wanted", F.col(id_col).alias("id"), F.lit("canonical").alias("match"))
    return a.unionByName(b).groupBy("wanted", "id").agg(F.max("match").alias("match"))


def collapse_by_key(df: DataFrame, key: Column, order: str, value: str) -> DataFrame:
    """key, first, values (ordered by ``order``), duplicates."""
    return df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v")).select(
        "key", F.get("v", F.lit(0))[value].alias("first"), F.transform("v", lambda x: x[value]).alias("values"), (F.size("v") - 1).alias("duplicates")
    )


def only_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and its value if it has exactly one distinct non-null value, else null."""
    return df.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def by_reference(jobs: DataFrame, reference: str, url: str = "apply_url", canonical: str = "canonical_apply_url") -> DataFrame:
    """Rows a text refers to: digits are an id, an absolute URL is one of the two URLs; anything else raises."""
    text = reference.strip()
    if text.isdecimal():
        return jobs.filter(F.col("id") == int(text))
    if "://" not in text:
        raise ValueError("a reference has to be a number or an absolute URL")
    return jobs.filter((F.col(url) == text) | (F.col(canonical) == text))
