"""Snapshots: upsert classes, field-by-field merges, child remapping, backfills, change counts.

Tables are immutable: an upsert computes the new snapshot and the caller writes a new
version. Comparisons are null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_upsert(target: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome (created, updated, unchanged, untouched): what an upsert of ``incoming`` does to each key."""
    t = target.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"), F.lit(True).alias("_in_target"))
    s = incoming.select(F.col(key).alias("_k"), F.struct(*columns).alias("_new"), F.lit(True).alias("_in_source"))
    j = t.join(s, "_k", "full_outer")
    outcome = F.when(F.col("_in_target").isNull(), "created").when(F.col("_in_source").isNull(), "untouched").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return j.select(F.col("_k").alias(key), outcome.alias("outcome"))


def merge_snapshots(target: DataFrame, source: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Full outer merge by a unique key. Rules per column: fill (target, else source), min, max, source (source, else target)."""
    t = target.select(F.col(key).alias("_k"), *[F.col(c).alias(f"t_{c}") for c in rules])
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"s_{c}") for c in rules])
    j = t.join(s, "_k", "full_outer")

    def pick(c: str, rule: str) -> Column:
        a, b = F.col(f"t_{c}"), F.col(f"s_{c}")
        return {"fill": F.coalesce(a, b), "source": F.coalesce(b, a), "min": F.least(a, b), "max": F.greatest(a, b)}[rule].alias(c)

    return j.select(F.col("_k").alias(key), *[pick(c, r) for c, r in rules.items()])


def remap_children(children: DataFrame, parent_key: str, mapping: DataFrame, existing: DataFrame, natural: list[str]) -> DataFrame:
    """Children of a source moved to new parent ids, without those the target has by its natural key. ``mapping``: old, new."""
    moved = children.join(mapping, children[parent_key] == mapping["old"]).drop("old", parent_key).withColumnRenamed("new", parent_key)
    have = existing.select(*[F.col(c).alias(f"_{c}") for c in natural]).distinct()
    same = F.lit(True)
    for c in natural:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return moved.join(have, same, "left_anti")


def backfill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Fill nulls only; ``changed``: names of the columns that were filled, in order."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull() & v.isNotNull(), F.lit(c)) for c, v in values.items()]))
    return df.select(*[F.coalesce(F.col(c), values[c]).alias(c) if c in values else F.col(c) for c in df.columns], names.alias("changed"))


def change_counts(changed: DataFrame) -> DataFrame:
    """field, rows: how often each field was filled."""
    return changed.select(F.explode("changed").alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


def keep_where(target: DataFrame, incoming: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``incoming`` with the target's ``column`` where the target has ``value`` there."""
    kept = target.filter(F.col(column) == value).select(F.col(key).alias("_k"), F.col(column).alias("_kept"))
    j = incoming.join(kept, F.col(key) == F.col("_k"), "left")
    return j.select(*[F.coalesce("_kept", column).alias(c) if c == column else F.col(c) for c in incoming.columns])


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Nulls replaced by the default of their column, as an insert does."""
    return df.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in df.columns])
