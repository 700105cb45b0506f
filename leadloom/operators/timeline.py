"""Append-only logs to current state: latest entries, audits of transitions, timelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, key: str, value: str, order: list[Column], where: Column | None = None, out: str = "latest") -> DataFrame:
    """key and the value of its last entry; an aggregate with partial results, no window."""
    rows = log if where is None else log.filter(where)
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(out))


def flag_exists(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str) -> DataFrame:
    """``left`` with a boolean: whether ``right`` has its key."""
    keys = right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return left.join(keys, left[left_key] == keys["_k"], "left").withColumn(out, F.col("_hit").isNotNull()).drop("_k", "_hit")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key names no row of ``parent``; a null key names none."""
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.join(keys, child[child_key] == keys["_k"], "left_anti")


def transitions(log: DataFrame, key: str, status: str, order: list[Column], allowed: Iterable[tuple[str, str]]) -> DataFrame:
    """Each entry with the status before it and whether that step is allowed; first entries and repeats are."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = log.sparkSession.createDataFrame(sorted(set(allowed)), "before string, after string").withColumn("listed", F.lit(True))
    stepped = log.withColumn("previous", F.lag(status).over(w))
    joined = stepped.join(F.broadcast(pairs), (F.col("previous") == F.col("before")) & (F.col(status) == F.col("after")), "left")
    ok = F.col("previous").isNull() | (F.col("previous") == F.col(status)) | F.col("listed").isNotNull()
    return joined.withColumn("allowed", ok).drop("before", "after", "listed")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``kept``: whether a row is the first of its null-safe key; later rows are duplicates."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
