"""Sinks. Spark's committer makes a write atomic; a new version is a new folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, nulls empty, arrays as texts with ``; `` between."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).write.mode("errorifexists").text(path)


def write_version(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """A table's new snapshot beside its old ones; returns its path."""
    out = f"{root}/version={version}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(out)
    return out


def append_once(log: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Records of ``new`` whose key the log lacks, the first of each key in order; ``refused``: whether others of its key were not taken."""
    columns = [c for c in new.columns if c not in keys]
    fresh = new.join(log.select(*keys).distinct(), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r"), (F.count("*") > 1).alias("refused"))
    return first.select(*keys, "r.*", "refused")
