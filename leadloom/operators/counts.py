"""Counts: totals with absent classes, pivots, conditional counters, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import company_tokens


def totals_with_zeros(df: DataFrame, key: str, classes: Sequence[str], amount: Column) -> DataFrame:
    """position, key, rows, total for every class in its fixed order, also for those without rows."""
    dim = df.sparkSession.createDataFrame(list(enumerate(classes)), f"position int, {key} string")
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    return F.broadcast(dim).join(sums, key, "left").select("position", key, F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("s", F.lit(0)).alias("total"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A count per value of ``column``; the values are given, so no pass finds them."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def rate(part: Column, whole: Column) -> Column:
    """Percent to one decimal; 0 on empty."""
    return F.coalesce(F.round(F.try_divide(part * 100, whole), 1), F.lit(0.0))


def name_verdicts(df: DataFrame, name: str, known: str) -> DataFrame:
    """``df`` with ``verdict`` (missing, exact, overlap or mismatch) of a company's name against the known one, and ``shared``: how many words they share."""
    a, b = company_tokens(F.col(name)), company_tokens(F.col(known))
    shared = F.size(F.array_intersect(a, b))
    verdict = F.when(F.coalesce(F.size(b), F.lit(0)) <= 0, "missing").when(F.array_join(a, "") == F.array_join(b, ""), "exact").when(F.arrays_overlap(a, b), "overlap").otherwise("mismatch")
    return df.withColumn("verdict", verdict).withColumn("shared", F.coalesce(shared, F.lit(0)))
