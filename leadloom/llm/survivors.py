"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows. Each row votes for its normalised value with source
trust times recency decay; the votes of a value are summed per group, and ``max_by``
chooses the winner per field; the winners are pivoted back to one row per group. All three
steps are aggregates with partial results, so a group that holds a third of all rows only
sends one partial row per task and value.

Votes are compared by their logarithm, in bits. A field may say how much more credible one
of its values is than another before anybody votes (``prior``, whole bits): the score of a
value is its prior plus the logarithm of its votes. Votes lie between 2^-402 and 2^402
each, so ``STEP`` bits of prior outweigh any votes of up to 2^200 rows; priors given in
such steps put an order of values before the votes.

Defined results: rows with a null group key are left out; a field whose values are all
null or not eligible gives null value and null carrier; a row without a moment votes with
the least decay, one without trust with the least weight; equal scores go to the carrier
with the latest recency, then to the least id; repeated rows vote repeatedly; an empty
table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of prior no votes can outweigh.
STEP = 1024
#: Most half-lives before or after ``EPOCH`` that count; about a hundred years of the default.
MOST_HALF_LIVES = 400
#: Moment at which a vote weighs its trust. Only ratios of votes matter, so any fixed moment does.
EPOCH = "2025-01-01 00:00:00"


@dataclass(frozen=True)
class Field:
    """name; value: normalised value (null: no vote); prior: bits before the votes (of the value's rows the greatest counts); recency: which row carries the value, later is better."""

    name: str
    value: Column
    prior: Column | None = None
    recency: Column | None = None


def vote(trust: Column | None, moment: Column | None, half_life_days: float) -> Column:
    """Weight of a row: trust times a decay by half per half-life."""
    weight = F.greatest(F.coalesce(trust.cast("double"), F.lit(0.25)), F.lit(0.25)) if trust is not None else F.lit(1.0)
    if moment is None:
        return weight
    days = (F.unix_seconds(moment.cast("timestamp")) - F.unix_seconds(F.lit(EPOCH).cast("timestamp"))) / 86400.0
    halves = F.least(F.greatest(days / half_life_days, F.lit(-float(MOST_HALF_LIVES))), F.lit(float(MOST_HALF_LIVES)))
    return weight * F.pow(F.lit(2.0), F.coalesce(halves, F.lit(-float(MOST_HALF_LIVES))))


def survivors(
    df: DataFrame,
    group: str,
    id_col: str,
    fields: Sequence[Field],
    trust: Column | None = None,
    moment: Column | None = None,
    half_life_days: float = 90.0,
    min_rows: int = 2,
) -> DataFrame:
    """One row per group of at least ``min_rows`` rows: group, rows, and per field f its ``f``, ``f_id`` and ``f_score`` (bits)."""
    null = F.lit(None).cast("double")
    votes = F.array(*[
        F.struct(
            F.lit(f.name).alias("field"), f.value.cast("string").alias("value"), (f.prior if f.prior is not None else F.lit(0)).cast("decimal(26,0)").alias("prior"),
            (f.recency.cast("double") if f.recency is not None else null).alias("recency"),
        )
        for f in fields
    ])
    long = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), vote(trust, moment, half_life_days).alias("w"), F.explode(votes).alias("v"))
    long = long.select("g", "id", "w", "v.field", "v.value", F.coalesce("v.prior", F.lit(0).cast("decimal(26,0)")).alias("prior"), F.coalesce("v.recency", F.lit(float("-inf"))).alias("recency"))
    counts = long.groupBy("g", "field", "value").agg(
        (F.max("prior") + F.round(F.log2(F.sum("w")), 6).cast("decimal(12,6)")).alias("score"), F.max(F.struct("recency", (-F.col("id")).alias("neg"))).alias("carrier"), F.count("*").alias("n")
    )
    present = F.col("value").isNotNull()
    winner = counts.groupBy("g", "field").agg(
        F.max_by(F.when(present, F.struct("value", "score", (-F.col("carrier.neg")).alias("id"))), F.when(present, F.struct("score", "carrier"))).alias("w"), F.sum("n").alias("n")
    )
    wide = winner.groupBy("g").agg(
        F.max("n").alias("rows"), *[F.max(F.when(F.col("field") == f.name, F.col("w"))).alias(f"_{f.name}") for f in fields]
    )
    out = [x for f in fields for x in (F.col(f"_{f.name}.value").alias(f.name), F.col(f"_{f.name}.id").alias(f"{f.name}_id"), F.col(f"_{f.name}.score").alias(f"{f.name}_score"))]
    return wide.filter(F.col("rows") >= min_rows).select(F.col("g").alias(group), "rows", *out)
