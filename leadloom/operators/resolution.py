"""Duplicate groups to one kept row, status changes with reasons, imports against what is stored.

Orders of statuses, allowed steps and scores are parameters; the reference's own tables are
given as fixed values. Everything is an aggregate or a join on a key, so a group that
holds a third of all rows is no single task's window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import clean_text

#: Statuses of a job, first those that say most; the last stands for a replaced row.
PRIORITY = ("offer", "rejected", "interview", "assessment", "recruiter_screen", "applied", "skipped", "opened", "new", "invalid_location", "superseded")
#: Statuses of a row that was applied for.
APPLIED_LIKE = ("applied", "recruiter_screen", "assessment", "interview", "offer", "rejected")
#: Steps a status may take.
_LATE = ("recruiter_screen", "assessment", "interview", "offer", "rejected", "superseded")
STEPS = {
    "new": ("opened", "applied", "skipped", "invalid_location", *_LATE), "opened": ("applied", "skipped", "invalid_location", *_LATE), "applied": _LATE,
    "recruiter_screen": _LATE[1:], "assessment": _LATE[2:], "interview": _LATE[3:], "offer": ("superseded",), "rejected": ("superseded",),
    "skipped": ("opened", "applied", "invalid_location", "superseded"), "invalid_location": ("opened", "skipped", "superseded"),
    "superseded": ("invalid_location", "opened", "applied", "skipped", *_LATE[:-1]),
}


def known_status(c: Column, known: Sequence[str] = PRIORITY) -> Column:
    """Trimmed status in small letters; null, blank and unknown ones are ``new``."""
    status = F.lower(clean_text(c))
    return F.when(status.isin(*known), status).otherwise("new")


def place_in(c: Column, order: Sequence[str]) -> Column:
    """Larger is better: how far a value stands from the end of an order; others are null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, len(order) - i)]), c)


def resolved_status(status: Column, logged: Column, applied: Column) -> Column:
    """The status a row has in its group: a replaced row has its last other logged one, and new or opened rows that were applied for are applied."""
    now = known_status(status)
    base = F.when(now == "superseded", known_status(logged)).otherwise(now)
    return F.when(applied & base.isin("new", "opened"), "applied").otherwise(base)


def group_plan(rows: DataFrame, group: str, id_col: str, status: Column, resolved: Column, quality: Sequence[Column]) -> DataFrame:
    """One row per group of two or more: group, rows, winner, winner_status, superseded, reactivated and changed (ordered ids).

    The winner is an applied row if there is one, then has the best status, the best
    ``quality`` (larger is better) and the least id. The winner takes its resolved status,
    the others are superseded. ``changed`` lists rows whose status differs from that; the
    lists are as long as the group, as the result asks for.
    """
    r = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), known_status(status).alias("now"), resolved.alias("to"), F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)]).alias("q"))
    best = F.struct((F.col("to") == "applied").alias("applied"), place_in(F.col("to"), PRIORITY).alias("p"), "q", (-F.col("id")).alias("neg"))
    # Ids of the group by what would change if they win or lose; the winner is known once the group is complete.
    out = r.groupBy("g").agg(F.count("*").alias("rows"), F.max_by(F.struct("id", "now", "to"), best).alias("w"), F.array_sort(F.collect_list(F.struct("id", (F.col("now") != "superseded").alias("moves")))).alias("ids")).filter("rows > 1")
    others = F.filter("ids", lambda x: x["id"] != F.col("w.id"))
    moved = F.transform(F.filter("ids", lambda x: F.when(x["id"] == F.col("w.id"), F.col("w.now") != F.col("w.to")).otherwise(x["moves"])), lambda x: x["id"])
    back = F.when((F.col("w.now") != F.col("w.to")) & (F.col("w.to") != "superseded"), F.array("w.id")).otherwise(F.array().cast("array<bigint>"))
    return out.select(F.col("g").alias(group), "rows", F.col("w.id").alias("winner"), F.col("w.to").alias("winner_status"), F.transform(others, lambda x: x["id"]).alias("superseded"), back.alias("reactivated"), moved.alias("changed"))


def preferred_rows(rows: DataFrame, group: str, id_col: str, status: Column, quality: Sequence[Column]) -> DataFrame:
    """group and the row to show for it: one applied for or later, else an opened one, else any; then by quality and the least id."""
    s = F.lower(F.trim(status))
    bucket = F.when(s.isin(*APPLIED_LIKE), 2).when(s == "opened", 1).otherwise(0)
    order = F.struct(bucket.alias("b"), *[q.alias(f"q{i}") for i, q in enumerate(quality)], (-F.col(id_col)).alias("neg"))
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(id_col, order).alias("preferred"))


def reconciled_status(status: Column, latest: Column, applied: Column) -> Column:
    """Status after a merge: the latest logged one (replaced rows too), else applied if there is such an application."""
    now = F.coalesce(F.lower(clean_text(status)), F.lit("new"))
    return F.coalesce(F.lower(clean_text(latest)), F.when(applied & now.isin("new", "opened"), "applied").otherwise(now))


def change_statuses(requests: DataFrame, jobs: DataFrame, to: str, steps: dict[str, Iterable[str]] = STEPS) -> DataFrame:
    """seq, id, reason: why a requested change is passed over, or null if it is made.

    ``requests``: seq, id. ``jobs``: id, status. A repeated request, an unknown id, a row
    that has the status already and a step that isn't allowed are passed over, in that order.
    """
    first = requests.groupBy("id").agg(F.min("seq").alias("first"))
    known = jobs.select(F.col("id").alias("_id"), F.col("status").alias("_now"))
    j = requests.join(first, "id").join(known, F.col("id") == F.col("_id"), "left")
    may = sorted(s for s, targets in steps.items() if to in set(targets))
    now = F.lower(F.trim("_now"))
    reason = (
        F.when(F.col("seq") > F.col("first"), "duplicate target ignored").when(F.col("_id").isNull(), "job id was not found").when(F.col("_now") == to, f"already {to}")
        .when(~now.isin(*steps), "unsupported current status").when(~now.isin(*may) & (now != to), F.concat(F.lit("cannot move from "), now, F.lit(f" to {to}")))
    )
    return j.select("seq", "id", reason.alias("reason"))


def import_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """seq, outcome, match_id, match_rule: what an import does with each record.

    ``incoming``: seq and the columns apply_url, canonical, identity, source_job_id;
    ``stored``: id and apply_url, canonical, identity. A record with a canonical URL is
    inserted and its group resolved afterwards. One without is a duplicate if a stored row
    or an earlier record that no stored row matches has its URL, or its identity key where
    it has no URL or brings a job id; the stored row with the least id is named, none for
    records of the import itself.
    """
    gate = F.col("apply_url").isNull() | F.col("source_job_id").isNotNull()
    loose = incoming.filter(F.col("canonical").isNull()).withColumn("key", F.when(gate, F.col("identity")))
    by_url = stored.filter("apply_url is not null").groupBy("apply_url").agg(F.min("id").alias("url_id"))
    by_key = stored.filter("identity is not null").groupBy(F.col("identity").alias("key")).agg(F.min("id").alias("key_id"))
    j = loose.join(by_url, "apply_url", "left").join(by_key, "key", "left")
    # Records of the import itself: those that go in for sure, and those nothing stored matches.
    sure = incoming.filter(F.col("canonical").isNotNull())
    kept = sure.select("seq", "apply_url", "identity").unionByName(j.filter("url_id is null and key_id is null").select("seq", "apply_url", "identity"))
    first_url = kept.filter("apply_url is not null").groupBy("apply_url").agg(F.min("seq").alias("url_seq"))
    first_key = kept.filter("identity is not null").groupBy(F.col("identity").alias("key")).agg(F.min("seq").alias("key_seq"))
    j = j.join(first_url, "apply_url", "left").join(first_key, "key", "left")
    rule = (
        F.when(F.col("url_id").isNotNull(), "exact apply_url match").when(F.col("key_id").isNotNull(), "identity key match")
        .when(F.col("url_seq") < F.col("seq"), "exact apply_url match").when(F.col("key_seq") < F.col("seq"), "identity key match")
    )
    loose = j.select("seq", F.when(rule.isNull(), "inserted").otherwise("duplicate").alias("outcome"), F.coalesce("url_id", "key_id").alias("match_id"), rule.alias("match_rule"))
    sure = sure.select("seq", F.lit("inserted").alias("outcome"), F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("string").alias("match_rule"))
    return sure.unionByName(loose)


def newer_side(target: Column, source: Column, target_at: Column, source_at: Column) -> Column:
    """Value of the side verified last (the source on a tie), else the target's, else the source's."""
    pick = F.when(source_at.isNotNull() & (target_at.isNull() | (source_at >= target_at)), source).otherwise(target)
    return F.coalesce(pick, target, source)


def filled_status(target: Column, source: Column) -> Column:
    """The source's status only where the target is still new."""
    a, b = F.coalesce(F.lower(clean_text(target)), F.lit("new")), F.lower(clean_text(source))
    return F.when((a == "new") & b.isNotNull(), b).otherwise(a)


def clamped(limit: int, most: int) -> tuple[int, str | None]:
    """A limit and the warning if it was too large; below one raises."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return (limit, None) if limit <= most else (most, f"requested limit {limit} exceeds hard max {most}; clamped to {most}")


def migrate(target: DataFrame, source: DataFrame, key: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``source`` that ``target`` lacks by its key, with new ids above the target's, and the mapping old, new of all of them.

    An empty target takes the source's ids as they are. New ids follow the old ones: each
    is the target's largest id plus its own.
    """
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    have = target.groupBy(F.col(key).alias("_k")).agg(F.min(id_col).alias("_have"))
    j = source.join(have, F.col(key).eqNullSafe(F.col("_k")), "left").join(F.broadcast(top))
    j = j.withColumn("_new", F.coalesce("_have", F.col("_top") + F.col(id_col)))
    mapping = j.select(F.col(id_col).alias("old"), F.col("_new").alias("new"))
    added = j.filter("_have is null").select(*[F.col("_new").alias(id_col) if c == id_col else F.col(c) for c in source.columns])
    return added, mapping
