"""Scans with optional predicates, ranks, limits, launch order, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import clean_text, matches_terms, search_text


def scan(df: DataFrame, status: str | None = None, batch: str | None = None, query: str | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a status and batch whose text has all terms; a predicate that is not asked for is left out of the plan."""
    out = df
    if status is not None:
        out = out.filter(F.col("status") == status)
    if batch is not None:
        out = out.filter(F.col("ingest_batch_id") == batch)
    if query:
        out = out.filter(matches_terms(search_text(*[F.col(c) for c in text_columns]), query))
    return out


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order with ``rank`` from 1. The limit comes first (a top-k per task), so the global window sees ``limit`` rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with ``position``; Spark cuts groups before the shuffle."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= k)


def applied_and_deferred(df: DataFrame, limit: int) -> DataFrame:
    """selected, deferred: how many rows a limit takes and leaves."""
    n = F.count("*")
    return df.agg(F.least(n, F.lit(limit)).alias("selected"), F.greatest(n - limit, F.lit(0)).alias("deferred"))


def launch_order(items: DataFrame, session: str, index: str, url: str) -> DataFrame:
    """``launchable`` and ``launch_position``: running number over the items with a URL; null for the others."""
    ok = clean_text(F.col(url)).isNotNull()
    w = Window.partitionBy(session).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("launchable", ok).withColumn("launch_position", F.when(ok, F.sum(ok.cast("long")).over(w)))


def manifest(items: DataFrame, session: str, created_at: Column, fields: list[str]) -> DataFrame:
    """One row per session: its header and its items in order of ``item_index``; sessions are bounded by the limit they were selected with."""
    each = F.struct("item_index", *fields)
    return items.groupBy(session).agg(F.count("*").alias("item_count"), F.array_sort(F.collect_list(each)).alias("items")).withColumn("created_at", created_at)


def manifest_items(manifests: DataFrame, session: str) -> DataFrame:
    """Items of manifests with their 1-based index."""
    return manifests.select(session, F.posexplode("items").alias("pos", "item")).select(session, (F.col("pos") + 1).alias("manifest_index"), "item.*")


def reranked(ranked_rows: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """A ranked list in a new order: rows with each hit first, then the rank before, kept as ``prior_rank``. The list is as short as the limit it was ranked with."""
    order = [*[F.coalesce(c, F.lit(False)).desc() for c in hits.values()], F.col("prior_rank").asc()]
    rows = ranked_rows.withColumnRenamed("rank", "prior_rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task that holds them all.

    A range sort spreads the rows; each task numbers its own and adds the rows of the tasks
    before it, which is one small row per task. The sort is cut by a checkpoint, so both
    passes see the same tasks.
    """
    from leadloom.runtime import durable

    rows = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn(name, within + F.col("_before") + 1).drop("_at", "_task", "_before")


def marked(requests: DataFrame, session: str, items: DataFrame) -> DataFrame:
    """Requests for items of manifests (session id, seq, session, item_index) with ``job_id``, or ``reason`` if they are repeated or out of range. ``items``: session, item_index, id."""
    first = requests.groupBy(session, "item_index").agg(F.min("seq").alias("_first"))
    known = items.select("session", "item_index", F.col("id").alias("_id"))
    j = requests.join(first, [session, "item_index"]).join(known, ["session", "item_index"], "left")
    again = F.col("seq") > F.col("_first")
    reason = F.when(again, "duplicate manifest index ignored").when(F.col("_id").isNull(), "manifest index is out of range")
    return j.select(session, "seq", reason.alias("reason"), F.when(~again, F.col("_id")).alias("job_id"))


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; those a table lacks are null texts."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])
