"""New batches against everything accepted before.

:class:`PostingIndex` is an inverted index kept as a table: a posting is a token set with
the rarest tokens of it (its prefix), and the table is partitioned by token. A batch is
probed with its own prefixes only, so the history is never read whole: the buckets of
the batch's tokens are, and there are the more buckets the more tokens. Lengths are filtered, overlaps are verified on the whole sets, and
the batch's sets are appended.

The order of rarity is fixed when the index is made, from counts of the rows known then;
tokens that come later are rarer than all of those. So prefixes written by different
batches agree, whatever comes later. Equal sets are one posting, however many rows have
them, so a set that a third of all rows share is one row.

Defined results: rows with an empty set match nothing; null batches come before all
others (as the empty string); equal rows repeat each other only across batches; ties go to
the least id; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import EPSILON, encode_join
from leadloom.llm.names import _edits
from leadloom.runtime import durable, scratch_path


#: Tokens of postings are 64-bit hashes: a collision could only add a pair to those checked exactly afterwards.
POSTINGS = "key string, tokens array<bigint>, size int, token bigint, bucket int"


#: Tokens per bucket, and least and most buckets of an index.
TOKENS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 2_000, 16, 8_192


class PostingIndex:
    """Postings under ``path``: ``ranks`` (token, n), ``layout`` (the number of buckets) and ``postings`` by bucket of the token."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 1.0) -> None:
        self.spark, self.path, self.threshold = spark, path, threshold

    def create(self, counts: DataFrame) -> None:
        """Fix the order of rarity by ``counts`` (token, n), and the number of buckets by the number of tokens."""
        counts.groupBy("token").agg(F.sum("n").alias("n")).write.mode("errorifexists").parquet(f"{self.path}/ranks")
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, self.ranks().count() // TOKENS_PER_BUCKET))
        self.spark.createDataFrame([(buckets,)], "buckets int").write.mode("errorifexists").parquet(f"{self.path}/layout")

    def ranks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranks")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/layout").first()[0]

    def postings(self) -> DataFrame:
        """All postings; none if nothing was appended yet."""
        try:
            return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], POSTINGS)

    def _prefixes(self, sets: DataFrame) -> DataFrame:
        """set (key), tokens, size, token: one row per token of the prefix.

        ``sets`` may bring their tokens in order of rarity already, as ``ordered`` instead of ``tokens``.
        """
        keep = F.col("size") - F.ceil(F.col("size") * self.threshold - EPSILON).cast("int") + 1
        if "ordered" in sets.columns:
            ordered = sets.select("key", F.size("ordered").alias("size"), F.col("ordered").alias("o")).filter("size > 0")
        else:
            keyed = sets.withColumn("size", F.size("tokens")).filter("size > 0")
            each = keyed.select("key", "size", F.explode("tokens").alias("token")).join(self.ranks(), "token", "left")
            ordered = each.groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("o"))
            ordered = ordered.withColumn("o", F.transform("o", lambda x: x["token"]))
        coded = ordered.select("key", "size", F.transform("o", lambda w: F.xxhash64(w)).alias("tokens"))
        out = coded.select("key", "tokens", "size", F.explode(F.slice("tokens", F.lit(1), keep)).alias("token"))
        return out.withColumn("bucket", F.pmod("token", F.lit(self.buckets)).cast("int"))

    def append(self, sets: DataFrame) -> None:
        """Add distinct sets: key, tokens."""
        self._prefixes(sets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def probe(self, sets: DataFrame) -> DataFrame:
        """probe (key of ``sets``), key (of a posting), jaccard: every pair that reaches the threshold.

        Only the buckets of the sets' own prefixes are read; their numbers, at most
        ``MOST_BUCKETS``, are all that comes to the driver.
        """
        p = self._prefixes(sets).select(F.col("key").alias("probe"), F.col("tokens").alias("pt"), F.col("size").alias("ps"), "token", "bucket")
        touched = sorted(r[0] for r in p.select("bucket").distinct().collect())
        post = self.postings().filter(F.col("bucket").isin(touched))
        near = (F.col("size") >= F.col("ps") * self.threshold - EPSILON) & (F.col("ps") >= F.col("size") * self.threshold - EPSILON)
        pairs = p.join(post, ["bucket", "token"]).filter(near)
        shared = F.size(F.array_intersect("pt", "tokens"))
        scored = pairs.withColumn("jaccard", shared / (F.col("ps") + F.col("size") - shared)).filter(F.col("jaccard") >= self.threshold - EPSILON)
        return scored.select("probe", "key", "jaccard").distinct()


_CODES = ("o", "t", "l")
#: Jaccard value from which two sets are compared: of a title of two words beside its organisation and place, one may be misspelled.
LEAST_OVERLAP = 0.5
#: How much more frequent a word has to be than its misspelling, as in :func:`leadloom.llm.mapping.settle_spellings`.
RATIO = 8


def same_title(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether two titles (word to frequency) agree but for misspellings of words far more frequent: one edit or swap, two in words of six letters."""
    left, right = sorted(a.keys() - b.keys()), set(b.keys() - a.keys())
    if len(left) != len(right):
        return False

    def misspelled(x: str, y: str) -> bool:
        most = 2 if min(len(x), len(y)) >= 6 else 1
        return min(len(x), len(y)) >= 4 and max(a[x], b[y]) >= RATIO * min(a[x], b[y]) and not any(c.isdigit() for c in x + y) and _edits(x, y, most) <= most

    def paired(i: int, free: set[str]) -> bool:
        return i == len(left) or any(paired(i + 1, free - {y}) for y in sorted(free) if misspelled(left[i], y))

    return paired(0, right)


@F.pandas_udf(T.BooleanType())
def _same_title(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_title({w["token"]: w["n"] for w in x}, {w["token"]: w["n"] for w in y}) for x, y in zip(a, b, strict=True)], dtype=bool)


#: Steps in which the batches of a table that is checked as a whole go through the index.
STEPS = 3


def openings(rows: DataFrame, codes: DataFrame, index: PostingIndex, steps: int = STEPS) -> DataFrame:
    """id, batch, opening: the requisition; else the earliest requisition whose rows have the same set, or the nearest one's; else the earliest set without one that is the same.

    ``rows``: id, batch, req and the codes o, t, l of token lists; ``codes``: code, tokens.
    Sets are the same if organisation and place are equal and the titles are by
    :func:`same_title`. The tokens of the index are the words of the title, each with
    organisation and place, and those two by themselves, so postings stay short.

    The batches go through the index in order, in ``steps`` runs of consecutive ones: each
    run's new sets are appended and probe what is there, so later sets find the earlier
    ones and no pair is met twice over. The order of rarity is that of the first run; the
    result does not depend on the number of steps.
    """
    key = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _CODES])
    sets = rows.groupBy(*_CODES).agg(
        F.min(F.when(F.col("req").isNotNull(), F.struct("batch", "id", "req"))).alias("earliest"),
        F.min(F.when(F.col("req").isNull(), F.struct("batch", "id"))).alias("first"),
        F.count(F.when(F.col("req").isNull(), 1)).alias("without"),
        F.min("batch").alias("since"),
    )
    # A window over the distinct batches only.
    runs = rows.select(F.col("batch").alias("since")).distinct().withColumn("step", F.ntile(steps).over(Window.orderBy("since")))
    sets = durable(sets.filter(F.coalesce(*_CODES).isNotNull()).join(runs, "since"))
    used = sets.groupBy(F.col("t").alias("code")).agg(F.count("*").alias("n"), F.count_if(F.col("step") == 1).alias("known"))
    each = codes.select("code", F.explode("tokens").alias("token")).join(used, "code")
    counts = durable(each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("known").alias("known")))
    index.create(counts.filter("known > 0").select("token", F.col("known").alias("n")))
    words = each.select("code", "token").join(counts, "token").groupBy(F.col("code").alias("t")).agg(F.array_sort(F.collect_list(F.struct("known", "token", "n"))).alias("words"))
    none = F.expr("array()").cast("array<struct<known:bigint,token:string,n:bigint>>")
    block = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("o", "l")])
    sets = sets.withColumn("block", block).join(words, "t", "left").withColumn("words", F.coalesce("words", none))
    # Every token holds organisation and place: only blocks with a row that lacks a requisition can have a hit that matters.
    asked = sets.groupBy("block").agg(F.max("without").alias("most")).filter("most > 0").select("block", F.lit(True).alias("asked"))
    sets = durable(sets.join(asked, "block", "left").select(key.alias("key"), "step", "earliest", "first", "without", "words", "block", F.col("asked").isNotNull().alias("asked")))
    ordered = sets.select("key", "step", "asked", F.concat(F.transform("words", lambda w: F.concat("block", F.lit(":"), w["token"])), F.array("block")).alias("ordered"))
    hits = None
    for step in range(1, steps + 1):
        run = ordered.filter(F.col("step") == step)
        index.append(run.select("key", "ordered"))
        # Each run is read by itself: Spark takes two scans of one folder for the same, whatever was appended between.
        found = durable(index.probe(run.filter("asked").select("key", "ordered")))
        hits = found if hits is None else hits.unionByName(found)
    sets = sets.filter("asked")
    back = hits.select(F.col("key").alias("probe"), F.col("probe").alias("key"), "jaccard")
    hits = hits.unionByName(back).distinct()
    other = sets.select("key", "earliest", "first", "words", F.col("block").alias("other_block"))
    own = sets.filter("without > 0").select(F.col("key").alias("probe"), F.col("first").alias("own_first"), F.col("words").alias("own_words"), "block")
    pairs = hits.join(own, "probe").join(other, "key").filter(F.col("block") == F.col("other_block"))
    gaps = [F.size(F.array_except(*x)) for x in (("words", "own_words"), ("own_words", "words"))]
    pairs = durable(pairs.filter(gaps[0] == gaps[1]))
    same = pairs.filter("probe = key").unionByName(pairs.filter("probe <> key").filter(_same_title("own_words", "words")))
    owner = F.min_by("earliest.req", F.when(F.col("earliest").isNotNull(), F.struct(-F.col("jaccard"), F.col("earliest.batch"), F.col("earliest.id"))))
    parent = F.min_by("key", F.when(F.col("first") < F.col("own_first"), F.col("first")))
    found = durable(same.groupBy("probe").agg(owner.alias("owner"), parent.alias("parent")))
    # A set follows the earlier one it repeats to that one's opening.
    text = F.when(F.col("owner").isNull(), F.coalesce("parent", "probe"))
    settled = found.select("probe", "owner", text.alias("parent"))
    up = found.select(F.col("probe").alias("parent"), F.col("owner").alias("up_owner"), F.col("parent").alias("up"))
    while settled.filter("owner is null and parent <> probe").join(up, "parent").filter("up_owner is not null or up is not null").limit(1).count():
        moved = settled.join(up, "parent", "left").select("probe", F.coalesce("owner", "up_owner").alias("owner"), F.coalesce("up", "parent").alias("parent"))
        settled = durable(moved)
    named = settled.join(sets.select(F.col("key").alias("probe"), F.col("without").alias("n")), "probe")
    named = named.select(F.col("probe").alias("key"), "n", F.coalesce(F.concat(F.lit("r:"), "owner"), F.concat(F.lit("s:"), "parent")).alias("opening"))
    lacking = rows.filter("req is null").select("id", "batch", key.alias("key"))
    found = encode_join(lacking, "key", durable(named), "n", rows.count()).select("id", "batch", "opening")
    return found.unionByName(rows.filter("req is not null").select("id", "batch", F.concat(F.lit("r:"), "req").alias("opening")))


def repeats(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """first_id, id: each row whose opening has a row in an earlier batch. ``rows`` and ``codes`` as in :func:`openings`; batch is never null."""
    spark = rows.sparkSession
    rows = durable(rows)
    named = openings(rows, codes, PostingIndex(spark, scratch_path(spark, "postings"), LEAST_OVERLAP)).filter("opening is not null")
    first = named.groupBy("opening").agg(F.min(F.struct("batch", "id")).alias("f"), F.max("batch").alias("last"), F.count("*").alias("n"))
    first = durable(first.filter(F.col("last") > F.col("f.batch")).select("opening", "n", F.col("f.batch").alias("first_batch"), F.col("f.id").alias("first_id")))
    joined = encode_join(named, "opening", first, "n", rows.count())
    return joined.filter(F.col("batch") > F.col("first_batch")).select("first_id", "id")


def check_batch(index: PostingIndex, batch: DataFrame) -> DataFrame:
    """One new batch (key, tokens) against everything accepted: the hits found before its sets are appended.

    Reads the buckets of the batch's prefixes only and works on an index that is still empty.
    """
    hits = durable(index.probe(batch))
    index.append(batch.dropDuplicates(["key"]))
    return hits
