"""Variant spellings of organisations: a noisy channel over observed spellings.

Observed spellings are the names people typed and the tenant part of the URL in the same
row (or in another row of the same requisition). Every spelling is a candidate canonical
form; its prior is its frequency, with tenant spellings counted ``TENANT_WEIGHT`` times
because no person typed them. The channel turns a canonical form into a typed name by
typos, abbreviations, dropped words, truncation, initials, another order of the words and
added words; its costs are negative log likelihoods. Each distinct (name, tenant) pair is
attached to its maximum posterior. The tenant of a row is one more observation of it: any
other form pays ``OTHER_TENANT_COST``. A pair whose tenant no other form can outweigh, by a
bound over the frequencies of all forms, needs no other candidates; its posterior is given
as 1.

Candidates come from equi-joins that give every form the channel could prefer: the
same letters; tenants seen with the same letters; words that the channel can turn into the
form's first word or one of its rarest (:func:`word_links`); a part of the whole name that
is as it was, which the channel asks of names written as one word; names cut off; initials. So a form that
keeps its first word, or is cheaper than ``FIRST_LOST``, is never missed. Tenants and
spellings typed ``NOVEL_LEAST`` times or more are forms others can be linked to. Pairs of
spelling and form are scored as rows and chosen by aggregates, so no list of candidates is
built, and hot spellings cost one row because only distinct pairs are handled.

Defined results: null and blank names without a tenant stay without an organisation; a
name nobody else spells is its own canonical form; ties go to the more frequent, then the
smaller spelling; repeated rows count as frequency; very long names are handled whole;
empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import LONG_WORD, beginnings, deletions, fold, hashes, segments, words_of
from leadloom.operators.moments import let
from leadloom.runtime import durable

#: Legal forms at the end of a name, folded and without dots.
LEGAL = frozenset("inc incorporated llc ltd limited gmbh bv corp corporation co company plc ag sa sarl srl spa ab oy as nv kg pty lp llp mbh".split())
#: Words people add around a name.
ADDED_BEFORE = frozenset({"the"})
ADDED_AFTER = frozenset({"hq", "careers", "career", "jobs", "job", "hiring", "group", "recruiting", "recruitment", "team"})
#: Joints between names.
JOINTS = frozenset({"and", "und", "et"})
#: Abbreviations that are no prefix of their word.
SHORT = {
    "mfg": "manufacturing", "intl": "international", "dx": "diagnostics", "sw": "software", "netwks": "networks", "labs": "laboratories", "soln": "solutions", "solns": "solutions",
    "svcs": "services", "mgmt": "management", "pharm": "pharmaceuticals", "govt": "government", "grp": "group", "natl": "national",
}
TENANT_WEIGHT = 10
MIN_POSTERIOR = 0.5
#: Cost of taking a typed spelling that no tenant confirms for a form of its own.
NOVEL_COST = 3.0
#: Cost of a form that is not the tenant of the row's URL.
OTHER_TENANT_COST = 14.0
#: Least cost of a spelling, and weight of the share of a spelling's rows that a tenant has.
SAME_COST, VOTE_WEIGHT = 0.1, 20.0
#: Cost of a name without its first word.
FIRST_LOST = 8.0
#: Most typos of a name written as one word.
MOST_EDITS = 3
#: Rows from which a spelling no tenant has is a form that others can be linked to.
NOVEL_LEAST = 8

_WORDS = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("squash", T.StringType())])


@lru_cache(maxsize=65536)
def core_words(name: str) -> tuple[str, ...]:
    """Words of a name without legal form, joints and additions; a name of such words only is kept as it is."""
    text = fold(name).strip()
    domain = re.fullmatch(r"[\W_]*(?:https?://)?(?:www\.)?([\w-]{5,})\.([a-z]{2,9})[\W_]*", text)
    if domain and domain[2] not in LEGAL:
        return (domain[1].replace("-", ""),)
    text = re.sub(r"gesellschaft\s+mbh", "gmbh", text)
    words = list(words_of(text))
    kept = list(words)
    changed = True
    while changed and len(kept) > 1:
        changed = False
        if kept[-1] in LEGAL or kept[-1] in ADDED_AFTER:
            kept.pop()
            changed = True
        elif kept[0] in ADDED_BEFORE:
            kept.pop(0)
            changed = True
        elif len(kept) > 2 and "".join(kept[-3:]) in ("llc",) and all(len(w) == 1 for w in kept[-3:]):
            kept = kept[:-3]
            changed = True
        elif len(kept) > 2 and "".join(kept[-2:]) in ("bv", "sa", "ag", "nv") and all(len(w) == 1 for w in kept[-2:]):
            kept = kept[:-2]
            changed = True
    return tuple(w for i, w in enumerate(kept) if w not in JOINTS or i in (0, len(kept) - 1)) or tuple(words)


@F.pandas_udf(_WORDS)
def _core(names: pd.Series) -> pd.DataFrame:
    rows = [core_words(n) if n is not None else () for n in names]
    return pd.DataFrame({"words": [list(r) for r in rows], "squash": ["".join(r) for r in rows]})


def tenant(url: Column) -> Column:
    """The organisation's part of a board URL: the tenant of the host, else the first path segment; null if there is none."""
    shaped = r"^https?:/+(?:www\.)?(?:([^./?#:]+)\.wd\d+\.[^/?#]*|careers\.([^./?#:]+)\.[^/?#]*|[^/?#]+)(?:/+([^/?#]*))?.*$"
    u = F.lower(F.regexp_replace(url, r"[\s\u00a0\u200b]+", ""))
    found = let(u, lambda x: F.when(x.rlike("^https?:/"), F.split(F.regexp_replace(x, shaped, "$1|$2|$3"), r"\|", 3)))
    first = let(found, lambda x: F.coalesce(F.nullif(F.get(x, F.lit(0)), F.lit("")), F.nullif(F.get(x, F.lit(1)), F.lit("")), F.get(x, F.lit(2))))
    return F.nullif(F.regexp_replace(F.regexp_replace(first, r"-\d+$", ""), r"[^\p{L}\p{N}]", ""), F.lit(""))


_UUID = r"([0-9a-f]{8}(?:[-_ ]?[0-9a-f]{4}){3}[-_ ]?[0-9a-f]{12})"


def requisition(job_id: Column, url: Column) -> Column:
    """Key of a requisition in a source id or else a URL, however written: a UUID, or a number without leading zeros."""

    def plain(c: Column) -> Column:
        return F.lower(F.translate(c, "０１２３４５６７８９", "0123456789"))

    def first(c: Column, *patterns: str) -> Column:
        """First pattern that matches; each is tried only where the ones before it fail."""
        if not patterns:
            return F.lit(None).cast("string")
        rest = first(c, *patterns[1:])
        return let(F.regexp_extract(c, patterns[0], 1), lambda x: F.when(x != "", x).otherwise(rest))

    def settled(c: Column) -> Column:
        return let(c, lambda x: F.nullif(F.when(F.length(x) >= 32, F.regexp_replace(x, "[-_ ]", "")).otherwise(F.regexp_replace(x, "^0+", "")), F.lit("")))

    from_id = let(plain(job_id), lambda j: settled(first(j, _UUID, r"(\d{4,})\D*$")))
    from_url = let(plain(url), lambda u: settled(first(u, _UUID, r"[?&](?:gh_jid|jobid|jid|job_id|job)=(\d{4,})", r"^[^?#]*(?<!\d)(\d{5,})")))
    return let(from_id, lambda x: F.when(x.isNotNull(), x).otherwise(from_url))


def _edits(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; ``most + 1`` if more."""
    # An edit changes the set of letters by two at most.
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    # Only cells within ``most`` of the diagonal can count.
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        last, row, at_least = row, {}, far
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                d = i
            else:
                y = b[j - 1]
                d = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = min(d, before.get(j - 2, far) + 1)
            row[j] = d
            at_least = min(at_least, d)
        if at_least > most:
            return far
        before = last
    return min(row.get(len(b), far), far)


@lru_cache(maxsize=262144)
def _word_cost(seen: str, true: str) -> float:
    """Cost of writing ``true`` as ``seen``; infinite if they have nothing in common."""
    if seen == true:
        return 0.0
    if SHORT.get(seen) == true or (len(seen) >= 3 and len(true) > len(seen) + 1 and true.startswith(seen)):
        return 1.0
    most = 1 if len(true) < 6 else 2
    d = _edits(seen, true, most)
    if d <= most:
        return 2.0 * d + 0.5
    short = [(k, v) for k, v in SHORT.items() if v == true]
    if any(_edits(seen, k, 1) <= 1 and len(seen) >= 3 for k, _ in short) or (4 <= len(seen) < LONG_WORD and len(true) > len(seen) and _edits(seen, true[: len(seen)], 1) <= 1):
        return 4.0
    return math.inf


def _parts(length: int) -> tuple[int, list[tuple[int, int]]]:
    """Most typos of a whole name of so many letters, and its parts (one more than typos): start and end."""
    most = MOST_EDITS if length > 12 else 2
    cuts = [length * i // (most + 1) for i in range(most + 2)]
    return most, list(zip(cuts, cuts[1:], strict=False))


def _whole_edits(a: str, b: str) -> int | None:
    """Edits between whole names; null if there are too many or none of the parts of ``b`` stands in ``a`` about where it belongs."""
    most, parts = _parts(len(b))
    if abs(len(a) - len(b)) > most or not any(b[i:j] == a[k : k + j - i] for i, j in parts for k in range(max(0, i - most), i + most + 1)):
        return None
    d = _edits(a, b, most)
    return d if d <= most else None


def whole_signatures(name: str, true: bool) -> set[str]:
    """Texts by which a typed name and a form meet wherever :func:`_whole_edits` is not null."""
    if true:
        return {f"{len(name)}:{n}:{name[i:j]}" for n, (i, j) in enumerate(_parts(len(name))[1])}
    out = set()
    for length in range(max(1, len(name) - MOST_EDITS), len(name) + MOST_EDITS + 1):
        most, parts = _parts(length)
        if abs(length - len(name)) <= most:
            out |= {f"{length}:{n}:{name[k : k + j - i]}" for n, (i, j) in enumerate(parts) for k in range(max(0, i - most), i + most + 1)}
    return out


def channel_cost(seen: tuple[str, ...], true: tuple[str, ...]) -> float:
    """Negative log likelihood of the typed words given the canonical ones."""
    a, b = "".join(seen), "".join(true)
    if a == b:
        return SAME_COST
    best = 14.0
    if len(seen) <= 2:
        if (d := _whole_edits(a, b)) is not None:
            best = min(best, 1.0 + 2.0 * d)
        if 4 <= len(a) < len(b) and b.startswith(a):
            best = min(best, 5.0 if a != true[0] else 2.6)
    initials = "".join(w[0] for w in true)
    if len(true) >= 2 and a == initials:
        best = min(best, 5.0)
    left = list(seen)
    cost, order = 0.0, []
    for i, word in enumerate(true):
        costs = [(_word_cost(s, word), k) for k, s in enumerate(left) if s]
        c, k = min(costs, default=(math.inf, -1))
        if c < 7:
            cost += c
            order.append(k)
            left[k] = ""
        else:
            cost += FIRST_LOST if i == 0 else 2.5
    cost += 5.0 * sum(1 for w in left if w) + (0.3 if order != sorted(order) else 0.0)
    return min(best, cost) if order else best


@F.pandas_udf(T.DoubleType())
def _cost(words: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([channel_cost(tuple(w), tuple(t)) for w, t in zip(words, true, strict=True)], dtype=float)


def signatures(word: str, true: bool) -> set[int]:
    """Integers by which a typed word and a word of a form meet wherever :func:`_word_cost` is finite.

    A typed word gives its deletions; a form's word those of itself, of its beginnings and of
    its abbreviations. Words of ``LONG_WORD`` letters or more have too many deletions and meet by
    :func:`leadloom.llm.common.segments`, their beginnings as they are.
    """
    most = 2 if len(word) >= (6 if true else 4) else 1
    out = segments(word, true)
    if len(word) < LONG_WORD + 2:
        out |= deletions(word, most)
    if not true:
        return {*hashes(out | {word})}
    for n in range(3, min(len(word), LONG_WORD)):
        out |= deletions(word[:n], 1 if n >= 4 else 0)
    for short, full in SHORT.items():
        if full == word:
            out |= deletions(short, 1)
    return {*hashes(out), *(beginnings(word, LONG_WORD) if len(word) > LONG_WORD else ())}


@F.pandas_udf(T.ArrayType(T.LongType()))
def _signatures(words: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([list(signatures(w, t)) for w, t in zip(words, true, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _whole_signatures(names: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([hashes(whole_signatures(x, t)) for x, t in zip(names, true, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _beginnings(names: pd.Series) -> pd.Series:
    return pd.Series([beginnings(x, 4) for x in names], dtype=object)


@F.pandas_udf(T.LongType())
def _hash(names: pd.Series) -> pd.Series:
    return pd.Series([hashes({x})[0] for x in names], dtype="int64")


@F.pandas_udf(T.BooleanType())
def _whole_related(seen: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([_whole_edits(a, b) is not None for a, b in zip(seen, true, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _related(seen: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([_word_cost(s, t) < math.inf for s, t in zip(seen, true, strict=True)], dtype=bool)


def word_links(words: DataFrame, lexemes: DataFrame) -> DataFrame:
    """word, lexeme: every pair of a typed word (``words``: word) and a form's word (``lexemes``: lexeme) the channel relates, by one equi-join on signatures and an exact check."""
    a = words.distinct().select("word", F.explode(_signatures("word", F.lit(False))).alias("s"))
    b = lexemes.distinct().select("lexeme", F.explode(_signatures("lexeme", F.lit(True))).alias("s"))
    # Not deterministic to Catalyst, which would move the check below the distinct.
    return a.join(b, "s").select("word", "lexeme").distinct().filter(_related.asNondeterministic()("word", "lexeme"))


@F.pandas_udf(T.BooleanType())
def _open(words: pd.Series, own: pd.Series, freq: pd.Series, weight: pd.Series) -> pd.Series:
    """Whether all other forms together (``weight``: sum of their priors) could outweigh the tenant, were each spelled alike and with every vote."""
    out = []
    for w, t, f, total in zip(words, own, freq, weight, strict=True):
        rivals = math.log(total) + math.log1p(VOTE_WEIGHT) - SAME_COST - OTHER_TENANT_COST
        out.append(len(w) > 0 and math.log(f + 0.5) - channel_cost(tuple(w), tuple(t)) < rivals)
    return pd.Series(out, dtype=bool)


def attribute(spellings: DataFrame) -> DataFrame:
    """Attach each distinct (name, tenant) to its canonical form.

    ``spellings``: name, tenant (null if none), n (rows). Result: name, tenant, org (key
    of the canonical form), posterior. ``tenant`` is null-safe in the result.
    """
    names = spellings.filter("name is not null").select("name").distinct().withColumn("c", _core("name"))
    names = durable(names.select("name", "c.words", "c.squash").filter("squash <> ''"))
    pairs = durable(spellings.groupBy("name", "tenant").agg(F.sum("n").alias("n")).join(names, "name", "left"))
    pairs = pairs.withColumn("words", F.coalesce("words", F.expr("array()").cast("array<string>"))).filter("squash is not null or tenant is not null")

    typed = pairs.filter("squash is not null").groupBy(F.col("squash").alias("key"), "words").agg(F.sum("n").alias("n"))
    forms = typed.groupBy("key").agg(F.max_by("words", F.struct("n", F.size("words"))).alias("words"), F.sum("n").alias("n"))
    tenants = pairs.filter("tenant is not null").groupBy(F.col("tenant").alias("key")).agg((F.sum("n") * TENANT_WEIGHT).alias("tn"))
    forms = forms.join(tenants, "key", "full_outer").select(
        "key", F.coalesce("words", F.array("key")).alias("words"), (F.coalesce("n", F.lit(0)) + F.coalesce("tn", F.lit(0))).cast("double").alias("freq"), F.col("tn").isNotNull().alias("known")
    )
    forms = durable(forms)

    # Which forms the same letters occur with: votes of tenants for a typed spelling.
    both = pairs.filter("squash is not null and tenant is not null").groupBy("squash", "tenant").agg(F.sum("n").alias("n"))
    share = both.groupBy("squash").agg(F.sum("n").alias("total"))
    votes = durable(both.join(share, "squash").select("squash", F.col("tenant").alias("key"), (F.col("n") / F.col("total")).alias("vote")))

    weight = forms.agg(F.sum(F.col("freq") + 0.5)).first()[0] or 1.0
    owned = pairs.filter("tenant is not null").join(forms.select(F.col("key").alias("tenant"), F.col("words").alias("own"), "freq"), "tenant")
    owned = durable(owned.withColumn("open", _open("words", "own", "freq", F.lit(weight))).select("name", "tenant", "words", "squash", "own", "freq", "open"))
    free = pairs.filter("tenant is null and squash is not null").select("name", "squash", "words")
    # From here on a loose spelling is its integer ``lid``, so long names are not copied per word.
    loose = free.select("squash", "words").unionByName(owned.filter("open").select("squash", "words")).groupBy("squash").agg(F.max("words").alias("words"))
    loose = durable(loose.withColumn("lid", F.monotonically_increasing_id()))
    scored = durable(_scored(loose, forms, votes))

    score, best = F.col("score"), F.struct(-F.round("score", 9), "key")
    chosen = (F.min_by("key", best).alias("org"), (F.exp(F.max(score)) / F.sum(F.exp(score))).alias("posterior"))
    by_spelling = scored.groupBy("squash").agg(*chosen)
    loose_rows = free.select("name", "squash").join(by_spelling, "squash").select("name", F.lit(None).cast("string").alias("tenant"), "org", "posterior")
    other = owned.filter("open").select("name", "tenant", "squash").join(scored, "squash")
    other = other.select("name", "tenant", "key", (score - F.when(F.col("key") == F.col("tenant"), 0.0).otherwise(OTHER_TENANT_COST)).alias("score"))
    own = owned.filter("open").select("name", "tenant", F.col("tenant").alias("key"), (F.log(F.col("freq") + 0.5) - _cost("words", "own")).alias("score"))
    open_rows = other.unionByName(own).groupBy("name", "tenant", "key").agg(F.max("score").alias("score")).groupBy("name", "tenant").agg(*chosen)
    sure = owned.filter("not open").select("name", "tenant", F.col("tenant").alias("org"), F.lit(1.0).alias("posterior"))
    return durable(sure.unionByName(loose_rows).unionByName(open_rows))


def _scored(loose: DataFrame, forms: DataFrame, votes: DataFrame) -> DataFrame:
    """squash, key, score (log posterior but for a constant) of every loose spelling (lid, squash, words) with every form it can be."""
    zero = F.lit(0.0).alias("vote")
    same = loose.select("lid", F.col("squash").alias("key"), zero)
    voted = votes.join(loose.select("lid", "squash"), "squash").select("lid", "key", "vote")
    anchors = forms.filter(F.col("known") | (F.col("freq") >= NOVEL_LEAST)).select("key", "words")
    # The rarest words of a form, with every other word that is about as rare, and its first one.
    posts = anchors.select("key", F.posexplode("words").alias("pos", "lexeme"))
    df = posts.groupBy("lexeme").agg(F.countDistinct("key").alias("df"))
    ranked = posts.join(df, "lexeme")
    least = ranked.groupBy("key").agg(F.min("df").alias("least"))
    index = durable(ranked.join(least, "key").filter((F.col("pos") == 0) | (F.col("df") <= 4 * F.col("least"))).select("key", "lexeme").distinct())
    typed = loose.select("lid", F.explode("words").alias("word"))
    by_word = typed.join(word_links(typed.select("word"), index.select("lexeme")), "word").join(index, "lexeme").select("lid", "key", zero)
    short = loose.filter(F.size("words") <= 2).select("lid", "squash")
    parts = short.select("squash", F.explode(_whole_signatures("squash", F.lit(False))).alias("s"))
    wholes = anchors.select("key", F.explode(_whole_signatures("key", F.lit(True))).alias("s"))
    by_letters = parts.join(wholes, "s").select("squash", "key").distinct().filter(_whole_related.asNondeterministic()("squash", "key"))
    cut = anchors.filter(F.length("key") > 4).select("key", F.explode(_beginnings("key")).alias("s"))
    cut = short.select("squash", _hash("squash").alias("s")).join(cut, "s").filter(F.startswith("key", "squash")).select("squash", "key")
    first = anchors.filter(F.size("words") >= 2).select(F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "").alias("squash"), "key")
    by_name = by_letters.unionByName(cut).join(short, "squash").select("lid", "key", zero)
    by_initials = first.join(loose.select("lid", "squash"), "squash").select("lid", "key", zero)
    found = same.unionByName(voted).unionByName(by_word).unionByName(by_name).unionByName(by_initials)
    found = found.groupBy("lid", "key").agg(F.max("vote").alias("vote")).join(forms.select("key", F.col("words").alias("true"), "freq", "known"), "key").join(loose, "lid")
    score = F.log(F.col("freq") + 0.5) - _cost("words", "true") + F.log1p(VOTE_WEIGHT * F.col("vote")) - F.when(F.col("known"), 0.0).otherwise(NOVEL_COST)
    return found.select("squash", "key", score.alias("score"))


def with_tenants(rows: DataFrame, name: str, job_id: str, url: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, name, tenant, req and the columns to ``keep``: the tenant of a row's URL, else the one tenant that rows of the same requisition have."""
    keyed = durable(rows.select("id", F.col(name).alias("name"), tenant(F.col(url)).alias("own"), requisition(F.col(job_id), F.col(url)).alias("req"), *keep))
    per = keyed.filter("req is not null and own is not null").groupBy("req").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo = hi").select("req", F.col("lo").alias("other"))
    lacking = keyed.filter("own is null and req is not null").join(per, "req", "left").select("id", "name", F.col("other").alias("tenant"), "req", *keep)
    return keyed.filter("own is not null or req is null").select("id", "name", F.col("own").alias("tenant"), "req", *keep).unionByName(lacking)
