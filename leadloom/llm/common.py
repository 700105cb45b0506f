"""Folding of texts, and joins that stand hot keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.runtime import durable

#: Share of the rows from which a key counts as hot; so there are at most ``1 / HOT`` hot keys.
HOT = 1 / 500
#: Slack of bounds computed in floating point, so that no pair on the threshold is lost.
EPSILON = 1e-9
#: Letters from which words meet by segments instead of deletions, which would be too many.
LONG_WORD = 40


@lru_cache(maxsize=65536)
def fold(text: str) -> str:
    """Compatibility form, case folded, accents and invisible characters dropped."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()).replace("ł", "l").replace("ß", "ss")
    return "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


@lru_cache(maxsize=65536)
def words_of(text: str) -> tuple[str, ...]:
    """Words of a folded text; letters joined by dots (``u.s.``, ``b.v.``) are one word."""
    s = re.sub(r"\b((?:[^\W\d_]\.){2,}(?:[^\W\d_]\b)?)", lambda m: m[1].replace(".", ""), fold(text))
    return tuple(re.findall(r"[^\W_]+", s.replace("'", "").replace("’", "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_words(texts: pd.Series) -> pd.Series:
    return pd.Series([list(words_of(t)) if t is not None else None for t in texts], dtype=object)


def pair_jaccard(a: str, b: str) -> float:
    """Share of the padded letter pairs of two words that both have."""
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} for w in (f"^{a}$", f"^{b}$"))
    return len(x & y) / len(x | y)


@F.pandas_udf(T.DoubleType())
def _pair_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair_jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def close_spelling(a: Column, b: Column) -> Column:
    """One edit, or one swap, or two edits in long words."""
    distance = F.levenshtein(a, b, 3)
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (distance.between(0, 1)) | ((distance == 2) & (same_letters | (F.least(F.length(a), F.length(b)) >= 8)))


def deletions(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out. Words within as many edits (swaps count once) share one of them."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def segments(word: str, indexed: bool) -> set[str]:
    """For words of about ``LONG_WORD`` letters or more: of five parts two edits leave one as it is, at its place but for two letters, even if they are swaps across a border."""
    out = set()
    if len(word) >= LONG_WORD - 2:
        for length in (len(word),) if indexed else range(len(word) - 2, len(word) + 3):
            cuts = [length * i // 5 for i in range(6)]
            for i in range(5):
                for at in (cuts[i],) if indexed else range(max(0, cuts[i] - 2), cuts[i] + 3):
                    out.add(f"part:{length}:{i}:{word[at : at + cuts[i + 1] - cuts[i]]}")
    return out


def hashes(texts: set[str]) -> list[int]:
    """64-bit integers of texts."""
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in texts]


def beginnings(text: str, least: int) -> list[int]:
    """The integers of every proper beginning of ``least`` letters or more, in one pass."""
    state, out = xxhash.xxh64(text[: least - 1].encode()), []
    for c in text[least - 1 : -1]:
        state.update(c.encode())
        out.append(state.intdigest() - (1 << 63))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _near(words: pd.Series, indexed: pd.Series) -> pd.Series:
    return pd.Series([hashes((deletions(w, 2) if len(w) < LONG_WORD + 2 else set()) | segments(w, i)) for w, i in zip(words, indexed, strict=True)], dtype=object)


def close_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """word, lexeme, jaccard (of their letter pairs): every pair that is equal or a :func:`close_spelling`.

    ``left``: word. ``right``: lexeme. Both distinct. Words within two edits share a
    deletion of at most two letters (long ones a segment), so one equi-join on hashes of
    those finds all of them; no key is common to many words, as letter pairs are.
    """
    a = left.select("word", F.explode(_near("word", F.lit(False))).alias("s"))
    b = right.select("lexeme", F.explode(_near("lexeme", F.lit(True))).alias("s"))
    pairs = a.join(b, "s").select("word", "lexeme").distinct().filter((F.col("word") == F.col("lexeme")) | close_spelling(F.col("word"), F.col("lexeme")))
    return pairs.select("word", "lexeme", _pair_jaccard("word", "lexeme").alias("jaccard"))


def encode_join(rows: DataFrame, key: str, dictionary: DataFrame, n_col: str, total: int) -> DataFrame:
    """Left join of ``rows`` with a dictionary of unique non-null string ``key`` that holds each key's row count in ``n_col``.

    Keys that hold more than ``HOT`` of the rows are at most ``1 / HOT`` by counting, so
    they are joined by broadcast; their rows then go through the shuffle of the others
    under spread keys that match nothing. ``n_col`` is dropped.
    """
    floor = max(1, int(total * HOT))
    values = [c for c in dictionary.columns if c not in (key, n_col)]
    hot = dictionary.filter(F.col(n_col) > floor).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = dictionary.filter(F.col(n_col) <= floor).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(9973)).cast("string"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(F.col(key)))
    joined = marked.join(cold, "_key", "left")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values])


def encode_fields(rows: DataFrame, fields: dict[str, str], dictionary: DataFrame, total: int) -> DataFrame:
    """id and one integer code per field, null where the dictionary has none.

    ``fields``: name of the code to the column with the value. ``dictionary``: entry
    (made by :func:`field_entry`), n, code. The fields are stacked, so each value is
    shuffled once and by itself, and only ids and codes are shuffled back.
    """
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("f"), field_entry(i, F.col(c)).alias("entry"))) for i, c in enumerate(fields.values())])
    long = rows.select("id", F.explode(F.array_compact(pairs)).alias("x")).select("id", "x.f", "x.entry")
    coded = encode_join(long, "entry", dictionary, "n", total * len(fields)).select("id", "f", "code")
    return coded.groupBy("id").agg(*[F.max(F.when(F.col("f") == i, F.col("code"))).alias(name) for i, name in enumerate(fields)])


def field_entry(field: int, value: Column) -> Column:
    """Key of a value in the dictionary of all fields."""
    return F.concat(F.lit(f"{field}:"), value)


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of ``links``: a, b.

    Alternating large-star and small-star steps: each node's greater neighbours go to its
    least neighbour, then its lesser ones do. The rounds grow with the logarithm of the
    longest chain, each ends in a checkpoint, and the loop ends when nothing changes.
    Nodes without a partner are left out.
    """
    pairs = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = durable(small.filter("u <> v").distinct())
