"""Duplicates hidden by formatting differences.

Columns are dictionary-encoded: each distinct value is canonicalised once into integers, the
hashes of its letters (``a``), of its words in order of the alphabet (``b``) and of its pieces
between punctuation in that order (``c``), all without case, white space, punctuation and
compatibility forms. Two values are equal if they share one of them. A value whose integers
come in no other set keeps one only. For a URL the parameters are ordered and the rest keeps
its order; a fragment follows the path as if no sign stood between them.

Records become tuples of those integers; equal tuples are grouped first, with partial
results. Tuples that share one integer in every field belong together: such a shared
combination links tuples to the least one, and the classes are the components of these
links (:func:`leadloom.llm.common.components`). So values of other records can't join two
records, and only tuples that hold a value with several integers take part.

Integers are 64-bit hashes: two different keys would have to collide in records that agree
in all other fields. Tuples and combinations meet by hashes of 128 bits.

Defined results: null equals null and nothing else; rows with a null URL form no group;
blank and punctuation-only values equal each other; equal rows are copies; ties go to
the least id; very long texts are canonicalised whole and then only their integers are
kept; an empty table gives empty results. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import components, encode_join, field_entry
from leadloom.runtime import durable

_NULL = "\u0000null"
_KEYS = T.StructType([T.StructField(k, T.StringType()) for k in "abc"])


def _plain(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


@lru_cache(maxsize=65536)
def _letters(text: str) -> str:
    """Compatibility form without case, white space, punctuation and symbols of the keyboard."""
    return "".join(c for c in _plain(text) if c.isalnum() or not _drop(c))


@lru_cache(maxsize=4096)
def _drop(c: str) -> str:
    """``" "`` for white space and invisible characters, ``","`` for punctuation and symbols of the keyboard, else empty."""
    kind = unicodedata.category(c)[0]
    return " " if kind in "ZC" else "," if kind == "P" or c in "+<=>|~^`$" else ""


@lru_cache(maxsize=65536)
def text_keys(text: str) -> tuple[str, str, str]:
    """Letters; words in order of the alphabet; pieces between punctuation in order of the alphabet."""
    s = "".join(c if c.isalnum() else _drop(c) or c for c in _plain(text))
    words = s.replace(",", " ").split()
    pieces = ["".join(x.split()) for x in s.split(",")]
    return "".join(words), " ".join(sorted(words)), ",".join(sorted(x for x in pieces if x))


def url_key(url: str) -> str:
    s = url if url.isascii() else unicodedata.normalize("NFKC", url)
    s, _, fragment = s.partition("#")
    path, _, query = s.partition("?")
    params = "\u0002".join(sorted(x for x in map(_letters, query.split("&")) if x))
    return _letters(path) + (f"\u0001{params}\u0001" if params else "") + _letters(fragment)


@F.pandas_udf(_KEYS)
def _keys(urls: pd.Series, values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(_NULL,) * 3 if v == _NULL else (url_key(v),) * 3 if u else text_keys(v) for u, v in zip(urls, values, strict=True)], columns=list("abc"))


def value_dictionary(long: DataFrame, url_field: int) -> DataFrame:
    """entry, n (rows that hold it), codes (its integers), open (whether another value shares some of them only). ``long``: entry (field and value)."""
    values = long.groupBy("entry").agg(F.count("*").alias("n")).select("entry", "n", F.substring_index("entry", ":", 1).cast("int").alias("f"))
    k = _keys(F.col("f") == url_field, F.expr("substring(entry, instr(entry, ':') + 1)")).alias("k")
    integers = F.array_sort(F.array_distinct(F.array(*[F.xxhash64("f", f"k.{x}") for x in "abc"])))
    keyed = durable(values.select("f", "entry", "n", k).select("entry", "n", integers.alias("codes")))
    # A value needs one integer only if none of its integers comes in another set.
    each = keyed.select("entry", F.xxhash64("codes").alias("whole"), F.explode("codes").alias("code"))
    mixed = each.groupBy("code").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("lo <> hi").select("code")
    several = each.join(mixed, "code", "left_semi").select("entry").distinct().withColumn("open", F.lit(True))
    out = keyed.join(several, "entry", "left").withColumn("open", F.col("open").isNotNull())
    return durable(out.withColumn("codes", F.when(F.col("open"), F.col("codes")).otherwise(F.slice("codes", 1, 1))))


def encoded_records(df: DataFrame, id_col: str, text_cols: list[str], url_col: str) -> DataFrame:
    """id, key of the tuple of its fields' integers, and the tuple itself (an array per field) if one of its values is open, of each row with a URL."""
    columns = [*text_cols, url_col]
    rows = df.filter(F.col(url_col).isNotNull())
    fields = F.array(*[field_entry(i, F.coalesce(F.col(c), F.lit(_NULL))) for i, c in enumerate(columns)])
    long = rows.select(F.col(id_col).alias("id"), F.posexplode(fields).alias("f", "entry"))
    total = rows.count() * len(columns)
    coded = encode_join(long, "entry", value_dictionary(long.select("entry"), len(columns) - 1), "n", total)
    coded = coded.groupBy("id").agg(F.array(*[F.max(F.when(F.col("f") == i, F.col("codes"))) for i in range(len(columns))]).alias("record"), F.max("open").alias("open"))
    return coded.select("id", _hash128(F.col("record")).alias("key"), F.when(F.col("open"), F.col("record")).alias("record"))


def _hash128(c: Column) -> Column:
    """32 hexadecimal digits, of two independent hashes of 64 bits."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), c)), 16, "0") for salt in ("a", "b")])


def _combinations(record: Column, n: int) -> Column:
    """Every choice of one integer per field."""

    def longer(heads: Column, codes: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(codes, lambda x: F.concat(head, F.array(x)))))

    out = F.transform(F.get(record, F.lit(0)), lambda x: F.array(x))
    for i in range(1, n):
        out = longer(out, F.get(record, F.lit(i)))
    return out


def collapse(df: DataFrame, id_col: str, text_cols: list[str], url_col: str) -> tuple[DataFrame, DataFrame]:
    """``groups``: first_id, copies. ``members``: first_id, id of every row that is not the first."""
    n = len(text_cols) + 1
    records = durable(encoded_records(df, id_col, text_cols, url_col))
    tuples = durable(records.groupBy("key").agg(F.first("record").alias("record"), F.min("id").alias("first_id"), F.count("*").alias("copies")))
    # Only tuples of a URL that several tuples have can be linked.
    url = F.get(F.get("record", F.lit(n - 1)), F.lit(0)).alias("url")
    opened = tuples.filter("record is not null").select("first_id", "record", url)
    crowded = opened.groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url")
    opened = opened.join(crowded, "url", "left_semi")
    choices = durable(opened.select("first_id", F.explode(_combinations(F.col("record"), n)).alias("c")).select("first_id", F.xxhash64(F.lit("a"), "c").alias("c1"), F.xxhash64(F.lit("b"), "c").alias("c2")))
    shared = choices.groupBy("c1", "c2").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    links = choices.join(shared, ["c1", "c2"]).select(F.col("first_id").alias("a"), F.col("least").alias("b"))
    roots = components(links).select(F.col("node").alias("first_id"), "root")
    rooted = durable(tuples.join(roots, "first_id", "left").select("key", "first_id", "copies", F.coalesce("root", "first_id").alias("root")))
    groups = rooted.groupBy(F.col("root").alias("first_id")).agg(F.sum("copies").alias("copies"))
    several = rooted.filter("copies > 1 or root <> first_id").select("key", F.col("copies").alias("n"), F.col("root").alias("first_id"))
    members = encode_join(records.select("id", "key"), "key", several, "n", records.count())
    return groups, members.filter("first_id is not null and id <> first_id").select("first_id", "id")
