"""Encoding of texts with a public tokenizer, and exact decoding.

The vocabulary file is a parameter; workers load it once and encode Arrow batches.
Null and empty texts have no ids. Decoding reverses the byte table of byte-level BPE:
a token stands for bytes, not characters, so a character may be split between tokens
and comes back only when all its bytes are joined; a piece of a text that begins or
ends inside a character is decoded with U+FFFD for the broken one.

Byte-level BPE with the pattern of its first kind (a pre-tokenizer of type ``ByteLevel`` with
its own pattern, no prefix space and no normalizer) never merges across the places where its first pattern splits, and a
single space between a plain letter, digit or mark and a plain letter is always such a
place. So a text is cut there, every distinct piece is encoded once per worker by the
library (the newest ``CACHED`` are kept) and the ids are joined; the result is the same
as for the whole text, which the tests check.

Defined results: null, empty: empty list; any other text, however long or damaged,
is encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIR = "/opt/tokenizers"
_NONE = np.zeros(0, np.int32)


def vocabulary(name: str = "byte_bpe_50k.json", folder: str = DEFAULT_DIR) -> str:
    return str(Path(folder) / name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def byte_table() -> dict[str, int]:
    """Character of the vocabulary to byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Pieces a worker keeps.
CACHED = 200_000
_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?)]) (?=[A-Za-z])")


def cuts_at_spaces(path: str) -> bool:
    """Whether texts may be cut at spaces for the tokenizer of a file; other ones encode whole texts."""
    t = json.loads(Path(path).read_text(encoding="utf-8"))
    pre = t.get("pre_tokenizer") or {}
    return t.get("normalizer") is None and t["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


class Pieces:
    """Ids of the pieces of texts; a piece after a cut keeps its space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.cut = cuts_at_spaces(path)
        self.known: dict[str, list[int]] = {}

    def of(self, text: str) -> list[list[int]]:
        """Lists of ids whose concatenation is the encoding of the text."""
        head, *rest = _CUT.split(text) if self.cut else [text]
        names = [head, *map(" ".__add__, rest)]
        known = self.known
        try:
            return [known[x] for x in names]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            missing = list({x for x in names if x not in known})
            for x, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                known[x] = e.ids
            return [known[x] for x in names]


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    table = byte_table()
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def encode(text: Column, path: str) -> Column:
    """``array<int>``: ids without special tokens."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(path)
        for texts in batches:
            yield pd.Series([np.fromiter(chain.from_iterable(p.of(x)), np.int32) if x else _NONE for x in texts], dtype=object)

    return ids(text)


def count_tokens(text: Column, path: str) -> Column:
    """``int``: number of ids."""

    @F.pandas_udf("int")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(path)
        for texts in batches:
            yield pd.Series([sum(map(len, p.of(x))) if x else 0 for x in texts], dtype="int32")

    return n(text)


def encode_with_offsets(text: Column, path: str) -> Column:
    """``array<struct<id, start, stop>>``: ids with the characters they touch; tokens inside one character share its offsets."""

    @F.pandas_udf("array<struct<id int, start int, stop int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for texts in batches:
            out = (t.encode(x or "", add_special_tokens=False) for x in texts)
            yield pd.Series([[{"id": i, "start": a, "stop": b} for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in out], dtype=object)

    return spans(text)


def decode(ids: Column, path: str) -> Column:
    """Text of a list of ids; null for null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _token_bytes(path)
        for lists in batches:
            yield pd.Series([None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in lists], dtype=object)

    return text(ids)
