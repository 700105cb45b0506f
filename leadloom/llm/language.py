"""Language of documents and of their blocks.

A text is a bag of hashed subwords (letter n-grams and whole words of folded text). The
averaged embeddings of its subwords go through a linear softmax; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled sentences of the same
table (parameters of :class:`Training`). One class more than the languages stands for no
language; its examples are sentences whose letters were shuffled. Labels may be wrong, so
sentences to which the first model gives another language at twice the probability are
left out of the second.

Rejection is calibrated on the sentences of documents that neither model was fitted on.
Their labels may be wrong as well, so documents count only if at least three quarters of
their sentences (and three at least) get the language of the label; all sentences of such a
document count, also those that get another one. The temperature is the one under which they are
most likely; the least confidence is the smallest at which the accepted answers are wrong no
more often than ``max_error``, give or take a standard deviation of such a count. A text below it, or one that is most likely no language,
comes out as ``und``.

Only sentences speak for a language: titles, headings, lists of tools, numbers, addresses
and markup are left out. A document is mixed if two of its blocks are surely of different
languages.

Defined results: null, empty and sentence-free texts give nothing; damaged characters are
repaired first; a block without sentences, or with rejected ones, takes the language of the
block before it in a mixed document (or else after it); whole texts are read, however long;
repeated rows give repeated results; a table without usable labels or an empty one gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of languages as labels write them, folded; other languages are names too.
LABELS = {
    "en": "en eng english englisch anglais ingles inglese engels angielski", "de": "de deu ger german deutsch allemand aleman tedesco duits niemiecki alemao",
    "fr": "fr fra fre french francais franzosisch frances francese frans francuski", "es": "es spa spanish espanol spanisch espagnol spagnolo spaans hiszpanski castellano",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese portugees portugalski", "nl": "nl nld dut dutch nederlands niederlandisch neerlandais olandese holenderski",
    "it": "it ita italian italiano italienisch italien italiaans wloski", "pl": "pl pol polish polski polnisch polonais polaco polacco pools",
}
LABEL_OF = {w: code for code, words in LABELS.items() for w in words.split()}
LANGUAGES = tuple(sorted(LABELS))
#: Language of a rejected text.
UNKNOWN = "und"

_FOUND = T.ArrayType(T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("mixed", T.BooleanType())]))


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the model; all of it is trained on the driver."""

    documents_per_label: int = 700
    sentences_per_document: int = 8
    buckets: int = 1 << 15
    width: int = 16
    #: Passes over the sample; more where it is so small that they make fewer than ``least_steps`` steps.
    epochs: int = 4
    least_steps: int = 640
    batch: int = 256
    rate: float = 0.5
    held_out: float = 0.1
    max_error: float = 0.002
    #: Longest step of the weights.
    clip: float = 2.0
    #: Shuffled sentences per sentence, as examples of no language.
    shuffled: float = 0.15
    seed: int = 7


def label_language(label: Column) -> Column:
    """Two-letter code a label names; null if it names none of the known ones."""
    bare = F.lower(F.translate(F.regexp_replace(label, r"[\s ]+", ""), "äáàâãéèêëíîóôõöúüçñł", "aaaaaeeeeiioooouucnl"))
    table = F.create_map(*[F.lit(x) for kv in sorted(LABEL_OF.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, F.regexp_extract(bare, r"^([a-z]{2,3})[-_]", 1)))


def repair(text: str) -> str:
    """Bytes of UTF-8 that were read as Latin-1 are put together again; markup and addresses go."""
    if "Ã" in text or "Â" in text or "â\x80" in text or "Å" in text or "Ä" in text:
        text = re.sub(r"[\x80-\xff]{2,}", _repair_run, text)
    text = re.sub(r"(?i)</?(?:p|li|ul|ol|br|div|h\d|tr|td)\b[^>]*>", "\n", text) if "<" in text else text
    text = re.sub(r"<[^<>]{1,200}>", " ", text) if "<" in text else text
    text = html.unescape(text) if "&" in text else text
    return re.sub(r"https?://\S+|\S+@\S+\.\S+", " ", text) if "://" in text or "@" in text else text


def _repair_run(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0].encode("latin-1").decode("utf-8", "ignore") or m[0]


_BULLET = re.compile(r"\s*(?:[-*•–—→✅✔#>]+|\d{1,2}[.)]|\[[^\]]*\])\s*")
_PART = re.compile(r"(?<=[.!?…;])\s+(?!$)")
#: Letters of the Latin blocks, which all known languages use.
_WORD = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]+")


def sentences(text: str) -> list[tuple[str, list[str]]]:
    """Sentences of a repaired text and their words: at least four words, ended by a mark or running on in small letters."""
    out = []
    for line in text.split("\n"):
        if len(line) < 7:  # four words can't be shorter
            continue
        m = _BULLET.match(line)
        for part in _PART.split(line[m.end() :] if m else line):
            words = _WORD.findall(part)
            n = len(words)
            if n < 4:
                continue
            ended = part.rstrip()[-1:] in (".", "!", "?", "…", ";")
            need = 2 if ended else -(-n // 2)
            if not ended and n < 6:
                continue
            small = 0
            for w in words:
                if w[0].islower():
                    small += 1
                    if small >= need:
                        break
            if small >= need or (ended and part.isupper()):
                out.append((part, words))
    return out


def folded_words(text: str) -> list[str]:
    """Words of a text in letters a to z."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).replace("ł", "l").replace("Ł", "l").replace("ß", "ss")
        text = "".join(c for c in text if not unicodedata.combining(c))
    return re.findall(r"[a-z]+", text.lower())


@lru_cache(maxsize=200000)
def subwords(word: str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word: n-grams of two to four letters with its ends marked, and the word."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return tuple(zlib.crc32(g.encode()) % buckets for g in [*grams, "=" + word])


def _ids(text: str, buckets: int) -> np.ndarray:
    return np.array([i for w in folded_words(text) for i in subwords(w, buckets)], dtype=np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    #: Rows of ``_sums`` and ``_sizes`` by written word: what a word adds, computed once.
    _rows: dict = field(default_factory=dict, repr=False)
    _sums: np.ndarray | None = field(default=None, repr=False)
    _sizes: np.ndarray | None = field(default=None, repr=False)

    def _row(self, word: str) -> int:
        ids = [i for w in folded_words(word) for i in subwords(w, len(self.embedding))]
        if self._sums is None:
            self._sums, self._sizes = np.zeros((1024, self.embedding.shape[1] + 1)), np.zeros(1024)
        row = len(self._rows)
        if row == len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        self._sums[row, :-1] = self.embedding[ids].sum(axis=0) if ids else 0.0
        self._sums[row, -1] = len(ids)
        self._rows[word] = row
        return row

    def totals(self, parts: list[list[str]]) -> np.ndarray:
        """A row per part (a list of words): the sum of its subwords' embeddings, and their number."""
        known = self._rows
        if len(known) > 400000:
            known.clear()
        rows = [[known[w] if w in known else self._row(w) for w in p] for p in parts]
        out = np.zeros((len(parts), self.embedding.shape[1] + 1))
        full = [i for i, r in enumerate(rows) if r]
        if full:
            flat = np.array([x for i in full for x in rows[i]])
            starts = np.cumsum([0] + [len(rows[i]) for i in full[:-1]])
            out[full] = np.add.reduceat(self._sums[flat], starts, axis=0)
        return out

    def probabilities(self, totals: np.ndarray) -> np.ndarray:
        z = (totals[:, :-1] / np.maximum(totals[:, -1:], 1) @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _fit(samples: list[np.ndarray], labels: np.ndarray, p: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    E = rng.uniform(-1 / p.width, 1 / p.width, (p.buckets, p.width)).astype(np.float32)
    W, b = np.zeros((p.width, len(LANGUAGES) + 1), np.float32), np.zeros(len(LANGUAGES) + 1, np.float32)
    n, step, per_epoch = len(samples), 0, -(-len(samples) // p.batch)
    epochs = max(p.epochs, -(-p.least_steps // per_epoch))
    steps = epochs * per_epoch
    sizes = np.array([len(x) for x in samples])
    flat, begins = np.concatenate(samples), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, p.batch):
            pick = order[k : k + p.batch]
            lengths = sizes[pick]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            ids = flat[np.repeat(begins[pick] - starts, lengths) + np.arange(lengths.sum())]
            mean = np.add.reduceat(E.take(ids, axis=0), starts, axis=0) / lengths[:, None]
            z = mean @ W + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(pick)), labels[pick]] -= 1
            rate = p.rate * (1 - step / steps)
            back = ((-rate * 4) * (g @ W.T) / lengths[:, None]).astype(np.float32)
            turn = rate * mean.T @ g / 4
            W -= turn * min(1.0, p.clip / (float(np.sqrt((turn * turn).sum())) + 1e-12))
            b -= rate * g.sum(axis=0) / len(pick)
            # The steps of a subword are added up before they are applied.
            steps_of = np.repeat(back.T, lengths, axis=1)
            for d in range(p.width):
                E[:, d] += np.bincount(ids, weights=steps_of[d], minlength=p.buckets)
            step += 1
    return E, W, b


def shuffled_text(text: str, rng: np.random.Generator) -> str:
    """The letters of a text in another order, in words of the same lengths."""
    words = folded_words(text)
    letters = list("".join(words))
    rng.shuffle(letters)
    cuts = np.cumsum([0] + [len(w) for w in words])
    return " ".join("".join(letters[i:j]) for i, j in zip(cuts, cuts[1:], strict=False))


def calibrate(z: np.ndarray, truth: np.ndarray, document: np.ndarray, max_error: float) -> tuple[float, float]:
    """Temperature and least confidence, from the scores of held-out sentences, their labels and their documents."""

    def soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    right = z[:, : len(LANGUAGES)].argmax(axis=1) == truth
    _, at = np.unique(document, return_inverse=True)
    n, agreed = np.bincount(at), np.bincount(at, right)
    of_label = ((n >= 3) & (agreed >= 0.75 * n))[at]
    if not of_label.any():
        return 1.0, 0.5
    z, truth, right = z[of_label], truth[of_label], right[of_label]
    rows = np.arange(len(truth))
    temperature = float(min(np.geomspace(0.05, 4.0, 65), key=lambda t: -np.log(soft(z / t)[rows, truth] + 1e-9).mean()))
    sure = soft(z / temperature)[:, : len(LANGUAGES)].max(axis=1)
    order = np.argsort(-sure, kind="stable")
    allowed = max_error * np.arange(1, len(order) + 1)
    fine = np.flatnonzero(np.cumsum(~right[order]) <= allowed + np.sqrt(allowed))
    return temperature, float(max(0.5, sure[order[fine[-1]]])) if len(fine) else 1.0


def train(texts: list[str], codes: list[str], held: list[int | None], p: Training) -> Model | None:
    """A model fitted on the texts that are not held out and calibrated on those that are (``held``: their document, else null); null if fewer than two languages are left."""
    ids = [_ids(t, p.buckets) for t in texts]
    keep = np.array([len(x) > 0 for x in ids], dtype=bool)
    y = np.array([LANGUAGES.index(c) for c in codes], dtype=np.int64)
    out = np.array([h is not None for h in held], dtype=bool) & keep
    fit = np.flatnonzero(keep & ~out)
    if len(set(y[fit].tolist())) < 2:
        return None
    rng = np.random.default_rng(p.seed + 1)
    none = [x for i in rng.choice(fit, int(len(fit) * p.shuffled)) if len(x := _ids(shuffled_text(texts[i], rng), p.buckets))]

    def scores(model: tuple, part: list[np.ndarray]) -> np.ndarray:
        E, W, b = model
        means = [E.take(x, axis=0).mean(axis=0) for x in part]
        return np.stack(means) @ W + b

    def fitted(at: np.ndarray) -> tuple:
        return _fit([ids[i] for i in at] + none, np.concatenate([y[at], np.full(len(none), len(LANGUAGES))]), p)

    z = scores(fitted(fit), [ids[i] for i in fit])[:, : len(LANGUAGES)]
    fit = fit[z[np.arange(len(fit)), y[fit]] >= z.max(axis=1) - np.log(2)]
    best = fitted(fit)
    model = Model(*best)
    if out.any():
        at = np.flatnonzero(out)
        model.temperature, model.least = calibrate(scores(best, [ids[i] for i in at]), y[at], np.array([held[i] for i in at]), p.max_error)
    return model


def training_sentences(docs: DataFrame, p: Training) -> DataFrame:
    """code, held, text: the bounded sample, chosen by hash, alike for every label; ``held``: the document's id if it is held out, else null."""
    labelled = docs.select("id", "text", label_language(F.col("label")).alias("code")).filter("code is not null and text is not null")
    counts = labelled.groupBy("code").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(counts), "code").filter(share < F.lit(float(p.documents_per_label)) / F.col("n"))
    per = p.sentences_per_document

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def some(texts: pd.Series) -> pd.Series:
        def pick(t: str) -> list[str]:
            return sorted((s for s, _ in sentences(repair(t))), key=lambda s: zlib.crc32(s.encode()))[:per]

        return pd.Series([pick(t) for t in texts], dtype=object)

    bound = int(p.documents_per_label * len(LANGUAGES) * 1.3) * per
    held = F.when(F.pmod(F.xxhash64("id", F.lit("held")), F.lit(1000)) < int(1000 * p.held_out), F.col("id").cast("long"))
    return chosen.select("code", held.alias("held"), F.explode(some("text")).alias("text")).limit(bound)


def _read(text: str, model: Model) -> list[tuple[int, str, float, bool]]:
    """(block, language, confidence, mixed): block 0 for the whole text, then the blocks of a mixed one."""
    blocks = [[w for _, words in sentences(repair(b)) for w in words] for b in text.split("\n\n")]
    if not any(blocks):
        return []
    totals = model.totals(blocks)
    p = model.probabilities(np.concatenate([totals.sum(axis=0, keepdims=True), totals]))
    known = p[:, : len(LANGUAGES)]
    best, sureness = known.argmax(axis=1), known.max(axis=1)
    accepted = (sureness >= model.least) & (p.argmax(axis=1) < len(LANGUAGES))
    spoken = accepted[1:] & (totals[:, -1] > 0)
    mixed = len(set(best[1:][spoken].tolist())) > 1
    out = [(0, LANGUAGES[best[0]] if accepted[0] or mixed else UNKNOWN, float(sureness[0]), mixed)]
    if mixed:
        before = int(best[1:][spoken][0])
        for i, said in enumerate(spoken.tolist(), 1):
            before = int(best[i]) if said else before
            out.append((i, LANGUAGES[before], float(known[i, before]) if totals[i - 1, -1] > 0 else 0.0, True))
    return out


def label_documents(docs: DataFrame, p: Training | None = None) -> DataFrame:
    """id, label, code (what the label names), block_no, lang, confidence, mixed.

    ``docs``: id, text, label. One row with block 0 per document that has sentences, and
    one per block of a mixed one.
    """
    p = p or Training()
    spark = docs.sparkSession
    sample = sorted(((r["code"], r["text"], r["held"]) for r in training_sentences(docs, p).collect()), key=str)
    model = train([t for _, t, _ in sample], [c for c, _, _ in sample], [h for _, _, h in sample], p)
    if model is None:
        return spark.createDataFrame([], "id long, label string, code string, block_no int, lang string, confidence double, mixed boolean")
    shared = spark.sparkContext.broadcast((model.embedding, model.weights, model.bias, model.temperature, model.least))

    @F.pandas_udf(_FOUND)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([[{"block_no": b, "lang": c, "confidence": s, "mixed": m} for b, c, s, m in _read(t, own)] if t else [] for t in texts], dtype=object)

    each = docs.select("id", "label", label_language(F.col("label")).alias("code"), F.explode(read("text")).alias("x"))
    return each.select("id", "label", "code", "x.block_no", "x.lang", "x.confidence", "x.mixed")
