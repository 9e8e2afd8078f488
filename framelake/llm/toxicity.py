"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones,
undoes digits written for letters inside words, and leaves words parted by one
space.  The lexicon's entries are words and word beginnings, weighted by their
log-odds in labelled documents; matches inside exception phrases don't count.
The matched weight a thousand words is calibrated by a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import fitting, runtime

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝѵмтнвкαοερτυικνχ", "aeopcyxijsdhqwvmthbkaoeptuiknx", strict=True))
# Characters written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which lexicon words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "idiot proof", "scum line", "pond scum", "stupid simple")

#: Labelled documents of a fit, at most.  Lengths of word beginnings that can be entries; distinct contexts an entry needs; least log-odds.
#: Words that are added to a text's own, so that a rare word in a short text isn't much.
FIT_ROWS = 4000
STEMS, SUPPORT, LEAST_ODDS, MORE_WORDS = range(4, 9), 4, 3.0, 50
#: Densities are some tens or hundreds; the curve is fitted on them in this unit.
SCALE = 100.0

_TABLE = str.maketrans({**LOOK_ALIKES, **dict.fromkeys(INVISIBLE)})
_SUBSTITUTED = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?=[\w@$!|]*[^\W\d_])(?=[\w@$|!]*[0134578@$|!])[\w@$|!]*[\w@$|]")
_HAS_SUBSTITUTE = re.compile(r"[0134578@$|!]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, each with a space before and after it."""
    out = text.lower()
    if not out.isascii():
        out = unicodedata.normalize("NFKC", out).lower().translate(_TABLE)
    if _HAS_SUBSTITUTE.search(out):
        out = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTED), out)
    return f" {' '.join(_WORD.findall(out))} "


@dataclass(frozen=True)
class Model:
    """Entries (with a space before them, and after them if they are whole words), their weights, and the curve."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float] = (-4.0, 1.0)
    constant: float | None = None


class Matcher:
    """Matched weight of folded texts; entries may overlap, of those that begin at one place the longest counts."""

    def __init__(self, model: Model):
        self.machine = ahocorasick.Automaton()
        for entry, weight in model.entries:
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[int, float]]:
        """(end, weight) by where an entry begins, without those inside exceptions."""
        found: dict[int, tuple[int, float]] = {}
        spans: list[tuple[int, int]] = []  # exceptions by where they end, without those inside a later one
        for end, (size, weight) in () if self.empty else self.machine.iter(folded):
            begin = end - size + 1
            if weight is None:
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                spans.append((begin, end))
            else:
                found[begin] = (end, weight)
        if not spans:
            return found
        # spans now ascend in both ends: of those that begin before a match the last reaches furthest
        kept, k = {}, 0
        for begin in sorted(found):
            while k + 1 < len(spans) and spans[k + 1][0] <= begin:
                k += 1
            if not spans[k][0] <= begin or found[begin][0] > spans[k][1]:
                kept[begin] = found[begin]
        return kept

    def measure(self, text: str) -> float:
        """Matched weight a thousand words, of ``MORE_WORDS`` more than the text has."""
        folded = fold(text)
        weight = sum(w for _, w in self.matches(folded).values())
        return 1000 * weight / (folded.count(" ") - 1 + MORE_WORDS) if weight else 0.0


def terms_of(folded: str) -> dict[str, int]:
    """The terms of a folded text (beginnings of words, and words with a space after them), and bits for the words before them.

    A bit is that of a hash of the word before, of 64, so that bits can be
    counted over texts: copies of one text add none.
    """
    words = folded.split()
    bits: dict[str, int] = {}
    for before, word in zip(["", *words], words, strict=False):
        bits[word] = bits.get(word, 0) | 1 << (zlib.crc32(before.encode()) & 63)
    out: dict[str, int] = {}
    for word, b in bits.items():
        for term in (*(word[:k] for k in STEMS if len(word) >= k), word + " "):
            out[term] = out.get(term, 0) | b
    return out


@dataclass(frozen=True)
class Term:
    """A term's documents among toxic and clean ones."""

    term: str
    toxic: int
    clean: int


def choose_entries(strong: list[Term], n_toxic: int, n_clean: int) -> tuple[tuple[str, float], ...]:
    """Entries and weights of the terms that are frequent in toxic texts and rare in clean ones.

    Of a beginning and a longer one with nearly its support the longer stays, and
    of a beginning that stays and a longer one the beginning.
    """
    odds = {t.term: _odds(t, n_toxic, n_clean) for t in strong}
    toxic = {t.term: t.toxic for t in strong}
    longer: Counter[str] = Counter()
    for t in strong:
        for k in range(1, len(t.term)):
            longer[t.term[:k]] = max(longer[t.term[:k]], t.toxic)
    wide = {t for t in toxic if longer[t] < 0.9 * toxic[t]}
    kept = [t for t in wide if not any(t[:k] in wide for k in range(1, len(t)))]
    kept.sort(key=lambda t: (-toxic[t], t))
    return tuple((" " + t, round(odds[t], 6)) for t in kept)


def _odds(t: Term, n_toxic: int, n_clean: int) -> float:
    return math.log((t.toxic + 0.5) / (n_toxic + 1)) - math.log((t.clean + 0.5) / (n_clean + 1))


def learn_entries(sample: DataFrame) -> tuple[tuple[str, float], ...]:
    """Entries and weights from labelled texts (text, label); the driver gets the terms that can be entries alone.

    An entry's support is the number of different words it follows in toxic
    texts (see ``terms_of``).
    """

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                terms = terms_of(fold(text))
                bits = np.array(list(terms.values()), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), pa.array(np.full(len(terms), label, np.int32)), pa.array(bits)], names=["term", "label", "bits"])

    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    rows = sample.select("text", "label").mapInArrow(runtime.frugal(listed), "term string, label int, bits long")
    is_toxic = F.col("label") == 1
    counted = rows.groupBy("term").agg(F.bit_or(F.when(is_toxic, F.col("bits"))).alias("bits"), F.count_if(is_toxic).alias("toxic"), F.count_if(~is_toxic).alias("clean"))
    able = (F.bit_count("bits") >= SUPPORT) & (F.col("toxic") >= SUPPORT) & (F.length("term") > 3)
    far = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) >= LEAST_ODDS
    strong = [Term(r["term"], r["toxic"], r["clean"]) for r in counted.filter(able & far).collect()]
    return choose_entries(sorted(strong, key=lambda t: t.term), n_toxic, n_clean)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Fit on at most ``rows`` labelled documents whose crc32(doc_id) mod 3 is not 1; without both labels the score is constant."""
    runtime.small_batches(docs.sparkSession)
    return train(fitting.labelled_sample(docs, labels, "toxic", fitting.crc_of_id() % 3 != 1, rows), exceptions)


def train(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model of labelled texts (doc_id, text, label)."""
    shares = sample.agg(F.count("*"), F.avg("label")).first()
    if not shares[0] or shares[1] in (0.0, 1.0):
        return Model(constant=float(shares[1] or 0.0))
    model = Model(learn_entries(sample), exceptions)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            values = pa.array([matcher.measure(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("label"), values], names=["label", "x"])

    known = sample.select("text", "label").mapInArrow(runtime.frugal(measured), "label int, x double").toArrow().sort_by([("label", "ascending"), ("x", "ascending")])
    x = known["x"].to_numpy()
    curve = fitting.logistic(np.stack([np.ones(len(x)), x / SCALE], axis=1), known["label"].to_numpy().astype(float))
    return Model(model.entries, exceptions, (float(curve[0]), float(curve[1]) / SCALE))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with its score in 0 .. 1, from the whole text alone.

    A null text counts as empty, which matches nothing.  All rows and columns stay.
    """
    runtime.small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if model.constant is not None:
                values = np.full(len(texts), model.constant)
            else:
                values = fitting.sigmoid(model.curve[0] + model.curve[1] * np.array([matcher.measure(t) if t else 0.0 for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"
    return docs.mapInArrow(runtime.frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1: toxic) of every row; repeated and null ids are rows like any other."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(texts, fit(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(fitting.crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that aren't rejected, as they are."""
    column = runtime.fresh(docs, "toxic_score")
    return score(docs, fit(docs, labels), column).filter(F.col(column) < threshold).select(*docs.columns)
