"""Language identification with hyperdimensional letter profiles.

Letters fall into SYMBOLS classes (a to z have one each, all others share the rest by their code point), and every
class has a seeded random vector of +1 and -1.  An n-gram is the
product of its letters' vectors, each rotated by its place: binding with permutation.  A document is the sum of its
n-grams, a language prototype the sum over the documents labelled with it, and the answer is the prototype of the
largest cosine.  What all languages share is taken from the prototypes first, as the mean of their directions.

Profiles are exact: the model counts n-grams over every training row.  What a task sends is one row for each
(language, n-gram code) it has seen, at most languages * SYMBOLS**3, and the driver holds the same bounded table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter classes: 0 is what isn't a letter; letters count from 1.  Latin has classes of its own, other letters share.
SYMBOLS = 64
DIMENSIONS = 1_024
NGRAM = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Characters that are coded, and n-grams that are counted, at a time.
_PART = 1 << 20
#: Cosines of unrelated vectors scatter by 1 / sqrt(DIMENSIONS); a score under three times that fits no learned language.
FLOOR = 3 / DIMENSIONS**0.5


def _class_of(point: int) -> int:
    """Class of a code point: a-z 1 to 26, other letters by remainder, whatever isn't a letter 0."""
    if 0xD800 <= point < 0xE000:
        return 0
    c = chr(point).lower()[:1]
    if not c.isalpha():
        return 0
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + (o * 7) % (SYMBOLS - 27)


@functools.cache
def _table() -> np.ndarray:
    return np.array([_class_of(p) for p in range(0x10000)], np.uint8)


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        values, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_class_of(v) for v in values.tolist()], np.uint8)[at]
    return out


def codes(text: str) -> np.ndarray:
    """Letter classes of a text; runs of other characters are one 0, and a 0 stands at both ends."""
    zero = np.zeros(1, np.uint8)
    out = np.concatenate([zero, *(_classes(text[at : at + _PART]) for at in range(0, len(text), _PART)), zero])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text and their counts."""
    c = codes(text)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, max(0, len(c) - NGRAM + 1), _PART):
        part = c[at : at + _PART + NGRAM - 1].astype(np.int64)
        found, n = np.unique((part[:-2] * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:], return_counts=True)
        if at:
            found, where = np.unique(np.concatenate((keys, found)), return_inverse=True)
            n = np.bincount(where, np.concatenate((counts, n))).astype(np.int64)
        keys, counts = found, n
    return keys, counts


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes: letters rotated by place and multiplied."""
    a, b, c = grams // (SYMBOLS * SYMBOLS), grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


@dataclass
class Profiles:
    """Learned languages, a unit prototype each, and the direction that they share."""

    languages: list[str]
    prototypes: np.ndarray
    shared: np.ndarray
    letters: np.ndarray
    bound: np.ndarray  # vectors of the n-gram codes met in training, by rank in ``grams``
    grams: np.ndarray

    def encode(self, text: str) -> np.ndarray:
        grams, counts = profile(text)
        weight = np.log1p(counts).astype(np.float32)
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        out = weight[known] @ self.bound[at[known]].astype(np.float32)
        if not known.all():
            out += weight[~known] @ gram_vectors(grams[~known], self.letters).astype(np.float32)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        v = self.encode(text)
        v = v / max(float(np.linalg.norm(v)), 1e-9)
        v = v - (v @ self.shared) * self.shared
        cosine = self.prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best])))


def learn(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles of every language in ``lang_col`` of the rows where ``training`` holds; null texts and labels are left out."""
    rows = docs.where(training).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams, counts = profile(text)
                if len(grams):
                    mine = sums.setdefault(lang, np.zeros(SYMBOLS**NGRAM))
                    np.add.at(mine, grams, np.log1p(counts) / np.sqrt((np.log1p(counts) ** 2).sum()))
        for lang, mine in sorted(sums.items()):
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(mine[at])], names=["lang", "gram", "n"])

    # At most languages * SYMBOLS**NGRAM rows, whatever the corpus.
    cells = rows.mapInArrow(run, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    letters = letter_vectors(dimensions)
    label, gram, n = np.array(cells["lang"].to_pylist(), object), cells["gram"].to_numpy(), cells["n"].to_numpy()
    grams = np.unique(gram).astype(np.int64)
    bound = gram_vectors(grams, letters) if len(grams) else np.zeros((0, dimensions), np.int8)
    languages = sorted(set(label.tolist()))
    sums = np.zeros((len(languages), dimensions))
    for i, lang in enumerate(languages):
        mine = label == lang
        at, weight = np.searchsorted(grams, gram[mine]), n[mine]
        for x in range(0, len(at), 4096):
            sums[i] += weight[x : x + 4096] @ bound[at[x : x + 4096]].astype(float)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    shared = np.zeros(dimensions)
    if len(languages) > 1:
        shared = unit.sum(axis=0)
        shared /= max(np.linalg.norm(shared), 1e-9)
        unit = unit - np.outer(unit @ shared, shared)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return Profiles(languages, unit.astype(np.float32), shared.astype(np.float32), letters, bound, grams)


def identify(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; the score is the cosine, 0 where it is negative.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if no language
    was learned; equal cosines go to the language first in the alphabet; an empty table gives an empty result; other
    columns, a language label among them, are never read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Profiles, text_col: str = "text", least: float = FLOOR) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``) or whose score is under ``least``; all columns stay.

    Defined cases: null, empty and letterless texts go; where no language was learned nothing can be told apart, so all
    other texts stay; repeated rows are judged each; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keeps(text: str | None) -> bool:
        if not held.value.languages:
            return bool(text and _LETTER.search(text))
        lang, score = held.value.predict(text)
        return lang != UNKNOWN and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([keeps(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
