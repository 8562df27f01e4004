"""Operator 9: quality by Naive Bayes support vectors.

A document is a set of n-grams: of the shapes of its words (runs of letters, digits and signs; whether a word is like
the one before it), up to three in a row, and of its words themselves, all hashed. Indicators are scaled by the class
log-count ratios; a linear hinge-loss model is fitted to them by dual coordinate descent. A logistic function turns its
margins into scores; it is fitted on margins of rows that the model at hand wasn't fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fitting import labelled_sample, logistic, sigmoid
from .tokens import _UNIT, _Index

#: Bits of a hashed n-gram: the model is a number for each of 2**BITS places.
BITS = 18
#: Longest run of shapes.
SHAPES = 3
#: Smoothing of the log-count ratios, cost of the hinge loss, passes over the rows.
SMOOTH, COST, PASSES = 1.0, 1.0, 30
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 250_000

_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "a" if any(map(str.islower, m[0])) else "A"), (re.compile(r"\d+"), "0"), (re.compile(r"\s*\n\s*"), "\n"), (re.compile(r"[^\S\n]+"), " ")]


def shape(unit: str) -> str:
    """Words with a small letter become a, others A, numbers 0; signs stay, at most two alike in a row."""
    for pattern, letter in _RUNS:
        unit = pattern.sub(letter, unit)
    return re.sub(r"(.)\1+", r"\1\1", unit)[:12]


_SMALL = xxhash.xxh64_intdigest(" a", 1)


class Features:
    """of(text): the distinct places of a text's n-grams."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.index, self.size = _Index(), 0
        self.shapes, self.words = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def _learn(self, units: list[str]) -> None:
        while self.size + len(units) > len(self.words):
            self.shapes, self.words = (np.concatenate([x, np.zeros_like(x)]) for x in (self.shapes, self.words))
        to = slice(self.size, self.size + len(units))
        # most words are a space and small letters, whose shape is known without looking further
        shapes = (_SMALL if u[0] == " " and u[1:].isalpha() and u[1:].islower() else xxhash.xxh64_intdigest(shape(u), 1) for u in units)
        self.shapes[to] = np.fromiter(shapes, np.uint64, len(units))
        self.words[to] = np.fromiter((xxhash.xxh64_intdigest(u.strip(), 2) for u in units), np.uint64, len(units))
        self.size += len(units)

    def of(self, text: str) -> np.ndarray:
        units = _UNIT.findall(text)
        if not units:
            return np.zeros(0, np.int64)
        if len(self.index) > CACHE_WORDS:
            self._clear()
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if new := self.index.take():
            self._learn(new)
        same = np.concatenate([[False], at[1:] == at[:-1]])
        tokens = self.shapes[at] + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        grams, run = [self.words[at], tokens], tokens
        for n in range(2, SHAPES + 1):
            run = run[: len(tokens) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + tokens[n - 1 :]
            grams.append(run)
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        places = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        # of equal places the one that was written last stays
        numbers = np.arange(len(places))
        self.last[places] = numbers
        return places[self.last[places] == numbers]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log of the smoothed share of each place in the rows of label 1 to that in those of label 0."""
    size = 1 << BITS
    one, zero = np.full(size, smooth), np.full(size, smooth)
    for x, v in zip(rows, y):
        (one if v else zero)[x] += 1
    return np.log((one / one.sum()) / (zero / zero.sum()))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, constant) of min |w|^2/2 + cost * sum of hinge losses, by dual coordinate descent over the rows. A row is
    its places' ratios, at length 1; the constant is one more component."""
    values = []
    for x in rows:
        v = scale[x]
        size = np.sqrt((v * v).sum()) or 1.0
        values.append(v / size)
    sign = np.where(y > 0, 1.0, -1.0)
    w, constant, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for k in random.permutation(len(rows)):
            x, v = rows[k], values[k]
            gradient = sign[k] * (w[x] @ v + constant) - 1
            after = min(max(alpha[k] - gradient / norm[k], 0.0), cost)
            step = (after - alpha[k]) * sign[k]
            if step:
                w[x] += step * v
                constant += step
                alpha[k] = after
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, float(constant)


@dataclass
class SupportVectors:
    """weights: of each place, before the row is brought to length 1; ratios: for that length."""

    weights: np.ndarray
    ratios: np.ndarray
    constant: float
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> float:
        v = self.ratios[x]
        size = float(np.sqrt((v * v).sum())) or 1.0
        return float(self.weights[x].sum()) / size + self.constant

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.factors[0] * margins + self.factors[1])


def _fit_margin(rows: list[np.ndarray], y: np.ndarray) -> SupportVectors:
    ratios = log_count_ratios(rows, y)
    w, constant = descend(rows, ratios, y)
    return SupportVectors((w * ratios).astype(np.float32), ratios.astype(np.float32), constant, np.array([1.0, 0.0]))


def fit(texts: list[str], y: np.ndarray) -> SupportVectors:
    """The model of all rows; its logistic function from margins of each third by a model of the others. Without both
    labels every score is the share of label 1 (1 without rows)."""
    made = Features()
    rows = [made.of(t) for t in texts]
    fold = np.arange(len(y)) % 3
    if len(y) < 30 or any(len(set(y[fold != k])) < 2 for k in range(3)):
        share = (y.sum() + 1) / (len(y) + 1)
        flat = np.zeros(1 << BITS, np.float32)
        return SupportVectors(flat, flat, 0.0, np.array([0.0, np.log(share / (1 - share + 1e-6))]))
    apart = np.zeros(len(y))
    for k in range(3):
        part = _fit_margin([x for x, f in zip(rows, fold) if f != k], y[fold != k])
        for n in np.flatnonzero(fold == k):
            apart[n] = part.margin(rows[n])
    found = _fit_margin(rows, y)
    found.factors = logistic(apart[:, None], y, ridge=1e-3)
    return found


def fit_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> SupportVectors:
    return fit(*labelled_sample(docs, labels, "quality", folds, held_out))


_FEATURES: list[Features] = []


def score(docs: DataFrame, model: SupportVectors, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns in keep, with score (0 to 1) under the given name, a row for each row of docs.

    A null text is empty; an empty text has no n-grams and the score of the model's constant. Repeated rows give repeated
    results; other columns are ignored. No shuffle; the model is broadcast (2 * 2**BITS numbers).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        if not _FEATURES:
            _FEATURES.append(Features())
        of = _FEATURES[0].of
        for rows, texts in common.split_batches(batches):
            values = found.scores(np.array([found.margin(of(t)) for t in texts]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(values)], [*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for each row of docs, fitted outside the held-out fold. A null doc_id isn't held out."""
    found = score(docs, fit_documents(docs, labels, folds, held_out))
    return found.select("doc_id", F.coalesce(common.crc_of_id() % folds == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
