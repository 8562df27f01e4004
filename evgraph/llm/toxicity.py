"""Operator 6: toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters to the Latin ones, accents off, lower case, digits and signs inside words to
the letters that they stand for. Entries of the lexicon are beginnings of words; their weights are log odds learned from
labelled rows. A hit inside an exception phrase doesn't count. The sum of the hits, normalised by length, gives a score
through a logistic function fitted on labelled rows that the weights weren't learned from.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fitting import labelled_sample, logistic, sigmoid

# Letters of other scripts that look like Latin ones, and what they stand for.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁɡһқӏвнкмтαβεηικνορτυχωɑı", "aeopcyxijsdghklbhkmtaeeniknoptuxwai"))
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
# Common insults of four languages, which count a little before any label is seen.
SEED_WORDS = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile jerk fool bastard bitch asshole "
    "crétin imbécile connard salaud ordure débile dummkopf arschloch trottel schwachkopf abschaum imbécil estúpido gilipollas escoria"
).split()
# Phrases in which a word of the lexicon is meant otherwise.
EXCEPTIONS = ["clown fish", "trash can", "trash bin", "pond scum", "no fool", "april fool"]

#: Shortest beginning of a word that can be learned, and the longest.
SHORTEST, LONGEST = 4, 12
#: Distinct neighbourhoods in toxic rows that an entry needs (copies of a text share theirs), and its least log odds.
LEAST_CONTEXTS, LEAST_ODDS = 8, 2.5
#: Rows without a toxic label in which a phrase must stand, and none with one, to become an exception.
LEAST_EXCEPTIONS = 3


class _Fold(dict):
    """Folds a character when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        plain = "".join(LOOK_ALIKES.get(x, x) for x in plain)
        value = self[code] = "".join(x if x.isalnum() or x in SUBSTITUTES else " " for x in plain) or ("" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " ")
        return value


_FOLD = _Fold()
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^ ])[013457@$|]+(?=[^\W\d_])|(?<=[^\W\d_])[01345@]+(?= )")
_OUTSIDE = re.compile(r"[@$!|_\d]+")
_TO_LETTERS = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """The words of a text, folded, with a space before and after each."""
    text = f" {text.translate(_FOLD)} "
    text = _INSIDE.sub(lambda m: m[0].translate(_TO_LETTERS), text)
    return " " + " ".join(_OUTSIDE.sub(" ", text).split()) + " "


@dataclass
class Lexicon:
    """Weights of beginnings of words, exception phrases, and the logistic function's factors."""

    entries: dict[str, float]
    exceptions: list[str]
    factors: np.ndarray

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "exceptions": self.exceptions, "factors": self.factors, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                # a 1 has become an i, but can stand for an l
                for spelling in {entry, entry.replace("l", "i")}:
                    key = f" {spelling}"
                    if key not in found or entry == spelling:
                        found.add_word(key, (len(key), weight, False))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
            if not len(found):
                found.add_word("\0", (1, 0.0, False))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def measures(self, text: str) -> tuple[float, float, int]:
        """(sum of the weights of the hits, the same by the root of the number of words, hits)."""
        folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, exception) in self.automaton().iter(folded):
            start = end - size + 1
            if exception:
                spared.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        total, hits = 0.0, 0
        for start, (_, weight) in best.items():
            if not any(a <= start < b for a, b in spared):
                total, hits = total + weight, hits + 1
        return total, total / np.sqrt(folded.count(" ") + 8), hits

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        x = np.array([self.measures(t)[:2] for t in texts]).reshape(-1, 2)
        return sigmoid(_curve(x) @ self.factors[:-1] + self.factors[-1])


def _curve(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(x[:, 0]), x[:, 1]])


def _learn_entries(texts: list[str], y: np.ndarray) -> tuple[dict[str, float], list[str]]:
    names: dict[str, str] = {}  # each word is held once
    folded = [[names.setdefault(w, w) for w in fold(t).split()] for t in texts]
    toxic, n_toxic = [w for w, v in zip(folded, y) if v], int(y.sum())
    clean = [w for w, v in zip(folded, y) if not v]
    n_clean = len(clean)
    seeds = {w for s in SEED_WORDS for w in fold(s).split()}
    around: dict[str, set] = defaultdict(set)
    rows: Counter = Counter()
    for words in toxic:
        own = set()
        for k, word in enumerate(words):
            if len(word) >= SHORTEST:
                context = hash((words[k - 1] if k else "", word, words[k + 1] if k + 1 < len(words) else ""))
                for size in range(SHORTEST, min(len(word), LONGEST) + 1):
                    around[word[:size]].add(context)
                    own.add(word[:size])
        rows.update(own)
    open_ = {p for p, c in around.items() if len(c) >= LEAST_CONTEXTS} | seeds
    del around
    parts: dict[str, list[str]] = {}
    against: Counter = Counter()
    for words in clean:
        own = set()
        for word in set(words):
            if word not in parts:
                parts[word] = [word[:n] for n in range(min(len(word), SHORTEST), min(len(word), LONGEST) + 1) if word[:n] in open_]
            own.update(parts[word])
        against.update(own)

    def odds(p: str) -> float:
        prior = 1.0 if p in seeds else 0.0
        return float(np.log((rows[p] + prior + 0.5) / (n_toxic + 2)) - np.log((against[p] + 0.5) / (n_clean + 2)))

    after: dict[str, set] = defaultdict(set)
    for p in open_:
        after[p[:-1]].add(p[-1])
    found = {p: w for p in open_ if (w := odds(p)) >= LEAST_ODDS or p in seeds and w > 0}
    # a longer beginning stays beside a shorter one only if it is much surer
    entries = {}
    # of beginnings that stand in the same rows, the longest says most
    whole = [p for p in found if p in seeds or not any(rows[p + c] == rows[p] and against[p + c] == against[p] for c in after[p])]
    for p in sorted(whole, key=len):
        shorter = max((entries[p[:n]] for n in range(1, len(p)) if p[:n] in entries), default=None)
        if shorter is None or found[p] > shorter + 0.7:
            entries[p] = found[p]
    # phrases of a hit and a neighbour that stand in rows without a toxic label only
    starts = re.compile("|".join(map(re.escape, sorted(entries, key=len, reverse=True))) or r"(?!)")

    def phrases(words: list[str]) -> set[str]:
        at = [k for k, w in enumerate(words) if starts.match(w)]
        return {" ".join(words[a : a + 2]) for k in at for a in (k - 1, k) if a >= 0 and a + 2 <= len(words)}

    fine: Counter = Counter()
    for words in clean:
        fine.update(phrases(words))
    fine = Counter({p: n for p, n in fine.items() if n >= LEAST_EXCEPTIONS})
    if fine:
        for words in toxic:
            for p in phrases(words):
                fine.pop(p, None)
    return entries, sorted({*fine, *(p for e in EXCEPTIONS if (p := fold(e).strip()))})


def fit(texts: list[str], y: np.ndarray) -> Lexicon:
    """Entries and weights from two thirds of the rows, the logistic function from the others. Without both labels
    (or any rows) only the seed words count, each for itself enough."""
    third = np.arange(len(y)) % 3 == 0
    if len(y) < 30 or len(set(y[third])) < 2 or len(set(y[~third])) < 2:
        return Lexicon({w: 3.0 for s in SEED_WORDS for w in fold(s).split()}, [fold(e).strip() for e in EXCEPTIONS], np.array([2.0, 0.0, -2.0]))
    entries, exceptions = _learn_entries([t for t, x in zip(texts, third) if not x], y[~third])
    found = Lexicon(entries, exceptions, np.zeros(3))
    measured = np.array([found.measures(t)[:2] for t, x in zip(texts, third) if x])
    found.factors = logistic(_curve(measured), y[third], ridge=0.1)
    return found


def fit_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Lexicon:
    return fit(*labelled_sample(docs, labels, "toxic", folds, held_out))


def score(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",), names: tuple[str, str] = ("score", "hits")) -> DataFrame:
    """The columns in keep, with score (0 to 1) and hits under the given names, a row for each row of docs.

    A null text is empty and has the score of a text without hits. Repeated rows give repeated results; other columns
    are ignored. No shuffle; the lexicon is broadcast (bounded by the rows fitted on).
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in common.split_batches(batches):
            x = np.array([model.measures(t) for t in texts]).reshape(-1, 3)
            values = sigmoid(_curve(x) @ model.factors[:-1] + model.factors[-1])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(values), pa.array(x[:, 2].astype(np.int64))], [*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "long")
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for each row of docs, fitted outside the held-out fold. A null doc_id isn't held out."""
    found = score(docs, fit_documents(docs, labels, folds, held_out))
    return found.select("doc_id", F.coalesce(common.crc_of_id() % folds == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "hits")
