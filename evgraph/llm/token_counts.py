"""Operator 3: token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct ones of a batch are held as one ragged array of symbols. In each round
every sequence that still has a mergeable pair applies its lowest-ranked pair at all its places at once; when no
sequence has one, the surviving symbols are counted. A sequence of many symbols takes many rounds, so it goes by itself
and keeps the places of each rank: a round then looks at what stands beside its merges only.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common
from .tokens import _Index, segment_sums

#: Distinct pre-tokens whose counts a worker keeps; when full, it starts anew.
CACHE_PIECES = 400_000
LIMIT = 512
#: Symbols of a sequence that goes by itself.
LONG = 2048

_NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each of many byte strings."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.width = np.int64(max(vocabulary.values()) + 1)
        pairs = np.array([vocabulary[a] * int(self.width) + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.by_rank = made
        # pairs in an open-addressed table: a lookup is a few gathers, whatever the number of merges
        bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE), np.zeros(1 << bits, np.int64)
        self.probes = 1
        slots = self._slot(pairs)
        for k, (slot, pair) in enumerate(zip(slots.tolist(), pairs.tolist())):
            probe = 1
            while self.keys[slot] != -1 and self.keys[slot] != pair:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.probes = max(self.probes, probe)
            if self.keys[slot] == -1:  # a repeated merge keeps its first rank
                self.keys[slot], self.rank[slot], self.made[slot] = pair, k, made[k]

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or _NONE; slot) of each pair."""
        pairs = left * self.width + right
        slot = self._slot(pairs)
        rank = np.where(self.keys[slot] == pairs, self.rank[slot], _NONE)
        open_ = np.flatnonzero((rank == _NONE) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == pairs[open_]
            rank[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (self.keys[slot[open_]] != -1)]
        return rank, slot

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece (0 of an empty one)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = sizes.copy()
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self.count_long(pieces[k])
        live = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        if not len(live):
            return out
        symbols = self.of_byte[np.frombuffer(b"".join(pieces[k] for k in live), np.uint8)]
        sizes = sizes[live]
        while len(live):
            first = np.cumsum(sizes) - sizes
            inside = np.ones(len(symbols), bool)  # a pair begins here and ends in the same sequence
            inside[first + sizes - 1] = False
            rank = np.full(len(symbols), _NONE)
            at = np.flatnonzero(inside)
            rank[at], slot = self._find(symbols[at], symbols[at + 1])
            lowest = np.minimum.reduceat(rank, first)
            some = lowest < _NONE
            merge = (rank == np.repeat(lowest, sizes)) & (rank < _NONE)
            merge = _leftmost(merge)
            hit = np.flatnonzero(merge)
            slots = np.zeros(len(symbols), np.int64)
            slots[at] = slot
            symbols[hit] = self.made[slots[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            gone = np.add.reduceat(merge.astype(np.int64), first)
            sizes = sizes - gone
            out[live] = sizes
            # sequences without a mergeable pair, or of one symbol, are finished
            on = some & (sizes > 1)
            keep &= np.repeat(on, sizes + gone)
            symbols, live, sizes = symbols[keep], live[on], sizes[on]
        return out


    def count_long(self, piece: bytes) -> int:
        """The same of one long piece."""
        symbols = self.of_byte[np.frombuffer(piece, np.uint8)]
        n, gone = len(symbols), 0
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        rank = np.full(n, _NONE)  # of the pair that begins at a place
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            rank[at] = _NONE
            at = at[after[at] < n]
            found, _ = self._find(symbols[at], symbols[after[at]])
            rank[at] = found
            at, found = at[found < _NONE], found[found < _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            edges = np.flatnonzero(np.diff(found, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = int(found[a])
                if own not in places:
                    places[own] = []
                    heapq.heappush(ranks, own)
                places[own].append(at[a:b])

        look(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(lowest)))
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            # of overlapping places every second one from the left
            joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(joined, 0, number))) % 2 == 0]
            right = after[at]
            behind = after[right]
            symbols[at], rank[right], after[at] = self.by_rank[lowest], _NONE, behind
            before[behind[behind < n]] = at[behind < n]
            gone += len(at)
            ahead = before[at]
            look(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        return n - gone


def _leftmost(merge: np.ndarray) -> np.ndarray:
    """Of overlapping places (a run of one repeated symbol), every second one from the left."""
    at = np.flatnonzero(merge)
    if not len(at) or not (np.diff(at) == 1).any():
        return merge
    start = np.concatenate([[True], np.diff(at) != 1])
    begins = np.repeat(at[start], np.diff(np.concatenate([np.flatnonzero(start), [len(at)]])))
    out = np.zeros_like(merge)
    out[at[(at - begins) % 2 == 0]] = True
    return out


class PieceCounter:
    """count(texts) -> tokens of each text, as the library gives them for a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken  # noqa: F401
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["model"]["merges"]]
        self.merger = RankMerger(model["model"]["vocab"], merges)
        self.added = [t["content"] for t in model["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in model["added_tokens"]) or model["normalizer"]:
            raise ValueError("added tokens that strip, and normalizers, aren't supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path)
        self.alike: dict[str, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.index, self.counts = _Index(), np.zeros(0, np.int64)

    def _split(self, text: str) -> list[str]:
        """Pre-tokens. The library's tables of letters can be older than the regex module's, so where a text has a
        character that the two class differently, the library's own pre-tokenizer splits it."""
        if not text.isascii() and not all(self._same(c) for c in set(_WIDE.findall(text))):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _same(self, c: str) -> bool:
        if c not in self.alike:
            probe = f"a{c}b {c}{c}1{c} . {c}.{c}"
            theirs = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            self.alike[c] = theirs == self.pattern.findall(probe)
        return self.alike[c]

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_PIECES:
            self._clear()
        get, numbers, sizes, extra = self.index.__getitem__, [], [], []
        for text in texts:
            special = 0
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                special = len(parts) // 2
                pieces = [p for part in parts[::2] for p in self._split(part)]
            else:
                pieces = self._split(text)
            sizes.append(len(pieces))
            extra.append(special)
            numbers.append(np.fromiter(map(get, pieces), np.int64, len(pieces)))
        if new := self.index.take():
            self.counts = np.concatenate([self.counts, self.merger.count([p.encode() for p in new])])
        all_ = np.concatenate(numbers or [np.zeros(0, np.int64)])
        return segment_sums(self.counts[all_], np.array(sizes, np.int64)) + np.array(extra, np.int64)


_WIDE = re.compile("[^\x00-՗]")
_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows give repeated results.
    Other columns of docs are ignored. No shuffle; a task holds a batch of about 2 million characters and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for rows, texts in common.split_batches(batches):
            n = count(texts)
            size = pc.fill_null(pc.binary_length(rows.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
