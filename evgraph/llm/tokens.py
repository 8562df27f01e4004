"""Token ids by the tokenizers library, computed once for each distinct unit of text.

A unit is a run of white space with the run of other characters after it. A pre-token of a byte-level tokenizer
never goes on from a character that isn't white space to one that is, so the ids of a text are the ids of its units
in a row. Texts with a NUL, which marks the beginning of a text here, or with a character that the library could take
otherwise than Python for white space, go to the library whole. Long texts are cut where a unit ends.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the units and ids that a worker keeps; beyond, those of few uses are dropped.
CACHE_BYTES = 16 << 20
#: Bytes that a unit takes besides its key and ids: a row in four arrays.
_UNIT_BYTES = 13
#: Characters after which a text is cut where a unit ends.
PART_CHARS = 1_000_000

#: Units that go to the library in one call.
RUN_UNITS = 500

_UNIT = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x00\x1c-\x1f]")
#: Places at which any byte-level pre-token and any unit ends.
_BORDER = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def unit_keys(text: str) -> list[str]:
    """The units of a text as keys: what follows a space alone; \\0 before what begins the text; else the unit itself."""
    keys = _UNIT.findall(text)
    if keys and not keys[0][0].isspace():
        keys[0] = "\0" + keys[0]
    return keys


def unit_of_key(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0].isspace() else " " + key


def misplaced(key: str) -> bool:
    """Whether a key of a plain split at spaces and line ends isn't a unit: white space at its ends, or a character that could be."""
    rest = key[1:] if key[:1] in ("\0", "\n") else key
    if not rest:
        return key != "\0"  # alone, it begins a text that is empty or goes on with white space
    return rest[0].isspace() or rest[-1].isspace()


def text_parts(text: str, chars: int = PART_CHARS) -> Iterator[str]:
    """The text in parts whose ids in a row are the ids of the text."""
    at = 0
    while len(text) - at > chars and (place := _BORDER.search(text, at + chars)):
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


class _Index(dict):
    """Numbers keys in the order in which they are first asked for; fresh: those not yet taken."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        self.fresh.append(key)
        return value

    def take(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class UnitEncoder:
    """encode(texts) -> (ids uint32, number of ids of each text); equal to the library's encode_batch without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        #: Added tokens that take white space in, or depend on what stands beside them, can cross units.
        self.crossing = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content)]
        pre = str(type(self.library.pre_tokenizer).__name__)
        self.by_units = pre == "ByteLevel" and self.library.normalizer is None
        self.n_bytes = None
        if self.by_units:  # each letter of a byte-level vocabulary stands for a byte
            words = self.library.get_vocab(with_added_tokens=False)
            self.n_bytes = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
            self.n_bytes[np.fromiter(words.values(), np.int64, len(words))] = np.fromiter(map(len, words), np.int64, len(words))
            for number, token in self.library.get_added_tokens_decoder().items():
                self.n_bytes[number] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self.keys, self.wrong, self.uses = pa.array([], pa.string()), np.zeros(0, bool), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _held(self) -> int:
        return self.keys.nbytes + _UNIT_BYTES * len(self.keys) + 4 * self.used

    def _trim(self) -> None:
        """Keeps the units of the most uses that take half of the room at most."""
        size, least = _UNIT_BYTES + pc.binary_length(self.keys).to_numpy() + 4 * self.count, 2
        while size[self.uses >= least].sum() > CACHE_BYTES // 2:
            least *= 2
        at = np.flatnonzero(self.uses >= least)
        flat = self._gather(at, np.ones(len(at), np.int64))[0]
        self.keys, self.count, self.wrong, self.uses = self.keys.take(pa.array(at)), self.count[at], self.wrong[at], self.uses[at] // 2
        self.flat, self.used, self.first = flat, len(flat), np.cumsum(self.count, dtype=np.int32) - self.count

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _joined(self, units: pa.Array, size: np.ndarray, between: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, count of each) of units that begin with white space (`between` stands before each), encoded in long runs,
        as a call costs more than a unit. The ids' byte lengths show where a unit of so many bytes ends; None if they don't."""
        ends = pa.array(np.append(np.arange(0, len(units), RUN_UNITS), len(units)), pa.int32())
        runs = pc.binary_join(pa.ListArray.from_arrays(ends, units), between).to_pylist()
        ids = np.concatenate([np.array(x, np.uint32) for x in self._library([between + run for run in runs])])
        ends, until = np.cumsum(self.n_bytes[ids]), np.cumsum(size)
        last = np.searchsorted(ends, until, side="right")
        if ends[-1] != until[-1] or (ends[last - 1] != until).any():
            return None
        return ids, np.diff(last, prepend=0)

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library(units)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, keys: pa.Array, plain: bool) -> None:
        """Notes the ids of new keys; plain: they come from a plain split."""
        size = pc.binary_length(keys).to_numpy().astype(np.int64)
        wrong = np.zeros(len(keys), bool)
        # a key without white space in it is a unit after a space
        spaced = (size > 0) & ~pc.match_substring_regex(keys, r"[\s\pZ\pC]").to_numpy(zero_copy_only=False) if plain else np.zeros(len(keys), bool)
        rest = np.flatnonzero(~spaced)
        texts = keys.take(pa.array(rest)).to_pylist()
        units = []
        for k, key in zip(rest.tolist(), texts):
            wrong[k] = misplaced(key)
            units.append("" if wrong[k] and not key[:1].isspace() else unit_of_key(key))
        lines = np.array([plain and not wrong[k] and key[0] == "\n" for k, key in zip(rest.tolist(), texts)], bool)
        groups = [
            (np.flatnonzero(spaced), lambda at: self._joined(keys.take(pa.array(at)), size[at] + 1, " ")),
            (rest[lines], lambda at: self._joined(keys.take(pa.array(at)), size[at], "")),
            (rest[~lines], lambda at: self._alone([unit for unit, line in zip(units, lines) if not line])),
        ]
        count, place, parts, total = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32), [], self.used
        for at, encoded in groups:
            if len(at):
                ids, n = encoded(at) or self._alone([unit_of_key(k) for k in keys.take(pa.array(at)).to_pylist()])
                count[at], place[at] = n, total + np.cumsum(n) - n
                parts.append(ids)
                total += len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(total + total // 4 - self.used, np.uint32)])
        self.flat[self.used : total] = np.concatenate(parts)
        self.keys, self.used = pa.concat_arrays([self.keys, keys]), total
        self.first, self.count = np.concatenate([self.first, place]), np.concatenate([self.count, count])
        self.wrong, self.uses = np.concatenate([self.wrong, wrong]), np.concatenate([self.uses, np.zeros(len(keys), np.int32)])

    def _numbers(self, keys: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each key, the distinct ones among them); new keys are learned."""
        if self._held() > CACHE_BYTES:
            self._trim()
        coded = keys.dictionary_encode()
        distinct = coded.dictionary
        found = pc.index_in(distinct, value_set=self.keys)
        numbers = pc.fill_null(found, -1).to_numpy()
        if found.null_count:
            new = numbers < 0
            numbers = np.where(new, len(self.keys) - 1 + np.cumsum(new), numbers)
            self._learn(distinct.filter(pa.array(new)), plain)
        at = coded.indices.to_numpy()
        self.uses[numbers] += np.bincount(at, minlength=len(numbers)).astype(np.int32)
        return numbers[at], numbers

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        if not self.by_units or self.crossing:
            return self._alone(column.to_pylist())
        size = pc.binary_length(column).to_numpy(zero_copy_only=False)
        apart = set(np.flatnonzero(size > PART_CHARS).tolist()) | set(np.flatnonzero(pc.match_substring_regex(column, _ODD.pattern).to_numpy(zero_copy_only=False)).tolist())
        if not apart:
            return self._split(column)
        # runs of other texts between those that go apart
        parts, counts, first = [], [], 0
        for k in [*sorted(apart), len(column)]:
            if k > first:
                ids, count = self._split(column.slice(first, k - first))
                parts.append(ids)
                counts += count.tolist()
            if k < len(column):
                found = [self._apart(part) for part in text_parts(column[k].as_py())]
                parts += found
                counts.append(sum(map(len, found)))
            first = k + 1
        return np.concatenate(parts), np.array(counts, np.int64)

    def _split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without a character in _ODD: a plain split, looked up once for each distinct key of the batch."""
        keys = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0"), pc.replace_substring(column, "\n", " \n"), pa.scalar("")), " ")
        sizes = np.diff(np.asarray(keys.offsets)).astype(np.int64)
        units, distinct = self._numbers(keys.flatten(), True)
        ids, count = self._gather(units, sizes)
        if self.wrong[distinct].any():
            redo = set(np.flatnonzero(segment_sums(self.wrong[units], sizes)).tolist())
            ends, parts = np.cumsum(count), []
            for k in range(len(sizes)):
                parts.append(self._apart(column[k].as_py()) if k in redo else ids[ends[k] - count[k] : ends[k]])
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, count

    def _apart(self, text: str) -> np.ndarray:
        """ids of a text that a plain split would misplace, or of a part of a long one."""
        if _ODD.search(text):
            return np.array(self._library([text])[0], np.uint32)
        units, _ = self._numbers(pa.array(unit_keys(text), pa.string()), False)
        return self._gather(units, np.array([len(units)]))[0]

    def _gather(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[units]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.first[units] - (ends - count)).astype(np.int32), count)
        at += np.arange(total, dtype=np.int32)
        return self.flat[at], segment_sums(count, sizes)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes (empty runs: 0)."""
    total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
