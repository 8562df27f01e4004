"""Operator 4: byte-level BPE encoding and decoding by the tiktoken library.

Long texts are cut where no match of the pre-split pattern can reach across: between a character that isn't white
space and one that is, else between characters of two kinds. The library sees parts of bounded length, except for a
run without any such place; runs of white space longer than the library's matcher bears are matched here.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Characters after which a text is cut at the next safe place.
PART_CHARS = 16_384

#: Places at which the pre-split pattern always ends a match.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")
#: A run of white space that the library's matcher could recurse on too deeply.
_WIDE_SPACE = re.compile(r"\s{2000,}")


class RankCodec:
    """encode(text) -> ids as the tiktoken library gives them without special tokens; decode(ids) -> bytes."""

    def __init__(self, path: str, pattern: str | None = None, part_chars: int = PART_CHARS) -> None:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.part_chars = regex.compile(pattern), part_chars
        self.size = max(ranks.values()) + 1
        #: Bytes of all tokens in a row, and where each begins.
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, self.size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(k) for k in range(self.size)]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts whose ids in a row are the ids of the text."""
        at, end = 0, len(text)
        while end - at > self.part_chars:
            place = _SAFE.search(text, at + self.part_chars)
            if not place or place.start() >= end:
                break
            yield text[at : place.start()]
            at = place.start()
        yield text[at:]

    def _part(self, part: str) -> list[int]:
        if _WIDE_SPACE.search(part):
            single = self.library._encode_single_piece
            return [i for piece in self.pattern.findall(part) for i in single(piece)]
        return self.library.encode_ordinary(part)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.part_chars:
            return self._part(text)
        return [i for part in self.parts(text) for i in self._part(part)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; they need not be whole characters."""
        at = np.array(ids, np.int64)
        length = self.length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.start[at] - (ends - length), length) + np.arange(total)].tobytes()


_CODECS: dict[str, RankCodec] = {}


def codec(path: str) -> RankCodec:
    if path not in _CODECS:
        _CODECS[path] = RankCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, a row for each row of docs. A null text is empty: no ids. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for rows, texts in common.split_batches(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([encode(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded binary from doc_id, ids array<int> (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([decode(x.as_py() or []) for x in rows.column("ids")], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes): the
    digests of encode_documents and decode_ids, made in one pass so that no ids leave the worker.

    A null text is empty; a null doc_id stays null; repeated rows give repeated results. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        name = code.decimal.__getitem__
        for rows, texts in common.split_batches(batches):
            n, of_ids, of_bytes = [], [], []
            for text in texts:
                ids = code.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
