"""Operator 1: token-id files by static range asymmetric numeral systems.

A file set holds the ids of documents in ascending doc_id order. Its rows are segments: some documents, a frequency
table of all their ids, and blocks of at most BLOCK_TOKENS ids that share this table. A block is encoded and decoded
alone. Its ids are dealt to LANES interleaved coders; CHECK_STEPS steps apart it keeps their states and the place in
the stream, from which decoding can begin. Checksums cover the table, the bytes of a block and its ids. All blocks at
hand, and all their checkpoints, are coded together: a step is a few array operations over every lane.

Order: part, segment, block. Parts are ranges of doc_id, in a folder each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

SCALE_BITS = 20
LANES = 32
BLOCK_TOKENS = 65_536
CHECK_STEPS = 512
#: Ids after which a segment ends with the document at hand.
SEGMENT_TOKENS = 1 << 21

#: Fixed values of the format.
MAGIC = b"RNSB"
_HEAD = struct.Struct("<4sIIHHIII")  # magic, crc of the table, ids, lanes, checkpoints, words, crc of the rest, crc of the ids
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_BITS, _SLOT = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
_MOST = np.uint64(63 - SCALE_BITS)


class FrequencyTable:
    """Frequencies of symbols, scaled to sum to 2**SCALE_BITS, each at least 1."""

    def __init__(self, symbols: np.ndarray, frequency: np.ndarray) -> None:
        self.symbols, self.frequency = symbols.astype(np.uint32), frequency.astype(np.uint32)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.of, self.before = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.of[symbols] = frequency
        self.before[symbols] = np.cumsum(frequency) - frequency
        self.at_slot = np.repeat(self.symbols, self.frequency)
        self.bytes = zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).tobytes() + self.frequency.tobytes(), 6)
        self.crc = zlib.crc32(self.bytes)

    @classmethod
    def of_ids(cls, ids: np.ndarray) -> FrequencyTable:
        counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
        symbols = np.flatnonzero(counts)
        counts, whole = counts[symbols], 1 << SCALE_BITS
        if len(symbols) > whole:
            raise ValueError("more distinct ids than the scale has places")
        if not len(symbols):
            return cls(symbols, counts)
        # one place for each symbol, the others in proportion, what rounding leaves to the commonest
        frequency = 1 + counts * (whole - len(symbols)) // counts.sum()
        frequency[counts.argmax()] += whole - frequency.sum()
        return cls(symbols, frequency)

    @classmethod
    def from_bytes(cls, data: bytes) -> FrequencyTable:
        both = np.frombuffer(zlib.decompress(data), np.uint32)
        return cls(np.cumsum(both[: len(both) // 2], dtype=np.uint32), both[len(both) // 2 :])


def _encode_even(blocks: np.ndarray, table: FrequencyTable) -> list[bytes]:
    """blocks: ids as (block, step, lane)."""
    n, steps, lanes = blocks.shape
    state = np.full((n, lanes), _LOW, np.uint64)
    words, wrote = np.zeros((n, steps, lanes), np.uint32), np.zeros((n, steps, lanes), bool)
    marks = range(0, steps, CHECK_STEPS)
    states = np.zeros((n, len(marks), lanes), np.uint64)
    for step in range(steps - 1, -1, -1):
        symbol = blocks[:, step]
        f = table.of[symbol]
        full = state >= (f << _MOST)
        wrote[:, step] = full
        words[:, step] = state.astype(np.uint32)
        state = np.where(full, state >> _32, state)
        times = state // f
        state = (times << _BITS) + (state - times * f) + table.before[symbol]
        if step % CHECK_STEPS == 0:
            states[:, step // CHECK_STEPS] = state
    out = []
    for k in range(n):
        per_step = wrote[k].sum(1)
        until = np.concatenate([[0], np.cumsum(per_step)])
        rest = until[list(marks)].astype("<u4").tobytes() + states[k].astype("<u8").tobytes() + words[k][wrote[k]].astype("<u4").tobytes()
        out.append((len(marks), int(until[-1]), rest))
    return out


def encode_blocks(ids: np.ndarray, table: FrequencyTable) -> list[bytes]:
    """The blocks of a segment's ids, each decodable alone with the table."""
    ids = np.ascontiguousarray(ids, np.uint32)
    full = len(ids) // BLOCK_TOKENS
    coded = []
    for first in range(0, full, 32):
        some = ids[first * BLOCK_TOKENS : min(full, first + 32) * BLOCK_TOKENS]
        coded += _encode_even(some.reshape(-1, BLOCK_TOKENS // LANES, LANES), table)
    if tail := len(ids) - full * BLOCK_TOKENS:
        steps = -(-tail // LANES)
        padded = np.full(steps * LANES, table.symbols[table.frequency.argmax()], np.uint32)
        padded[:tail] = ids[full * BLOCK_TOKENS :]
        coded += _encode_even(padded.reshape(1, steps, LANES), table)
    out = []
    for k, (marks, words, rest) in enumerate(coded):
        own = ids[k * BLOCK_TOKENS : (k + 1) * BLOCK_TOKENS]
        out.append(_HEAD.pack(MAGIC, table.crc, len(own), LANES, marks, words, zlib.crc32(rest), zlib.crc32(own.astype("<u4").tobytes())) + rest)
    return out


class _Block:
    def __init__(self, data: bytes, table: FrequencyTable) -> None:
        magic, table_crc, self.n, self.lanes, marks, words, crc, self.ids_crc = _HEAD.unpack_from(data)
        rest = memoryview(data)[_HEAD.size :]
        if magic != MAGIC or table_crc != table.crc or zlib.crc32(rest) != crc:
            raise ValueError("damaged block, or a block of another table")
        self.steps = -(-self.n // self.lanes)
        self.places = np.frombuffer(rest, "<u4", marks).astype(np.int64)
        self.states = np.frombuffer(rest, "<u8", marks * self.lanes, 4 * marks).reshape(marks, self.lanes)
        self.words = np.frombuffer(rest, "<u4", words, 4 * marks + 8 * marks * self.lanes)


def _decode_runs(runs: Sequence[tuple[_Block, int]], table: FrequencyTable) -> list[np.ndarray]:
    """ids from each checkpoint (block, number) on to the next one, all decoded together."""
    steps = np.array([min(CHECK_STEPS, b.steps - m * CHECK_STEPS) for b, m in runs])
    order = np.argsort(-steps, kind="stable")
    lanes = runs[0][0].lanes
    state = np.array([runs[k][0].states[runs[k][1]] for k in order], np.uint64).reshape(len(runs), lanes)
    distinct = {id(b): b for b, _ in runs}
    base, at, words = {}, 0, []
    for key, b in distinct.items():
        base[key] = at
        at += len(b.words)
        words.append(b.words)
    words = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    place = np.array([base[id(runs[k][0])] + runs[k][0].places[runs[k][1]] for k in order], np.int64)
    out = np.zeros((steps.max(initial=0), len(runs), lanes), np.uint32)
    ordered = steps[order]
    for step in range(len(out)):
        on = int(np.searchsorted(-ordered, -step))  # runs that still have steps
        x = state[:on]
        slot = x & _SLOT
        symbol = table.at_slot[slot.astype(np.int64)]
        out[step, :on] = symbol
        x = table.of[symbol] * (x >> _BITS) + slot - table.before[symbol]
        low = x < _LOW
        taken = np.cumsum(low, axis=1)
        at = np.where(low, place[:on, None] + taken - 1, len(words) - 1)
        state[:on] = np.where(low, (x << _32) | words[at], x)
        place[:on] += taken[:, -1]
    found = [None] * len(runs)
    for row, k in enumerate(order):
        found[k] = out[: steps[k], row].reshape(-1)
    return found


def decode_blocks(blocks: Sequence[bytes], table: FrequencyTable, at_once: int = 32) -> np.ndarray:
    """ids of blocks in a row; checksums are verified."""
    out = []
    for first in range(0, len(blocks), at_once):
        some = [_Block(data, table) for data in blocks[first : first + at_once]]
        runs = [(b, m) for b in some for m in range(len(b.places))]
        found = iter(_decode_runs(runs, table))
        for b in some:
            ids = np.concatenate([next(found) for _ in b.places])[: b.n]
            if zlib.crc32(ids.astype("<u4").tobytes()) != b.ids_crc:
                raise ValueError("ids don't match their checksum")
            out.append(ids)
    return np.concatenate(out or [np.zeros(0, np.uint32)])


def decode_range(data: bytes, table: FrequencyTable, start: int, stop: int) -> np.ndarray:
    """ids start..stop of one block, from the checkpoints around them only."""
    b = _Block(data, table)
    start, stop = max(0, start), min(stop, b.n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    each = CHECK_STEPS * b.lanes
    marks = range(start // each, (stop - 1) // each + 1)
    ids = np.concatenate(_decode_runs([(b, m) for m in marks], table))
    return ids[start - marks[0] * each : stop - marks[0] * each]


_SEGMENTS = "part int, segment int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, table binary, blocks array<binary>"


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 0) -> None:
    """Writes a file set of the ids of docs (doc_id, text), in ascending doc_id order, at path.

    A null text is empty; end_id, if given, follows each document. Null doc_ids come first; documents with one doc_id
    stand in the order of a hash of their text, repeated rows each stand for themselves. One range shuffle of the
    texts; equal doc_ids don't meet in a task unless their texts are equal too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(vocabulary).encode
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            table = FrequencyTable.of_ids(ids)
            row = [[part], [segment], [first], [len(ids)], [doc_ids], [counts], [table.bytes], [encode_blocks(ids, table)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["part", "segment", "first", "n_tokens", "doc_ids", "doc_tokens", "table", "blocks"])

        for rows in common.sliced_batches(batches):
            ids, count = encode(rows.column("text"))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                count = count + 1
            held.append(ids)
            doc_ids += rows.column("doc_id").to_pylist()
            counts += count.tolist()
            size += len(ids)
            if size >= SEGMENT_TOKENS:
                yield close()
                segment, first, size = segment + 1, first + size, 0
                held, doc_ids, counts = [], [], []
        if doc_ids:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange(*common.more_partitions(docs), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    # already compressed
    ordered.select("doc_id", "text").mapInArrow(run, _SEGMENTS).write.option("compression", "none").partitionBy("part").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids array<int> of a file set at path."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) of a file set."""

    def digest(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        data, begin, out = memoryview(ids.astype("<u4").tobytes()), 0, []
        for end in ends.tolist():
            out.append(zlib.crc32(data[4 * begin : 4 * end]))
            begin = end
        return pa.array(out, pa.int64())

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _read(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # a row for each part: bounded by the number of partitions that wrote the files
    sizes = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                ids = decode_blocks(row["blocks"].as_py(), FrequencyTable.from_bytes(row["table"].as_py()))
                counts = row["doc_tokens"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                start = before[row["part"].as_py()] + row["first"].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start, pa.int64()), pa.array(counts, pa.int64()), last(ids, ends)], names)

    return segments.select("part", "first", "doc_ids", "doc_tokens", "table", "blocks").mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, vocabulary: str, end_id: int | None = 0) -> DataFrame:
    """Writes docs as a file set in the shared work folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = common.new_path(spark, "ids")
    write_ids(docs, vocabulary, path, end_id)
    return read_digests(spark, path)
