"""Operator 5: best-fit packing planned over a histogram of lengths.

Documents become pieces of at most MAX_TOKENS ids. The plan is made on the driver from the number of pieces of each
length alone (MAX_TOKENS numbers), so that its size doesn't depend on the number of documents: sequences with equal
room left are one group, and whole groups are filled at a time. Pieces are ranked within their length without meeting
in a task (rank within a partition plus the counts of the partitions before it) and take the place planned for the rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAX_TOKENS = 1024

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"


def plan(histogram: dict[int, int], room: int = MAX_TOKENS) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): pieces of this length of these ranks go, one each, to
    consecutive sequences, at this offset. Longest lengths first, each into the fullest sequences that have room for it,
    else into new ones."""
    left: dict[int, list[list[int]]] = {}  # room left -> groups [first sequence, sequences]
    rooms: list[int] = []  # its keys, ascending
    rows, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space:
            if space not in left:
                left[space] = []
                bisect.insort(rooms, space)
            left[space].append([first, n])

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} ids doesn't fit into {room}")
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = room // length
                fresh = n // each or 1
                put(room, sequences, fresh)
                sequences += fresh
                continue
            space = rooms[at]
            first, many = left[space].pop()
            if not left[space]:
                del left[space], rooms[at]
            # one sequence after another is filled with as many as go in; the last may get fewer
            deep = min(n, space // length)
            take = min(many, n // deep)
            rows += [(length, rank + k * take, take, first, room - space + k * length) for k in range(deep)]
            put(space - deep * length, first, take)
            if take < many:
                put(space, first + take, many - take)
            n, rank = n - deep * take, rank + deep * take
    return np.array(rows, np.int64).reshape(-1, 5)


def cuts(count: np.ndarray, room: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of count ids: only a longer one is cut, its first piece
    is the shorter."""
    first = np.where(count <= room, count, (count - 1) % room + 1)
    n = np.where(count > 0, 1 + (count - first) // room, 0)
    of = np.repeat(np.arange(len(count)), n)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece > 0, first[of] + (piece - 1) * room, 0)
    return of, piece, start, np.where(piece > 0, room, first[of])


def cut(count: int, room: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of count ids."""
    _, _, start, length = cuts(np.array([count]), room)
    return list(zip(start.tolist(), length.tolist()))


def places(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each piece among those of its length, those in seen (counts by length) before it; adds them to seen."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    n = np.bincount(length, minlength=len(seen))
    place = np.empty(len(length), np.int64)
    place[order] = np.arange(len(length)) - (np.cumsum(n) - n)[ordered] + seen[ordered]
    seen += n
    return place


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, room: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task), place (rank among the task's pieces of this length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        for rows in common.sliced_batches(batches):
            ids, count = encode(rows.column("text"))
            ids, count = np.insert(ids, np.cumsum(count), np.uint32(end_id)), count + 1
            of, piece, start, length = cuts(count, room)
            data, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * ((np.cumsum(count) - count)[of] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
            columns = [rows.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(of), part), pa.int32()), pa.array(places(length, seen))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, room: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece of docs (doc_id, text).

    A null text is empty and still a piece, of end_id alone; a null doc_id stays null; repeated rows are packed each for
    itself; an empty table gives no rows. Equal lengths are ranked in the order of the tasks that read them. The pieces
    are written once to the shared folder, so that ranks stand whatever is run again. Both joins have a small side that
    the corpus doesn't widen: a row for each task and length, and the plan.
    """
    spark = docs.sparkSession
    found, _ = common.write_work(pieces(docs, vocabulary, end_id, room), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    planned = plan(histogram, room)
    slots = spark.createDataFrame(pa.Table.from_arrays([pa.array(planned[:, k]) for k in range(5)], ["of_length", "from_rank", "ranks", "from_sequence", "offset"]))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    inside = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("ranks"))
    taken = ranked.join(F.broadcast(slots), inside)
    return taken.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("from_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
