"""Operator 10: exact top-k search over a bit-sliced index.

Vectors become integers floor(1024 * x). A segment of candidates keeps, for each component, bitmaps of the bits of its
coarse value (a bitmap has a bit for each candidate). The score of a query is a sum of those bitmaps at the places of
the bits of its own components; it is added up with carry-save steps on whole bitmaps. The rows in front are picked from
the most significant bitmap of the sum downward; what the coarse values leave open is a known interval, and every
row that it lets in is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Candidates in a segment of the index, bits of a component's coarse value.
SEGMENT_ROWS = 65_536
SLICES = 7
#: Queries in a broadcast (8,192 x 64 components x 8 bytes = 4 MB), and broadcasts for which a segment is built once.
QUERY_BLOCK, BLOCKS_A_PASS = 8192, 16
#: Integers from this on could overflow a sum of products; their scores are added without limit and cut to a long. Rows
#: with such a component are kept apart from a segment's bitmaps; queries with one are scored limb by limb.
_LARGE, _LIMB = 1 << 26, 24


def quantised(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, integers) of the vectors that take part: not null, not empty, no null or non-finite component."""
    at, out = [], []
    for k, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.array(v, np.float64)  # None becomes nan
        if not np.isfinite(x).all():
            continue
        scaled = np.floor(SCALE * x)
        at.append(k)
        out.append(scaled.astype(np.int64) if np.abs(scaled).max() < 2.0**62 else np.array([int(y) for y in scaled], object))
    return np.array(at, np.int64), out


def _rows(batch: pa.RecordBatch) -> list:
    """Vectors of a batch, without a Python object for each component where none is null."""
    column = batch.column("embedding")
    if not column.null_count and not column.flatten().null_count:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return column.to_pylist()


class Segment:
    """A bit-sliced index of candidate rows (integers as (row, component))."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: int = SLICES) -> None:
        self.ids, self.values, self.n = ids, values, len(ids)
        self.words = -(-self.n // 64)
        low = values.min(0)
        width = int((values.max(0) - low).max()).bit_length()
        self.shift, self.slices = max(0, width - slices), min(width, slices)
        coarse = (values - low) >> self.shift
        maps = np.zeros((values.shape[1], self.slices, self.words * 64), np.uint8)
        for k in range(self.slices):
            maps[:, k, : self.n] = ((coarse >> k) & 1).T
        packed = np.packbits(maps, axis=2, bitorder="little").view("<u8").reshape(-1, self.words)
        #: Slice k of component d, and after all of these their complements, for negative factors.
        self.maps = np.concatenate([packed, ~packed])
        self.all = self._map(np.ones(self.n, bool))

    def _map(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, bool)
        padded[: self.n] = rows
        return np.packbits(padded, bitorder="little").view("<u8")

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, least significant first, of the sum over components of |q| * (coarse value, or its complement where q is negative)."""
        size, flip = np.abs(query), np.where(query < 0, len(self.maps) // 2, 0)
        bits = int(size.max()).bit_length()
        waiting: list[list[np.ndarray]] = [[] for _ in range(bits + self.slices)]
        for j in range(bits):
            has = np.flatnonzero((size >> j) & 1)
            for k in range(self.slices):
                waiting[j + k].append(has * self.slices + k + flip[has])
        out, carried, place = [], [], 0
        while place < len(waiting) or carried:
            own = [self.maps[np.concatenate(waiting[place])]] if place < len(waiting) and waiting[place] else []
            rows = np.concatenate(own + carried) if own or carried else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(rows) > 2:
                third = len(rows) // 3
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * third :]])
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            place += 1
            if place > 64 + bits:
                raise AssertionError("a sum of bitmaps doesn't end")
            carried = [c for c in carried if place < len(waiting) or c.any()]
        return out

    def front(self, sums: list[np.ndarray], k: int, among: np.ndarray, slack: int) -> np.ndarray:
        """Rows whose sum is at least that of the k-th one minus slack (all, if there are at most k)."""
        if int(np.bitwise_count(among).sum()) <= k:
            return among
        sure, even, least = np.zeros_like(among), among, 0
        for place in range(len(sums) - 1, -1, -1):
            ahead = even & sums[place]
            n = int(np.bitwise_count(sure | ahead).sum())
            if n >= k:
                even = ahead
                least |= 1 << place
                if n == k:
                    break
            else:
                sure, even = sure | ahead, even & ~sums[place]
        least = max(0, least - slack)
        over, even = np.zeros_like(among), among
        for place in range(len(sums) - 1, -1, -1):
            if least >> place & 1:
                even = even & sums[place]
            else:
                over, even = over | (even & sums[place]), even & ~sums[place]
        return over | even

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest scores without rows of the query's id, ties to the smaller id."""
        own = self.ids == query_id
        among = self.all & ~self._map(own) if own.any() else self.all
        if self.slices and query.any() and self.n > k:
            # what the bits below the coarse values can add to one row and take from another, in units of a coarse sum
            slack = (int(np.abs(query).sum()) * ((1 << self.shift) - 1) >> self.shift) + 1
            rows = self.front(self.sums(query), k, among, slack)
        else:
            rows = among
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), count=self.n, bitorder="little"))
        scores = self.values[at] @ query
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def _cut(scores: list[int]) -> np.ndarray:
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores], np.int64)


def wide_scores(values: np.ndarray, query: Sequence[int]) -> np.ndarray:
    """Inner products, cut to a long, of rows of components under _LARGE with a query of integers of any size."""
    signs, rest, total, place = np.array([1 if q >= 0 else -1 for q in query], np.int64), [abs(int(q)) for q in query], 0, 0
    while any(rest):
        limb = np.array([q & (1 << _LIMB) - 1 for q in rest], np.int64) * signs
        total = total + (values @ limb).astype(object) * (1 << place)
        rest, place = [q >> _LIMB for q in rest], place + _LIMB
    return _cut(total) if place else np.zeros(len(values), np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(ids != query_id)
    at = at[np.lexsort((ids[at], ~scores[at]))[:k]]  # the complement falls as the score rises, without overflow
    return ids[at], scores[at]


def _query_blocks(queries: DataFrame, block: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(number, vec_id, integers) of the queries, so many at a time; the driver holds a block and a partition of the query table."""
    held, number = [], 0
    for row in queries.toLocalIterator():
        at, vectors = quantised([row.embedding])
        if len(at):
            held.append((number, row.vec_id, vectors[0]))
            number += 1
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, query_block: int = QUERY_BLOCK, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose vec_id is divisible by `every` the
    k highest integer inner products with rows of other ids, ties to the smaller vec_id.

    Vectors that are null, empty, or hold a null or non-finite component take no part, and neither do rows without a
    vec_id. Vectors of different lengths don't meet. A repeated candidate row counts each time; repeated query rows (same
    id and vector) are one query. The queries, a stated set, are broadcast in blocks of bounded size; a task holds one
    segment of the index and one block at a time, and a pass over the rows answers BLOCKS_A_PASS blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    queries, _ = common.write_work(rows.filter(F.col("vec_id") % every == 0).distinct(), "queries")
    path = common.new_path(spark, "tops")
    schema = "query int, query_id long, vec_id long, score long"

    def search(shared: list):
        def asked() -> Iterator[tuple[int, int, np.ndarray]]:
            for block in shared:
                yield from block.value
                if len(shared) > 1:  # a worker holds one block at a time
                    block.__dict__.pop("_value", None)

        def segment(ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.concatenate(ids)
            large = np.array([v.dtype == object or bool(np.abs(v).max() >= _LARGE) for v in values])
            apart, others = np.flatnonzero(large), np.flatnonzero(~large)
            index = Segment(ids[others], np.array([values[k] for k in others])) if len(others) else None
            size, found = len(values[0]), [[], [], [], []]
            for number, query_id, query in asked():
                if len(query) != size:
                    continue
                near, scores = [], []
                if index is not None:
                    wide = query.dtype == object or bool(np.abs(query).max() >= _LARGE)
                    some = _best(index.ids, wide_scores(index.values, query), query_id, k) if wide else index.top(query_id, query, k)
                    near.append(some[0])
                    scores.append(some[1])
                if len(apart):
                    some = _best(ids[apart], _cut([sum(int(a) * int(b) for a, b in zip(values[r], query)) for r in apart]), query_id, k)
                    near.append(some[0])
                    scores.append(some[1])
                near, scores = np.concatenate(near), np.concatenate(scores)
                for column, value in zip(found, (np.full(len(near), number), np.full(len(near), query_id), near, scores)):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)]), t) for c, t in zip(found, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["query", "query_id", "vec_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list, list]] = {}  # by number of components
            for batch in batches:
                at, some = quantised(_rows(batch))
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[at]
                for size in {len(v) for v in some}:
                    own = [n for n, v in enumerate(some) if len(v) == size]
                    mine = held.setdefault(size, ([], []))
                    mine[0].append(ids[own])
                    mine[1].extend(some[n] for n in own)
                    while len(mine[1]) >= segment_rows:
                        all_ids = np.concatenate(mine[0])
                        yield segment([all_ids[:segment_rows]], mine[1][:segment_rows])
                        mine = held[size] = ([all_ids[segment_rows:]], mine[1][segment_rows:])
            for ids, values in held.values():
                if values:
                    yield segment(ids, values)

        return rows.mapInArrow(run, schema)

    spark.createDataFrame([], schema).write.parquet(path)
    blocks = _query_blocks(queries, query_block)
    while shared := [spark.sparkContext.broadcast(block) for block in islice(blocks, BLOCKS_A_PASS)]:
        search(shared).write.mode("append").parquet(path)
        for block in shared:
            block.unpersist()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
