"""Operator 8: SimHash near-duplicates by BK-trees over shards of the distinct fingerprints.

Fingerprints within 2 bits of each other agree on at least two of four bands. A shard is the fingerprints that share two
of the four 16-bit bands; its BK-tree holds each child under its Hamming distance to the parent, and a search follows only
the edges within the radius. A tree is built where its queries are instead of being broadcast, since the trees of a corpus
grow with it. A shard of more than TREE_MOST fingerprints is dealt again in the same way: what is left of their bits makes
four bands, of which neighbours share two. After the second time a shard shares 56 bits and has 256 members at most, so
every tree is small, whatever the data. Links are stars within a shard, never all pairs; components come from rounds of
large and small stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 2
SEED = 42
SHINGLE_WORDS = 3
#: Fingerprints in one tree at most (never under 256, which a shard can have that isn't dealt any further).
TREE_MOST = 1024
#: Nodes whose links a task ties together before it passes them on, and links in a file of a round.
FOREST_NODES, LINKS_A_FILE = 500_000, 500_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles (repeats included); no words: 0."""
    # bytes.lower and bytes.split know ASCII letters and white space only
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (none: 0)."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for first in range(0, n, 1 << 16):  # a byte for each bit, in bounded blocks
        total += np.unpackbits(hashes[first : first + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns in keep and the fingerprint as a signed long under the given name, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.split_batches(batches):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(fp)], [*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add(name, "long"))


class BKTree:
    """Distinct integers; near(x) gives those within the radius of x."""

    def __init__(self, radius: int = RADIUS) -> None:
        self.radius, self.values, self.children = radius, [], []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            distance = (self.values[at] ^ x).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values) - 1
                return
            at = below

    def near(self, x: int) -> list[int]:
        """Positions, in the order of adding, of the values within the radius."""
        found, open_, radius = [], [0] if self.values else [], self.radius
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ x).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if (below := children.get(edge)) is not None:
                    open_.append(below)
        return found


    def nearest(self, x: int, fits: Callable[[int], bool], enough: int = 0) -> int | None:
        """The position of a value within the radius that fits, the nearest one, or the first that is found within `enough`."""
        best, radius, open_ = None, self.radius, [0] if self.values else []
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ x).bit_count()
            if distance <= radius and fits(at):
                if distance <= enough:
                    return at
                best, radius = at, distance - 1
            children = self.children[at]
            for edge in range(max(0, distance - radius), distance + radius + 1):
                if (below := children.get(edge)) is not None:
                    open_.append(below)
        return best


def stars(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, smallest value of its component) of distinct values linked within the radius, without the smallest ones themselves."""
    values = sorted(values)
    tree, parent = BKTree(radius), list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    mask = (1 << 64) - 1
    for k, x in enumerate(values):
        for other in tree.near(x & mask):
            a, b = root(k), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(x & mask)
    return [(values[k], values[root(k)]) for k in range(len(values)) if root(k) != k]


def _finer(mask: int) -> list[int]:
    """The masks that hold, beside the bits of mask, two of four bands of the others."""
    free = [k for k in range(64) if not mask >> k & 1]
    size = len(free) // 4
    bands = [sum(1 << k for k in free[n * size : (n + 1) * size]) for n in range(4)]
    return [mask | bands[a] | bands[b] for a in range(4) for b in range(a + 1, 4)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Times that large shards are dealt.
LEVELS = 3


def _deal(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows (fp, mask) under the masks finer than their own (one of masks)."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in _finer(m)]))])
    return rows.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))


def links(distinct: DataFrame, tree_most: int = TREE_MOST) -> DataFrame:
    """(u, v), v < u: star links that join all fingerprints fp (distinct, 64-bit) within RADIUS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for fps in batch.column("fps") for pair in stars(fps.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows, masks, found = distinct.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    for level in range(1, LEVELS + 1):
        dealt = _deal(rows, masks).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes, _ = common.write_work(dealt.groupBy("key", "mask").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
        whole = F.col("n") <= tree_most if level < LEVELS else F.lit(True)
        shards = dealt.join(sizes.filter(whole).select("key", "mask"), ["key", "mask"]).groupBy("key", "mask").agg(F.collect_list("fp").alias("fps")).select("fps")
        tied = shards.mapInArrow(run, "u long, v long")
        found = tied if found is None else found.unionByName(tied)
        masks = sorted({f for m in masks for f in _finer(m)})
        if level == LEVELS or not sizes.filter(~whole).limit(1).count():
            break
        rows = dealt.join(sizes.filter(~whole).select("key", "mask"), ["key", "mask"]).select("fp", "mask")
    return found


def forests(edges: DataFrame) -> DataFrame:
    """Links (u, v), v < u, that join what edges do: of each run of rows a forest of stars. Memory: a run's distinct nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (above := parent.setdefault(k, k)) != k:
                parent[k] = k = parent[above]
            return k

        def given() -> pa.RecordBatch:
            found = [(k, r) for k in list(parent) if (r := root(k)) != k]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield given()
                parent.clear()
        if parent:
            yield given()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node of the links but the smallest of a component, with that smallest node. Rounds of large and small
    stars, over forests of the links; a round is written to the shared folder and the one before it dropped. Links that fill
    no file are one forest, without more rounds."""
    spark = edges.sparkSession
    now, path = common.write_work(forests(edges).distinct(), "links")
    size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    for _ in range(most_rounds):
        if not size.n:
            break
        if size.n <= LINKS_A_FILE // 2:
            # a forest of all links has no two roots of a component; they have fewer than FOREST_NODES nodes, so one task holds it
            after, _ = common.write_work(forests(now.coalesce(1)), "links")
            common.drop_folder(spark, path)
            return after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        # few files for few links
        after, next_path = common.write_work(small.coalesce(-(-size.n // LINKS_A_FILE)), "links")
        then = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        common.drop_folder(spark, path)
        now, path = after, next_path
        if then == size:
            return now
        size = then
    else:
        raise RuntimeError("components didn't settle")
    return now


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, tree_most: int = TREE_MOST) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable through fingerprints within RADIUS bits), a row for each row of docs.

    Null texts and texts without words have fingerprint 0 and link like any other. A null doc_id stays null and is never
    a component's id while another doc_id is there. Repeated rows give repeated results. Copies meet as one fingerprint
    after partial aggregation; they are never expanded into pairs.
    """
    marked, _ = common.write_work(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "fingerprints")
    nodes, _ = common.write_work(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    tied = components(links(nodes, tree_most))
    tied = tied.unionByName(tied.select(F.col("v").alias("u"), "v").distinct())
    own = tied.join(nodes, tied.u == nodes.fp).select("fp", "v", "first")
    smallest = own.groupBy("v").agg(F.min("first").alias("component_id"))
    of_linked = own.join(smallest, "v").select("fp", "component_id")
    # written, so that a fingerprint of very many copies can be split in the last join
    of_all, _ = common.write_work(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return marked.join(of_all, "fp").select("doc_id", "fp", "component_id")


def one_row_of_each(docs: DataFrame, classes: DataFrame, mark: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs, all columns, one for each component_id of classes (doc_id, fp, component_id; a row for each row of
    docs): the one with the smallest doc_id (a null doc_id only where the component has no other; of rows with one doc_id
    and fp, one). mark(docs, name) adds fp. Texts are shuffled once, by doc_id; only rows whose doc_id is null or
    repeated are marked again."""
    # nulls last, then the smallest doc_id
    least = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least"))
    stay, _ = common.write_work(least.select(F.col("least.doc_id").alias("doc_id"), F.col("least.fp").alias("fp")), "stay")
    times = classes.groupBy("doc_id").agg(F.count("*").alias("rows"))
    verdicts = times.join(stay.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    unsure = F.col("doc_id").isNull() | (F.col("rows") > 1)
    gone, _ = common.write_work(verdicts.filter(unsure | F.col("_id").isNull()).select("doc_id", unsure.alias("unsure")), "gone")
    own, their = common.fresh(docs, "fp"), common.fresh(docs, "id")
    key = docs["doc_id"].cast("long")
    ids = gone.select(F.col("doc_id").alias(their), "unsure")
    plain = docs.join(ids.select(their), key == F.col(their), "left_anti").filter(docs["doc_id"].isNotNull())
    if not gone.filter("unsure").limit(1).count():
        return plain
    again = mark(docs.join(ids.filter("unsure").select(their), key.eqNullSafe(F.col(their)), "left_semi"), own).dropDuplicates(["doc_id", own])
    chosen = stay.select(F.col("doc_id").alias(their), F.col("fp").alias(f"{own}_"))
    rest = again.join(chosen, again["doc_id"].cast("long").eqNullSafe(F.col(their)) & (F.col(own) == F.col(f"{own}_")), "left_semi")
    return plain.unionByName(rest.select(*docs.columns))


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, tree_most: int = TREE_MOST) -> DataFrame:
    """The rows of docs, all columns, one for each component of near_duplicates. Names of columns may be any."""
    return one_row_of_each(docs, near_duplicates(docs, words, tree_most), lambda rows, name: fingerprints(rows, words, tuple(rows.columns), name))


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
