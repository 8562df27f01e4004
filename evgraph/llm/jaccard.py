"""Near-duplicates of the pipeline: BK-trees of SimHash fingerprints over five-word shingles, confirmed at a Jaccard similarity of 0.8.

Two texts of that similarity can differ in many bits, so a shard isn't made of the fingerprint's own bands as in operator 8, but
of texts that share a band of MinHash values: of BANDS bands with BAND_ROWS values a pair of 0.8 shares none with a chance
of (1 - 0.8 ** 5) ** 20, about 4 in 10,000. Within a shard a BK-tree gives the fingerprints within RADIUS bits (a pair of 0.8
differs in 10 on the average; beyond 20 lie about 2 in 10,000), of which those of fitting size are candidates. Every candidate
is confirmed exactly by its sets of shingles; the components of confirmed pairs are the groups.

In the shards of the first bands each text is tried with its nearest one only. What that links needs no more links, so a
second pass over all shards tries the candidates whose ends lie in two components, and within a cell none whose ends have
come together meanwhile: groups don't give all their pairs, and no candidate that could join two groups is left out. A cell
is a block of one shard, the home of some texts, whose sets go there once; a text's home is its largest shard. Candidates
are lists at the text that asks them, never a row for each pair, and its set goes to the homes of its list. A shard of more
than TREE_MOST texts is dealt to blocks with a tree each; in the second pass the texts outside its largest component ask in
all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import SEED, BKTree, components, majority, one_row_of_each

SHINGLE_WORDS = 5
#: A similarity of 4 / 5 or more.
LEAST = (4, 5)
RADIUS = 20
BANDS, BAND_ROWS, FIRST_BANDS = 20, 5, 8
#: Texts in a tree, about, and shingles of all texts in a block.
TREE_MOST, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows in a batch, and shingles that are hashed at a time.
BATCH_ROWS, BLOCK = 200, 4096

_DRAW = np.random.default_rng(SEED)
_XOR = _DRAW.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), np.uint64)
_TIMES = _DRAW.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
_MASK = (1 << 64) - 1


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 hashes, in order, of the text's shingles (fewer words: one of them all; none: no shingle)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())), np.uint64, n))


def name_of(found: np.ndarray) -> int:
    """A hash of a set; texts of one set are copies."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values (no shingles: none)."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[first : first + BLOCK] ^ _XOR) * _TIMES).min(1))
    rows = least.reshape(BANDS, -1)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def sizes_fit(a: int, b: int) -> bool:
    """Whether sets of these sizes can have a similarity of LEAST."""
    few, many = LEAST
    return many * min(a, b) >= few * max(a, b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (distinct, in order) have a Jaccard similarity of LEAST or more."""
    few, many = LEAST
    if not sizes_fit(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return many * shared >= few * (len(both) - shared)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the name of the set), sim (the fingerprint), n (shingles), keys (of the bands), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.split_batches(batches):
            fp, sim, n, keys = [], [], [], []
            for text in texts:
                found = shingles(text)
                fp.append(name_of(found))
                sim.append(majority(found))
                n.append(len(found))
                keys.append(bands(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _signed(fp), _signed(sim), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "sim", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, sim long, n int, keys array<long>")


def names(docs: DataFrame, name: str) -> DataFrame:
    """All columns of docs and the name of the row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.split_batches(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, _signed([name_of(shingles(t)) for t in texts])], [*rows.schema.names, name])

    return docs.mapInArrow(run, docs.select("*").schema.add(name, "long"))


def shards(nodes: DataFrame) -> DataFrame:
    """key, band, texts, blocks, block, cell, fp, sim, n: the rows of nodes (fp, sim, n, keys) under each key that several have.
    Large keys are dealt to blocks, in the first pass to others under each key, so that all meet; cells deal alike under
    keys of as many blocks, so that a text's partners have few homes."""
    keyed = nodes.select(F.posexplode("keys").alias("band", "key"), "fp", "sim", "n")
    several = keyed.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("all")).filter("texts > 1")
    blocks = F.ceil(F.greatest(F.col("texts") / TREE_MOST, F.col("all") / BLOCK_SHINGLES)).cast("int")
    # written, so that Spark knows its size when it joins
    several, _ = common.write_work(several.select("key", "texts", blocks.alias("blocks")), "keys")
    block, cell = (F.pmod(F.xxhash64(*by), F.col("blocks")).cast("int") for by in (("key", "fp"), ("fp",)))
    return common.write_work(keyed.join(several, "key").select("key", "band", "texts", "blocks", block.alias("block"), cell.alias("cell"), "fp", "sim", "n"), "shards")[0]


def _by_block(rows: DataFrame, like: DataFrame, *order: str) -> DataFrame:
    """rows by their block; like: a written table of about their size, since Spark overrates what comes from joins."""
    return rows.repartition(*common.more_partitions(like), "key", "block").sortWithinPartitions("key", "block", *order)


_ASKS = "key long, block int, fp long, vs array<long>"


def _batched(found: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[k] for k in kinds]
    while held := list(islice(found, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, BATCH_ROWS).columns))


def first_asks(sharded: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows of _ASKS: each text of the first bands' shards with the nearest of those before it in its tree."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, tree, texts = None, BKTree(RADIUS), []
        for key, block, fp, sim, n in _rows(batches):
            if at != (key, block):
                at, tree, texts = (key, block), BKTree(RADIUS), []
            near = tree.nearest(sim & _MASK, lambda k: sizes_fit(texts[k][1], n), RADIUS // 4)
            if near is not None:
                yield fp, texts[near][0]
            tree.add(sim & _MASK)
            texts.append((fp, n))

    rows = _by_block(sharded.filter(F.col("band") < FIRST_BANDS).select("key", "block", "fp", "sim", "n"), sharded, "fp")
    near = rows.mapInArrow(lambda batches: _batched(pairs(batches), "u long, v long"), "u long, v long").distinct()
    return near.join(homes.withColumnRenamed("fp", "v"), "v").groupBy("key", "block", F.col("u").alias("fp")).agg(F.collect_list("v").alias("vs"))


def cross_asks(sharded: DataFrame, homes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of _ASKS: the candidates of all shards whose ends aren't in one component of roots (fp, root; others are alone)."""
    placed = homes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.col("key").alias("home"), F.col("block").alias("home_block"))
    rooted, _ = common.write_work(sharded.select("key", "blocks", F.col("cell").alias("block"), "fp", "sim", "n").join(placed, "fp"), "rooted")
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("texts"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("texts", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    mixed, _ = common.write_work(mixed.select("key", F.col("most.root").alias("main")), "mixed")
    inside = rooted.join(mixed, "key")
    asked = inside.filter("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["key", "block", "main", "role", "fp", "sim", "n", "root", "home", "home_block"]
    rows = inside.withColumn("role", F.lit(0)).select(*columns).unionByName(asked.withColumn("role", F.lit(1)).select(*columns))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, tree, texts = None, BKTree(RADIUS), []
        for key, block, main, role, fp, sim, n, root, *home in _rows(batches):
            if at != (key, block):
                at, tree, texts = (key, block), BKTree(RADIUS), []
            if role == 0:
                tree.add(sim & _MASK)
                texts.append((fp, n, root, tuple(home)))
                continue
            found: dict[tuple, list[int]] = {}
            for k in tree.near(sim & _MASK):
                v, size, its, where = texts[k]
                # two that ask are tried by the one of the larger name
                if its != root and sizes_fit(size, n) and (its == main or v < fp):
                    found.setdefault(where, []).append(v)
            for where, vs in found.items():
                yield *where, fp, vs

    made = _by_block(rows, rooted, "role", "fp").mapInArrow(lambda batches: _batched(asks(batches), _ASKS), _ASKS)
    # the same candidates come from several shards; a home has a block's texts at most
    return made.groupBy("key", "block", "fp").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"))


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, shingles (bytes) for each of wanted (doc_id, fp: a row of docs that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.split_batches(batches):
            found = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([_signed([name_of(s) for s in found]), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    made = rows.join(ids, rows.doc_id.eqNullSafe(ids._id), "left_semi").select("text").mapInArrow(run, "fp long, shingles binary")
    return made.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def confirmed(asks: DataFrame, homes: DataFrame, roots: DataFrame | None, of: DataFrame) -> DataFrame:
    """u, v: pairs of asks (written rows of _ASKS) whose sets (of: fp, shingles) are similar, enough of them to tie all
    that are, beside what roots (fp, root) ties already. A task holds the sets of a cell's own texts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        at, held, above = None, {}, {}

        def root(k: int) -> int:
            while above.setdefault(k, k) != k:
                k = above[k]
            return k

        for key, block, role, fp, own, vs, found in _rows(batches):
            if at != (key, block):
                at, held, above = (key, block), {}, {}
            found = np.frombuffer(found, np.uint64)
            if role == 0:
                held[fp] = own, found
                continue
            for v in vs:
                its, other = held[v]
                if (a := root(own)) != (b := root(its)) and similar(found, other):
                    above[max(a, b)] = min(a, b)
                    yield max(fp, v), min(fp, v)

    cells = homes.join(asks.select("key", "block").distinct(), ["key", "block"], "left_semi")
    rows = asks.withColumn("role", F.lit(1)).unionByName(cells.withColumns({"vs": F.array().cast("array<long>"), "role": F.lit(0)}))
    rows = rows.withColumn("root", F.col("fp")) if roots is None else rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = rows.join(of, "fp").select("key", "block", "role", "fp", "root", "vs", "shingles")
    return _by_block(rows, of, "role").mapInArrow(lambda batches: _batched(pairs(batches), "u long, v long"), "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the name of the row's set), component_id (the smallest fp reachable), a row for each row of docs.

    Null texts and texts without words are copies of each other. A null doc_id stays null; repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. Copies meet as one set after partial aggregation.
    """
    marked, marked_path = common.write_work(marks(docs), "marks")
    nodes, nodes_path = common.write_work(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("sim").alias("sim"), F.max("n").alias("n"), F.max("keys").alias("keys")), "nodes")
    sharded = shards(nodes)
    homes, _ = common.write_work(sharded.groupBy("fp").agg(F.max(F.struct("texts", "key", "cell")).alias("home")).select("fp", "home.key", F.col("home.cell").alias("block")), "homes")
    of, of_path = common.write_work(sets(docs, nodes.select("doc_id", "fp").join(homes, "fp", "left_semi")), "sets")
    common.drop_folder(docs.sparkSession, nodes_path)
    asks, _ = common.write_work(first_asks(sharded, homes), "asks")
    links, _ = common.write_work(confirmed(asks, homes, None, of), "confirmed")
    tied = components(links)
    roots = tied.unionByName(tied.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    asks, _ = common.write_work(cross_asks(sharded, homes, roots), "asks")
    joined, _ = common.write_work(confirmed(asks, homes, roots, of), "confirmed")
    common.drop_folder(docs.sparkSession, of_path)
    tied = components(tied.unionByName(joined))
    classes, _ = common.write_work(tied.select(F.col("u").alias("fp"), F.col("v").alias("component_id")), "classes")
    found, _ = common.write_work(marked.select("doc_id", "fp").join(classes, "fp", "left").withColumn("component_id", F.coalesce("component_id", "fp")), "found")
    common.drop_folder(docs.sparkSession, marked_path)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the row with the smallest doc_id stays
    (a null doc_id only where the component has no other; of rows with one doc_id and set, one). Names of columns may be any."""
    return one_row_of_each(docs, near_duplicates(docs), names)
