"""Visual words: a codebook for each video, nearest words, spherical k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.vectors import dot, doubles, normalised
from ..sources.work import kept


_PLACE = ["event_idx", "frame_no", "patch_no"]


def packed_codebook(codebook: DataFrame) -> DataFrame:
    """video_id, words: the centroids of a video in one row, bounded by the size of its vocabulary."""
    return codebook.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("word_id", doubles(F.col("centroid")).alias("centroid")))).alias("words"))


#: Largest vocabulary whose dot products are found by column expressions; above it a batch of patches is one matrix
#: product, where the codebooks fit the number of values that may be broadcast (8 bytes each: 64 MB), and values of it that
#: are held at once.
IN_ROW_WORDS, BROADCAST_VALUES, AT_ONCE = 8, 8_000_000, 1 << 20


def quantize(patches: DataFrame, codebook: DataFrame, in_row_words: int = IN_ROW_WORDS, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """video_id, event_idx, frame_no, patch_no, word_id: the word whose centroid has the largest dot product with the normalised
    patch, the lowest one on ties (to 9 decimals) and for a patch that is null or holds null or non-finite values."""
    books = _books(codebook, in_row_words, broadcast_values)
    if books is None:
        return _in_row(patches, codebook).drop("unit")
    shared, names = patches.sparkSession.sparkContext.broadcast(books), ["video_id", *_PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = np.full(rows.num_rows, -1, np.int32)
            for _, ids, at, best, _, _ in _nearest(rows, shared.value):
                words[at] = ids[best]
            found = pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(words)], [*names, "word_id"])
            yield found.filter(pa.array(words >= 0))

    rows = patches.select(*names, doubles(F.col("p")).alias("p"))
    return rows.mapInArrow(run, rows.select(*names).schema.add("word_id", "integer"))


def shape(codebook: DataFrame) -> tuple[int, int]:
    """(words of the largest codebook, values of all)."""
    found = codebook.agg(F.max("word_id").alias("last"), F.sum(F.size("centroid")).alias("values")).first()
    return (found.last + 1, found["values"] or 0) if found.last is not None else (0, 0)


def _in_row(patches: DataFrame, codebook: DataFrame) -> DataFrame:
    """The columns of quantize and unit, the normalised patch, by column expressions."""
    units = patches.select("video_id", *_PLACE, normalised(doubles(F.col("p"))).alias("unit"))
    scored = F.transform("words", lambda w: F.struct(F.round(dot(F.col("unit"), w.centroid), 9).alias("s"), (-w.word_id).alias("k")))
    return units.join(packed_codebook(codebook), "video_id").withColumn("word_id", -F.array_max(scored).k).drop("words")


def _books(codebook: DataFrame, in_row_words: int, broadcast_values: int, known: tuple[int, int] | None = None) -> dict | None:
    """(word_ids in order, centroids) by video_id; None where column expressions are to be used: for few words, for more
    values than may be broadcast, or for centroids without the same number of finite values. known: the codebook's shape."""
    words, values = known or shape(codebook)
    if words <= in_row_words or values > broadcast_values:
        return None
    rows = codebook.filter("video_id is not null").select("video_id", "word_id", doubles(F.col("centroid")).alias("centroid")).toArrow().sort_by([("video_id", "ascending"), ("word_id", "ascending")]).combine_chunks()
    sizes = pc.list_value_length(rows["centroid"]).to_numpy()
    flat = pc.list_flatten(rows["centroid"]).to_numpy()
    if not len(sizes) or not np.all(sizes == sizes[0]) or not sizes[0] or not np.isfinite(flat).all():
        return None
    ids, centroids = rows["word_id"].to_numpy().astype(np.int32), flat.reshape(len(sizes), -1)
    ends = pc.run_end_encode(rows["video_id"].combine_chunks())
    own = zip(ends.values.to_pylist(), ends.run_ends.to_pylist())
    books, first = {}, 0
    for video, end in own:
        books[video], first = (ids[first:end], centroids[first:end]), end
    return books


def _nearest(rows: pa.RecordBatch, books: dict) -> Iterator[tuple]:
    """(video_id, word_ids, rows, place of each one's word, its unit, whether it is whole) over the videos of a batch and
    bounded numbers of rows. A patch that isn't of as many finite values as a centroid is not whole; its unit is zeros."""
    values = rows.column("p").values.to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(rows.column("p")), -1).to_numpy()
    starts = rows.column("p").offsets.to_numpy()[:-1]
    coded = rows.column("video_id").dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy()
    for code, video in enumerate(coded.dictionary.to_pylist()):
        if video not in books:
            continue
        ids, centroids = books[video]
        own, (words, dims) = np.flatnonzero(codes == code), centroids.shape
        step = max(1, AT_ONCE // max(words, dims))
        for first in range(0, len(own), step):
            at = own[first : first + step]
            whole, units = sizes[at] == dims, np.zeros((len(at), dims))
            units[whole] = values[starts[at[whole], None] + np.arange(dims)]
            with np.errstate(invalid="ignore", over="ignore"):
                units /= np.maximum(np.sqrt((units * units).sum(1, keepdims=True)), 1e-12)
            whole &= np.isfinite(units).all(1)
            units[~whole] = 0.0
            yield video, ids, at, np.round(units @ centroids.T, 9).argmax(1), units, whole


def _sums(patches: DataFrame, books: dict) -> DataFrame:
    """video_id, word_id, sum: of the units of each word's whole patches, a row for each word and task."""
    shared = patches.sparkSession.sparkContext.broadcast(books)
    rows = patches.select("video_id", doubles(F.col("p")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, kind = {}, None
        for batch in batches:
            kind = batch.schema.field("video_id").type
            for video, ids, _, best, units, whole in _nearest(batch, shared.value):
                total, there = totals.setdefault(video, (np.zeros((len(ids), units.shape[1])), np.zeros(len(ids), bool)))
                there[best[whole]] = True
                for d in range(units.shape[1]):
                    total[:, d] += np.bincount(best, units[:, d], len(ids))
        for video, (total, there) in totals.items():
            words = shared.value[video][0][there]
            yield pa.RecordBatch.from_arrays([pa.array([video] * len(words), kind), pa.array(words), pa.array(list(total[there]), pa.list_(pa.float64()))], ["video_id", "word_id", "sum"])

    return rows.mapInArrow(run, rows.select("video_id").schema.add("word_id", "integer").add("sum", ArrayType(DoubleType())))


def drawn(patches: DataFrame, seed: str, most: int) -> DataFrame:
    """video_id, number (from 0), unit: so many patches of each video in an order drawn from the seed and their place."""
    draw = F.md5(F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in _PLACE]))
    order = Window.partitionBy("video_id").orderBy("draw", *_PLACE)
    ranked = patches.select("video_id", *_PLACE, draw.alias("draw"), "p").withColumn("number", F.row_number().over(order) - 1).filter(F.col("number") < most)
    return ranked.select("video_id", F.col("number").cast("int").alias("number"), normalised(doubles(F.col("p"))).alias("unit"))


def kmeans_step(patches: DataFrame, codebook: DataFrame, spare: DataFrame | None = None, turn: int = 0, known: tuple[int, int] | None = None) -> DataFrame:
    """video_id, word_id, centroid after one round: the normalised sum of the patches of each word. Words without a patch
    take the video's spare ones (as drawn gives them) in turn, from number `turn` on; without any they keep their
    centroid. One shuffle, of a sum for each word and task."""
    books = _books(codebook, IN_ROW_WORDS, BROADCAST_VALUES, known)
    rows = _in_row(patches, codebook).select("video_id", "word_id", F.col("unit").alias("sum")) if books is None else _sums(patches, books)
    sums = rows.groupBy("video_id", "word_id").agg(Summarizer.sum(array_to_vector("sum")).alias("sum"))
    moved = sums.select("video_id", "word_id", normalised(vector_to_array("sum")).alias("moved"))
    after = codebook.join(moved, ["video_id", "word_id"], "left")
    if spare is None:
        return after.select("video_id", "word_id", F.coalesce("moved", doubles(F.col("centroid"))).alias("centroid"))
    empty = F.row_number().over(Window.partitionBy("video_id", F.col("moved").isNull()).orderBy("word_id")) - 1
    sizes = spare.groupBy("video_id").agg(F.count("*").alias("spares"))
    after = after.join(sizes, "video_id", "left").withColumn("number", F.when(F.col("moved").isNull(), ((empty + turn) % F.col("spares")).cast("int")))
    return after.join(spare, ["video_id", "number"], "left").select("video_id", "word_id", F.coalesce("moved", "unit", doubles(F.col("centroid"))).alias("centroid"))


def first_patches(patches: DataFrame, vocab_size: int) -> DataFrame:
    """A codebook of the patches of each video whose order of (event, frame, patch) comes first."""
    order = Window.partitionBy("video_id").orderBy("event_idx", "frame_no", "patch_no")
    ranked = patches.withColumn("word_id", (F.row_number().over(order) - 1).cast("int")).filter(F.col("word_id") < vocab_size)
    return ranked.select("video_id", "word_id", normalised(doubles(F.col("p"))).alias("centroid"))


def sampled(patches: DataFrame, most: int, seed: str) -> DataFrame:
    """The patches of videos of at most so many; of the others so many, those of the smallest draws, as drawn gives them."""
    draw = F.md5(F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in _PLACE]))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy(draw, *_PLACE))
    return patches.withColumn("_n", number).filter(F.col("_n") <= most).drop("_n")


def visual_vocabulary(patches: DataFrame, vocab_size: int = 1024, iterations: int = 20, sample: int | None = 100_000, seed: int = 0) -> DataFrame:
    """video_id, word_id, centroid by spherical k-means over at most `sample` patches of each video (None: all): from patches drawn from the
    seed, rounds of kmeans_step in which words without a patch take spare ones drawn beforehand. Every video is in each round.
    Centroids of more values than may be broadcast are written to the shared folder in each round, which cuts their lineage."""
    patches = patches.filter(F.exists(doubles(F.col("p")), lambda x: x != 0))
    patches = kept(patches if sample is None else sampled(patches, sample, f"sample-{seed}"), "patches")
    codebook = kept(drawn(patches, f"start-{seed}", vocab_size).select("video_id", F.col("number").alias("word_id"), F.col("unit").alias("centroid")), "codebook")
    spare, known = kept(drawn(patches, f"spare-{seed}", vocab_size), "spare"), shape(codebook)
    books = _books(codebook, IN_ROW_WORDS, BROADCAST_VALUES, known)
    spares = books and _books(spare.withColumnsRenamed({"number": "word_id", "unit": "centroid"}), 0, BROADCAST_VALUES, known)
    if spares:
        return kept(_rounds(patches, books, spares, codebook, iterations), "codebook")
    for k in range(iterations):
        codebook = kept(kmeans_step(patches, codebook, spare, k, known), "codebook")
    return codebook


def _rounds(patches: DataFrame, books: dict, spare: dict, codebook: DataFrame, iterations: int) -> DataFrame:
    """What rounds of kmeans_step make of codebooks that may be broadcast: a round brings back a sum for each word, and the
    next one's centroids are found here instead of in a table."""
    for turn in range(iterations):
        sums = _sums(patches, books).groupBy("video_id", "word_id").agg(Summarizer.sum(array_to_vector("sum")).alias("sum"))
        moved = _books(sums.select("video_id", "word_id", vector_to_array("sum").alias("centroid")), 0, 0, (1, 0)) or {}
        after = {}
        for video, (ids, centroids) in books.items():
            own, total = moved.get(video, (ids[:0], centroids[:0]))
            at = np.searchsorted(ids, own)
            empty = np.setdiff1d(np.arange(len(ids)), at)
            found = np.empty_like(centroids)
            found[at] = total / np.maximum(np.sqrt((total * total).sum(1, keepdims=True)), 1e-12)
            units = spare[video][1]
            found[empty] = units[(np.arange(len(empty)) + turn) % len(units)]
            after[video] = ids, found
        books = after
    kind = codebook.schema["video_id"].dataType.simpleString()
    rows = pa.table({"video_id": [v for v, (ids, _) in books.items() for _ in ids], "word_id": np.concatenate([ids for ids, _ in books.values()]), "centroid": pa.array([c for _, own in books.values() for c in own], pa.list_(pa.float64()))})
    found = codebook.sparkSession.createDataFrame(rows).withColumn("video_id", F.col("video_id").cast(kind))
    return found.unionByName(codebook.filter("video_id is null"))  # no patch is joined to these
