"""Semantic edges: an inverted index and a sparse similarity join, or dense matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalised

KEY = ["video_id", "word"]


def postings(words: DataFrame) -> DataFrame:
    """video_id, word, event_idx: each once."""
    return words.select(*KEY, "event_idx").distinct()


def event_frequency(posts: DataFrame) -> DataFrame:
    """video_id, word, n_z: the events that hold a word."""
    return posts.groupBy(*KEY).agg(F.count("*").alias("n_z"))


def retained(frequency: DataFrame, rho: int = 50) -> DataFrame:
    """Words of at most rho events: the others are stop words."""
    return frequency.filter(F.col("n_z") <= rho)


def ief_weights(kept: DataFrame, events: DataFrame, uniform: bool = False) -> DataFrame:
    """video_id, word, n_z, gamma: the log of all events of the video by those that hold the word; 1 in the uniform variant."""
    if uniform:
        return kept.withColumn("gamma", F.lit(1.0))
    n = events.groupBy("video_id").agg(F.count("*").alias("n"))
    return kept.join(n, "video_id").select(*KEY, "n_z", F.ln(F.col("n") / F.col("n_z")).alias("gamma"))


def event_norms(posts: DataFrame, weights: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, event_idx, norm over all retained words, 1 where it is zero."""
    sums = posts.join(weights, KEY).groupBy("video_id", "event_idx").agg(F.sqrt(F.sum(F.col("gamma") * F.col("gamma"))).alias("norm"))
    return events.select("video_id", "event_idx").join(sums, ["video_id", "event_idx"], "left").select("video_id", "event_idx", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))


def sparse_similarity(posts: DataFrame, weights: DataFrame, norms: DataFrame) -> DataFrame:
    """video_id, src, dst, sim over pairs of events at least two apart that share a retained word. A word holds at most
    rho postings, so they are gathered in one row and paired there: one exchange by word, one by pair after partial sums."""
    useful = weights.filter((F.col("n_z") >= 2) & (F.col("gamma") != 0)).select(*KEY, "gamma")
    shares = posts.join(useful, KEY).join(norms, ["video_id", "event_idx"]).select(*KEY, F.struct("event_idx", (F.col("gamma") / F.col("norm")).alias("share")).alias("e"))
    held = shares.groupBy(*KEY).agg(F.array_sort(F.collect_list("e")).alias("es"))
    first = held.select("video_id", "es", F.explode("es").alias("a"))
    pairs = first.select("video_id", "a", F.explode(F.filter("es", lambda b: b.event_idx >= F.col("a.event_idx") + 2)).alias("b"))
    return pairs.groupBy("video_id", F.col("a.event_idx").alias("src"), F.col("b.event_idx").alias("dst")).agg(F.sum(F.col("a.share") * F.col("b.share")).alias("sim"))


def join_stats(weights: DataFrame, pairs: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, posting_visits (of words that join), candidate_pairs, dense_pairs (of all events)."""
    useful = weights.filter((F.col("n_z") >= 2) & (F.col("gamma") != 0))
    visits = useful.groupBy("video_id").agg(F.sum(F.col("n_z") * F.col("n_z")).alias("visits"))
    found = pairs.groupBy("video_id").agg(F.count("*").alias("pairs"))
    dense = events.groupBy("video_id").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return dense.join(visits, "video_id", "left").join(found, "video_id", "left").select("video_id", zero("visits").alias("posting_visits"), zero("pairs").alias("candidate_pairs"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("dense_pairs"))


def global_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with cos, the cosine of the events' global vectors (video_id, event_idx, g), computed at the pairs only."""
    unit = vectors.select("video_id", "event_idx", normalised(F.col("g")).alias("u"))
    ends = pairs.join(unit.withColumnsRenamed({"event_idx": "src", "u": "u_src"}), ["video_id", "src"]).join(unit.withColumnsRenamed({"event_idx": "dst", "u": "u_dst"}), ["video_id", "dst"])
    return ends.withColumn("cos", dot(F.col("u_src"), F.col("u_dst"))).drop("u_src", "u_dst")


def semantic_edges(pairs: DataFrame, vectors: DataFrame, delta: float = 0.65) -> DataFrame:
    """video_id, src, dst, weight: half the sparse similarity and half the cosine, where at least delta (to 9 decimals)."""
    weight = (F.col("sim") + F.col("cos")) / 2
    return global_cosine(pairs, vectors).withColumn("weight", weight).filter(F.round("weight", 9) >= delta).select("video_id", "src", "dst", "weight")


def pairwise_edges(patches: DataFrame, vectors: DataFrame, delta: float = 0.65) -> DataFrame:
    """The same edges by dense matching, for comparison: over all pairs of events of a video at least two apart, the mean
    over the patches of the earlier one of the largest cosine with a patch of the later one (-1 at least).
    patches: video_id, event_idx, patches (normalised arrays)."""
    a, b = patches.alias("a"), patches.alias("b")
    pairs = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.event_idx") + 2 <= F.col("b.event_idx"))).select(F.col("a.video_id").alias("video_id"), F.col("a.event_idx").alias("src"), F.col("b.event_idx").alias("dst"), F.col("a.patches").alias("p"), F.col("b.patches").alias("q"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sim = [float(np.maximum((np.stack(p) @ np.stack(q).T).max(1), -1).mean()) for p, q in zip(rows.p, rows.q)]
            yield rows[["video_id", "src", "dst"]].assign(sim=sim)

    kind = patches.schema["video_id"].dataType.simpleString()
    return semantic_edges(pairs.mapInPandas(match, f"video_id {kind}, src int, dst int, sim double"), vectors, delta)
