"""The event graph: adjacency, transitions, reachability."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as a shuffle has: a few bytes of theirs can be much work, so that tasks must not be
    merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def temporal_edges(events: DataFrame) -> DataFrame:
    """video_id, src, dst, weight 1 between consecutive events."""
    after = F.lead("event_idx").over(Window.partitionBy("video_id").orderBy("event_idx"))
    return events.select("video_id", F.col("event_idx").alias("src"), after.alias("dst"), F.lit(1.0).alias("weight")).filter("dst = src + 1")


def adjacency(events: DataFrame, semantic: DataFrame) -> DataFrame:
    return temporal_edges(events).unionByName(semantic.select("video_id", "src", "dst", "weight"))


def transition_matrix(events: DataFrame, edges: DataFrame) -> DataFrame:
    """video_id, src, dst, p: rows of the adjacency at sum 1; an event without a way out leads to itself."""
    nodes = events.select("video_id", F.col("event_idx").alias("src"))
    sinks = nodes.join(edges, ["video_id", "src"], "left_anti").select("video_id", "src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("video_id", "src"))
    return edges.select("video_id", "src", "dst", "weight").unionByName(sinks).select("video_id", "src", "dst", (F.col("weight") / total).alias("p"))


def rounds(alpha: float = 0.15, tolerance: float = 1e-6, most: int = 200) -> int:
    """Rounds after which the largest change is below the tolerance: the last event keeps all it has, so the change of a round is alpha * (1 - alpha)**round whatever the graph."""
    return min(most, math.floor(math.log(tolerance / alpha) / math.log(1 - alpha)) + 1)


#: Sources whose rows one task finds.
SOURCES_A_TASK = 512
#: Sources whose rows are moved on together.
AT_ONCE = 64


def within_reach(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray, steps: int) -> np.ndarray:
    """Whether each of n events is one of the sources or at most so many steps from one."""
    near = np.zeros(n, bool)
    near[sources] = True
    for _ in range(steps):
        before = np.count_nonzero(near)
        near[dst[near[src]]] = True
        if np.count_nonzero(near) == before:
            break
    return near


def ppr(transitions: DataFrame, alpha: float = 0.15, tolerance: float = 1e-6, most: int = 200, sources: int = SOURCES_A_TASK) -> DataFrame:
    """video_id, src, pi: personalised PageRank of each source over the video's events, as an array in order of events.
    The sources of a video are dealt to tasks, each of which holds the video's edges, as lists, and its own rows.
    Sources that move on together do so among the events within their reach; all others stay at 0."""

    def whole(n: int, nodes: np.ndarray, pi: np.ndarray) -> list[np.ndarray]:
        rows = np.zeros((len(pi), n))
        rows[:, nodes] = pi
        return list(rows)

    return _walks(transitions, alpha, tolerance, most, sources, {"pi": ("array<double>", whole)})


def ppr_lists(transitions: DataFrame, alpha: float = 0.15, tolerance: float = 1e-6, most: int = 200, sources: int = SOURCES_A_TASK) -> DataFrame:
    """video_id, src, dst, pi: the rows of ppr as the events above 0, in order, and their values; these grow with what a
    source reaches, not with the video."""

    def events(n: int, nodes: np.ndarray, pi: np.ndarray) -> list[np.ndarray]:
        return [nodes[own > 0].astype(np.int32) for own in pi]

    def values(n: int, nodes: np.ndarray, pi: np.ndarray) -> list[np.ndarray]:
        return [own[own > 0] for own in pi]

    return _walks(transitions, alpha, tolerance, most, sources, {"dst": ("array<int>", events), "pi": ("array<double>", values)})


def _walks(transitions: DataFrame, alpha: float, tolerance: float, most: int, sources: int, columns: dict[str, tuple[str, Callable]]) -> DataFrame:
    """video_id, src and columns (kind, and what makes it of the video's size, the events within reach and the values there
    of some sources, a row for each)."""
    times = rounds(alpha, tolerance, most)
    size = transitions.groupBy("video_id").agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n"))
    parts = size.select("video_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / sources).cast("int"))).alias("part"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        n, first = int(rows.n.iloc[0]), int(rows.part.iloc[0]) * sources
        own = np.arange(first, min(n, first + sources))
        rows = rows.sort_values(["dst", "src"])
        src, p = rows.src.to_numpy(), (1 - alpha) * rows.p.to_numpy()
        dst, out = rows.dst.to_numpy(), {c: [] for c in columns}
        for k in range(0, len(own), AT_ONCE):  # so many columns at a time stay in a core's cache
            near = within_reach(n, src, dst, own[k : k + AT_ONCE], times)
            nodes, inside = np.flatnonzero(near), near[src] & near[dst]
            from_, p_in = np.searchsorted(nodes, src[inside]), p[inside]
            reached, begins = np.unique(np.searchsorted(nodes, dst[inside]), return_index=True)
            at = (np.searchsorted(nodes, own[k : k + AT_ONCE]), np.arange(len(own[k : k + AT_ONCE])))
            pi = np.zeros((len(nodes), len(at[1])))
            pi[at] = alpha
            for _ in range(times):
                after = np.zeros_like(pi)
                if len(begins):
                    after[reached] = np.add.reduceat(pi[from_] * p_in[:, None], begins, axis=0)
                after[at] += alpha
                pi = after
            for c, (_, made) in columns.items():
                out[c] += made(n, nodes, pi.T)
        return pd.DataFrame({"video_id": rows.video_id.iloc[0], "src": own.astype(np.int32), **out})

    kind = transitions.schema["video_id"].dataType.simpleString()
    kinds = "".join(f", {c} {k}" for c, (k, _) in columns.items())
    return spread(transitions.join(parts, "video_id"), "video_id", "part").groupBy("video_id", "part").applyInPandas(one, f"video_id {kind}, src int{kinds}")


def ppr_joined(events: DataFrame, transitions: DataFrame, alpha: float = 0.15, times: int | None = None, cut_every: int = 10) -> DataFrame:
    """The same as (video_id, src, dst, pi) by joins of edge lists, for a graph that no task could hold; lineage is cut by
    tables in the shared folder."""
    start = events.select("video_id", F.col("event_idx").alias("src"), F.col("event_idx").alias("dst"), F.lit(alpha).alias("pi"))
    now = start
    edges = transitions.withColumnsRenamed({"src": "mid", "dst": "to"})
    for k in range(times or rounds(alpha)):
        moved = now.withColumnRenamed("dst", "mid").join(edges, ["video_id", "mid"]).groupBy("video_id", "src", F.col("to").alias("dst")).agg(F.sum((1 - alpha) * F.col("pi") * F.col("p")).alias("pi"))
        now = moved.unionByName(start).groupBy("video_id", "src", "dst").agg(F.sum("pi").alias("pi"))
        if k % cut_every == cut_every - 1:
            now = kept(now, "reach")
    return now


def reach_pairs(reach: DataFrame) -> DataFrame:
    """video_id, src, dst, pi from packed rows, without zeros."""
    return reach.select("video_id", "src", F.posexplode("pi").alias("dst", "pi")).filter("pi > 0")
