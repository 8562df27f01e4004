"""Corpora derived from the test tables: V from vectors, D from words, T from times, Q from texts.

Each function takes (spark, sf_dir) and covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators import evaluate, execute, features, frames, graph, planner, segment, simjoin, vocabulary
from ..sources.work import kept

#: Parameters on V: the vectors are random, so edges need a lower threshold; the budget is 16 frames.
DELTA, RHO, ALPHA, TOKENS, BUDGET, WORDS = 0.25, 50, 0.15, 144, 2304.0, 64
FPS, HOUR = 25.0, 3_600_000_000.0


#: Tables that queries share, by session, folder and name: an index is built once and read by all that follows.
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, written the first time that it is asked for in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = kept(make(), name)
    return _SHARED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# V


def within(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows (key, order) with rank, their place (from 0) among those of the key; no key's rows need to meet in a task."""
    placed = evaluate.ranked(rows.select(key, order), [key, order], "place")
    first = placed.groupBy(key).agg(F.min("place").alias("first"))
    return placed.join(first, key).select(key, order, (F.col("place") - F.col("first")).cast("int").alias("rank"))


def v_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    ranks = once(spark, sf_dir, "v_ranks", lambda: within(rows, "label", "vec_id")).select("vec_id", "rank")
    return rows.join(ranks, "vec_id").select("vec_id", F.col("label").alias("video_id"), doubles(F.col("embedding")).alias("vec"), "rank")


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_ranked(spark, sf_dir).select("video_id", F.floor(F.col("rank") / 4).cast("int").alias("event_idx"), (F.col("rank") % 4).alias("frame_no"), "vec")


def v_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("vec", k * 8 + 1, 8))
    return v_frames(spark, sf_dir).select("video_id", "event_idx", "frame_no", F.posexplode(slices).alias("patch_no", "p"))


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "v_events", lambda: v_frames(spark, sf_dir).select("video_id", "event_idx").distinct())


def v_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "v_codebook", lambda: vocabulary.first_patches(v_patches(spark, sf_dir), WORDS))


def v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.event_mean_pool(v_frames(spark, sf_dir))


def v_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.quantize(v_patches(spark, sf_dir), v_codebook(spark, sf_dir))


def v_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, weights, norms"""
    words = v_quantized(spark, sf_dir).select("video_id", "event_idx", F.col("word_id").alias("word"))
    return shared_index(spark, sf_dir, "v", words, v_events(spark, sf_dir))


def v_semantic(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    return simjoin.semantic_edges(simjoin.sparse_similarity(*v_index(spark, sf_dir)), v_vectors(spark, sf_dir) if vectors is None else vectors, DELTA)


def v_transitions(spark: SparkSession, sf_dir: str, semantic: DataFrame | None = None) -> DataFrame:
    events = v_events(spark, sf_dir)
    return graph.transition_matrix(events, graph.adjacency(events, v_semantic(spark, sf_dir) if semantic is None else semantic))


def v_reach(spark: SparkSession, sf_dir: str, semantic: DataFrame | None = None) -> DataFrame:
    return graph.ppr(v_transitions(spark, sf_dir, semantic), ALPHA)


def v_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.event_costs(v_frames(spark, sf_dir), TOKENS)


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of a label, asked of the next one."""
    return v_ranked(spark, sf_dir).select(F.col("vec_id").alias("query_id"), ((F.col("video_id") + 1) % 10).alias("video_id"), F.col("vec").alias("q"))


def v_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.relevance(v_queries(spark, sf_dir), v_vectors(spark, sf_dir))


def v_asked(spark: SparkSession, sf_dir: str) -> planner.Asked:
    return planner.Asked(v_queries(spark, sf_dir), v_vectors(spark, sf_dir))


@dataclass
class Run:
    """What the steps of a query share, each written once: edges, reachability, selection, candidates; and what relevance is found from."""

    semantic: DataFrame
    reach: DataFrame
    asked: planner.Asked
    costs: DataFrame
    selected: DataFrame

    @cached_property
    def candidates(self) -> DataFrame:
        return kept(execute.induced_subgraph(self.selected, self.semantic), "candidates")

    @cached_property
    def verified(self) -> DataFrame:
        return kept(execute.verified_edges(self.candidates, replies(self.candidates)), "verified")

    @cached_property
    def retained(self) -> DataFrame:
        return execute.retained_edges(self.selected, self.verified)

    @cached_property
    def paths(self) -> DataFrame:
        return kept(execute.reasoning_paths(self.retained), "paths")


_RUNS: dict[tuple[str, str], Run] = {}


def v_run(spark: SparkSession, sf_dir: str) -> Run:
    """The run over V, once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        vectors = once(spark, sf_dir, "vectors", lambda: v_vectors(spark, sf_dir))
        semantic = once(spark, sf_dir, "semantic", lambda: v_semantic(spark, sf_dir, vectors))
        reach = once(spark, sf_dir, "reach", lambda: graph.ppr_lists(v_transitions(spark, sf_dir, semantic), ALPHA))
        asked, costs = planner.Asked(v_queries(spark, sf_dir), vectors), once(spark, sf_dir, "costs", lambda: v_costs(spark, sf_dir))
        _RUNS[key] = Run(semantic, reach, asked, costs, kept(planner.greedy_select(asked, costs, reach, BUDGET), "selected"))
    return _RUNS[key]


def replies(edges: DataFrame) -> DataFrame:
    """Replies to the verification of edges, by a rule that SQL knows too."""
    k = (F.col("src") * 7 + F.col("dst") * 3 + F.col("query_id")) % 4
    told = F.concat(F.lit("Yes.\nSubject "), (F.col("src") + F.col("dst")).cast("string"), F.lit(" is in both"))
    inline = F.concat(F.lit("yes: subject "), F.col("dst").cast("string"), F.lit(" returns."))
    return edges.select("query_id", "src", "dst", F.when(k == 0, "No, nothing ties them.").when(k == 1, inline).otherwise(told).alias("reply"))


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of V's events, with one decimal."""
    return v_events(spark, sf_dir).select("video_id", "event_idx", (F.col("event_idx") * 25 / 10.0).alias("start_sec"), ((F.col("event_idx") + 1) * 25 / 10.0).alias("end_sec"))


# D


def d_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    ranks = once(spark, sf_dir, "d_ranks", lambda: within(rows, "source", "doc_id")).select("doc_id", "rank")
    return rows.join(ranks, "doc_id").select(F.col("source").alias("video_id"), F.col("rank").alias("event_idx"), "text")


def d_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-zà-ÿ]+")))
    return d_events(spark, sf_dir).select("video_id", "event_idx", words.alias("word")).filter("word <> ''")


def d_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shared_index(spark, sf_dir, "d", d_words(spark, sf_dir), d_events(spark, sf_dir))


def shared_index(spark: SparkSession, sf_dir: str, name: str, words: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """index, its postings and weights written once for each session and folder."""
    posts = once(spark, sf_dir, f"{name}_postings", lambda: simjoin.postings(words))
    weights = once(spark, sf_dir, f"{name}_weights", lambda: simjoin.ief_weights(simjoin.retained(simjoin.event_frequency(posts), RHO), events))
    return posts, weights, simjoin.event_norms(posts, weights, events)


def index(words: DataFrame, events: DataFrame, rho: int = RHO, uniform: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, weights and norms of an event corpus; postings and weights are written once, as all that follows reads them."""
    posts = kept(simjoin.postings(words), "postings")
    weights = kept(simjoin.ief_weights(simjoin.retained(simjoin.event_frequency(posts), rho), events, uniform), "weights")
    return posts, weights, simjoin.event_norms(posts, weights, events)


# T


def t_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users; an hour is a second."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), micros.alias("us"), "event_type", "value")
    first = rows.groupBy("video_id").agg(F.min("us").alias("first"))
    return rows.join(first, "video_id").select("video_id", "event_id", "us", ((F.col("us") - F.col("first")) / HOUR).alias("t"), "event_type", "value")


def t_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t_base(spark, sf_dir).groupBy("video_id").agg(F.max("t").alias("duration")).select("video_id", F.lit(FPS).alias("fps"), F.floor(F.col("duration") * FPS).cast("long").alias("total_frames"), "duration")


def t_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t_base(spark, sf_dir).filter("event_type = 'click'").select("video_id", F.col("t").alias("cut_sec"))


def t_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.cuts_to_events(t_cuts(spark, sf_dir), t_videos(spark, sf_dir))


def t_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with gaps: from each purchase, a second long."""
    rows = t_base(spark, sf_dir).filter("event_type = 'purchase'").groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return rows.select("video_id", F.transform("ts", lambda t: F.array(t, t + 1)).alias("segments"))


def t_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("video_id").orderBy("us", "event_id")) - 1
    return t_base(spark, sf_dir).select("video_id", frame.alias("frame"), F.col("value").alias("score"), F.lit(FPS).alias("fps"))


# Q


def q_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id") * 1000 + F.col("turn")
    letter = F.char(F.lit(65) + number % 4)
    forms = [
        F.concat(F.lit("The answer is "), letter, F.lit(".")), F.concat(F.lit("("), F.lower(letter), F.lit(")")), F.concat(letter, F.lit(". the man")),
        F.lit("A man walks"), F.lit("The answer is because it"), F.lit("it was E."), F.col("text"), F.concat(F.lit("  Option: ("), letter, F.lit(") I think\n")),
    ]
    form = F.element_at(F.array(*forms), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(number.alias("id"), form.alias("reply"))


def q_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    options = F.array(F.concat(F.lit("A. "), role), F.concat(F.lit(" (B) "), role), F.concat(F.lit("c. "), role), F.concat(F.lit("D) "), F.col("turn").cast("string")), F.col("text"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), options.alias("options"))


def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("/videos/"), "source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), path.alias("video_path"), F.char(F.lit(65) + F.col("doc_id") % 4).alias("answer"))


def q_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(F.col("doc_id") % 10 != 0, F.char(F.lit(65) + F.col("quality")))
    gt = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.char(F.lit(65) + F.col("toxic")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), pred.alias("pred"), gt.alias("gt"))


def posting_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capped, uncapped: postings that the sparse join over D visits, with stop words left out and without (one row)."""
    n_z = simjoin.event_frequency(d_index(spark, sf_dir)[0])
    squares = F.col("n_z") * F.col("n_z")
    return n_z.agg(F.sum(F.when(F.col("n_z").between(2, RHO), squares)).alias("capped"), F.sum(squares).alias("uncapped"))
