"""Compositions: the offline index of a corpus, and queries answered over it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import execute, features, frames, graph, planner, segment, simjoin, vocabulary
from ..params import Params
from ..sources.work import exists, kept, new_path
from . import corpora as C


@dataclass
class Index:
    """What is kept of a corpus: built once, joined by video_id for each query. images, if kept: video_id, event_idx and
    images, an array<binary> of the event's frames."""

    events: DataFrame
    vectors: DataFrame
    semantic: DataFrame
    reach: DataFrame
    costs: DataFrame
    images: DataFrame | None = None

    NAMES = ("events", "vectors", "semantic", "reach", "costs", "images")

    def write(self, folder: str, mode: str = "overwrite") -> None:
        for name in self.NAMES:
            if getattr(self, name) is not None:
                getattr(self, name).write.mode(mode).parquet(f"{folder}/{name}")

    def add(self, folder: str) -> None:
        """Adds the videos that the index in folder doesn't have; those that it has stay as they are."""
        known = self.known(self.events.sparkSession, folder)
        self.without(known).write(folder, "append")

    def without(self, videos: DataFrame) -> Index:
        return Index(*(t and t.join(videos, "video_id", "left_anti") for t in map(self.__dict__.get, self.NAMES)))

    def of(self, videos: DataFrame) -> Index:
        """The index of some videos (video_id)."""
        return Index(*(t and t.join(videos.select("video_id").distinct(), "video_id", "left_semi") for t in map(self.__dict__.get, self.NAMES)))

    @staticmethod
    def known(spark: SparkSession, folder: str) -> DataFrame:
        """The videos of the index in folder, so that only others need be built."""
        return spark.read.parquet(f"{folder}/events").select("video_id").distinct()

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls.NAMES if name != "images" or exists(spark, f"{folder}/images")))


def tokens_per_frame(params: Params, model: str = "stub") -> int:
    return params.tokens_per_frame or models.image_tokens(model, params.frame_size)


def planned_frames(videos: DataFrame, params: Params, **found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, frames) of videos (video_id, fps, total_frames, duration): divided by the segmenter of params, each event with
    its frames to look at (video_id, event_idx, frame_no, t_sec, frame_id). found: segments or scores, if the segmenter
    reads them."""
    options = {"window": params.window, "threshold": params.shot_threshold} if params.segmentation != "content" else {"threshold": params.content_threshold}
    events = segment.segment(params.segmentation, videos, **found, **options)
    return events, frames.frame_sampling(events, videos, params.frame_interval, params.max_frames_per_event)


def index_videos(videos: DataFrame, images: DataFrame, params: Params, encoder: str = "stub", model: str = "stub", **found: DataFrame) -> Index:
    """The index of videos from pictures (video_id, frame_id, image) of their frames: segmentation, sampling, encoding, edges."""
    events, planned = (kept(t, name) for t, name in zip(planned_frames(videos, params, **found), ("events", "planned")))
    seen = planned.join(images, ["video_id", "frame_id"])
    coded = kept(seen.select("video_id", "event_idx", "frame_no", "image", models.encode_images(encoder, F.col("image")).alias("code")), "encoded")
    vectors = coded.select("video_id", "event_idx", "frame_no", F.col("code.vec").alias("vec"))
    patches = coded.select("video_id", "event_idx", "frame_no", F.posexplode("code.patches").alias("patch_no", "p"))
    index = build_index(events, vectors, patches, params, model=model)
    shown = coded.groupBy("video_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct("frame_no", "image"))).alias("rows"))
    index.images = shown.select("video_id", "event_idx", F.col("rows.image").alias("images"))
    return index


def build_index(events: DataFrame, sampled: DataFrame, patches: DataFrame, params: Params, codebook: DataFrame | None = None, model: str = "stub") -> Index:
    """The index of events (video_id, event_idx, start_sec, end_sec) from vectors of sampled frames (video_id, event_idx,
    frame_no, vec) and patches (video_id, event_idx, frame_no, patch_no, p)."""
    vectors = features.event_mean_pool(sampled)
    if params.edge_construction == "pairwise":
        semantic = simjoin.pairwise_edges(features.event_patches(patches), vectors, params.delta)
    elif params.edge_construction == "index":
        codebook = vocabulary.visual_vocabulary(patches, params.vocab_size, params.kmeans_iterations, params.kmeans_sample, params.seed) if codebook is None else codebook
        words = vocabulary.quantize(patches, codebook).select("video_id", "event_idx", F.col("word_id").alias("word"))
        semantic = simjoin.semantic_edges(simjoin.sparse_similarity(*C.index(words, events, params.rho, params.uniform_word_weight)), vectors, params.delta)
    else:
        raise ValueError(f"unknown edge construction {params.edge_construction}")
    reach = graph.ppr_lists(graph.transition_matrix(events, graph.adjacency(events, semantic)), params.alpha, params.ppr_tolerance, params.ppr_rounds)
    return Index(events, vectors, semantic, reach, frames.event_costs(sampled, tokens_per_frame(params, model)))


def select_events(index: Index, queries: DataFrame, params: Params) -> DataFrame:
    """query_id, video_id, event_idx, pick_order: the planner's selection, or the fallback event where it is empty."""
    asked = planner.Asked(queries.select("query_id", "video_id", "q"), index.vectors)
    costs = index.costs.select("video_id", "event_idx", "cost")
    if params.planner == "celf":
        chosen = planner.greedy_select(asked, costs, index.reach, params.token_budget, params.lambda_param, params.use_relevance)
    elif params.planner == "random":
        chosen = planner.random_select(asked, costs, params.token_budget, params.seed)
    else:
        raise ValueError(f"unknown planner {params.planner}")
    chosen = kept(chosen, "chosen")
    spare = planner.fallback_select(asked, costs, chosen, params.token_budget).withColumn("pick_order", F.lit(1))
    return chosen.unionByName(spare)


def answer(index: Index, queries: DataFrame, params: Params, model: str = "stub") -> DataFrame:
    """query_id, pred, score, response, visual_tokens, num_selected, error for queries (query_id, video_id, q, question, options).
    Where a call of the model fails for good, error says how; such a query has no pred, the others go on."""
    asked = queries.select("query_id", T.query_text(F.col("question"), F.col("options")).alias("query"), T.number_of_options(F.col("options")).alias("n_options"))
    selected = kept(select_events(index, queries, params), "selected")
    labels = index.events.select("video_id", "event_idx", T.time_label(F.col("start_sec"), F.col("end_sec")).alias("label"))
    told = selected.join(labels, ["video_id", "event_idx"]).join(index.costs, ["video_id", "event_idx"]).join(asked, "query_id")
    if index.images is not None:
        told = told.join(index.images, ["video_id", "event_idx"], "left")
    else:  # no pictures are kept: as many empty ones
        told = told.withColumn("images", F.array_repeat(F.lit(b""), F.col("n_frames").cast("int")))
    text, failed = F.col("reply.text"), []

    def say(rows: DataFrame, prompt: Column, name: str, images: Column | None = None) -> DataFrame:
        """rows with reply, the model's text; written once."""
        said = kept(rows.withColumn("reply", models.reply(model, prompt, images, params.attempts, params.retry_wait)), name)
        failed.append(said.filter("reply.error is not null").select("query_id", "reply.error"))
        return said.withColumn("reply", text)

    if params.execution == "cot":
        lines = execute.cot_timeline(selected, index.events, index.costs.select("video_id", "event_idx", "n_frames")).join(asked, "query_id")
        shown = told.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "images"))), lambda r: r.images)).alias("images"))
        said = say(lines.join(shown, "query_id").select("query_id", "n_options", "timeline", "query", "images"), T.timeline_prompt(F.col("timeline"), F.col("query")), "replies", F.col("images"))
        found = said.select("query_id", T.extract_answer(F.col("reply"), F.col("n_options")).alias("pred"), F.lit(1.0).alias("score"))
    elif params.execution == "graph":
        records = say(told.select("query_id", "video_id", "event_idx", "label", "query", "images"), T.grounding_prompt(F.col("label"), F.col("query")), "records", F.col("images"))
        records = records.select("query_id", "video_id", "event_idx", "label", T.strip(F.coalesce("reply", F.lit(""))).alias("record"))
        candidates = execute.induced_subgraph(selected, index.semantic)
        a = records.select("query_id", F.col("event_idx").alias("src"), F.col("label").alias("label_a"), F.col("record").alias("a"))
        b = records.select("query_id", F.col("event_idx").alias("dst"), F.col("label").alias("label_b"), F.col("record").alias("b"))
        pairs = candidates.join(a, ["query_id", "src"]).join(b, ["query_id", "dst"]).join(asked, "query_id")
        said = say(pairs, T.verification_prompt(F.col("label_a"), F.col("a"), F.col("label_b"), F.col("b"), F.col("query")), "verification")
        verified = execute.verified_edges(candidates, said.select("query_id", "src", "dst", "reply"))
        paths = execute.reasoning_paths(execute.retained_edges(selected, verified), params.max_paths, params.max_path_enum)
        paths = kept(paths.unionByName(execute.fallback_path(selected, paths)), "paths")
        context = execute.path_context(paths, records.select("query_id", "event_idx", "record"), verified, index.events).join(asked, "query_id")
        replies = say(context.select("query_id", "rank", "n_options", "context", "query"), T.synthesis_prompt(F.col("context"), F.col("query")), "answers")
        heard = replies.select("query_id", "rank", T.extract_answer(F.col("reply"), F.col("n_options")).alias("answer"))
        found = execute.weighted_vote(paths.join(heard, ["query_id", "rank"]))
    else:
        raise ValueError(f"unknown execution {params.execution}")
    spent = planner.selection_cost(selected, index.costs.select("video_id", "event_idx", "cost"))
    out = queries.select("query_id").join(found, "query_id", "left").join(spent, "query_id", "left")
    return _with_errors(out, failed)


def _with_errors(answered: DataFrame, failed: list[DataFrame]) -> DataFrame:
    """answered with error, the first in the order of texts of the failed ones (query_id, error); with it no pred."""
    errors = functools.reduce(DataFrame.unionByName, failed).groupBy("query_id").agg(F.min("error").alias("error"))
    out = answered.join(errors, "query_id", "left")
    out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("pred", "score")})
    return out.withColumn("response", T.final_response(F.col("pred")))


def answer_uniformly(videos: DataFrame, queries: DataFrame, params: Params, model: str = "stub", images: DataFrame | None = None) -> DataFrame:
    """The same columns by the plain method: frames spread evenly over the video within the budget, shown in one call.
    videos: video_id, total_frames; images, if there are any: video_id, frame_id, image."""
    tokens = tokens_per_frame(params, model)
    taken = frames.uniform_sampling(videos.select("video_id", "total_frames"), params.token_budget, tokens)
    taken = taken.join(images, ["video_id", "frame_id"]) if images is not None else taken.withColumn("image", F.lit(b""))
    shown = taken.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "image"))).alias("rows"))
    asked = queries.select("query_id", "video_id", T.query_text(F.col("question"), F.col("options")).alias("query"), T.number_of_options(F.col("options")).alias("n_options"))
    rows = asked.join(shown.select("video_id", F.col("rows.image").alias("images")), "video_id")
    said = kept(rows.withColumn("reply", models.reply(model, T.direct_prompt(F.col("query")), F.col("images"), params.attempts, params.retry_wait)), "replies")
    found = said.select("query_id", T.extract_answer(F.col("reply.text"), F.col("n_options")).alias("pred"), F.lit(1.0).alias("score"), (F.size("images") * F.lit(float(tokens))).alias("visual_tokens"), F.size("images").cast("long").alias("num_selected"))
    return _with_errors(queries.select("query_id").join(found, "query_id", "left"), [said.filter("reply.error is not null").select("query_id", "reply.error")])


#: Methods by name: what they answer over, queries, params, model -> answers.
METHODS = {"graph": answer, "uniform": answer_uniformly}


def with_query_vectors(queries: DataFrame, encoder: str = "stub") -> DataFrame:
    """queries with q, the encoder's vector of question and options."""
    return queries.withColumn("q", models.encode_text(encoder, T.query_text(F.col("question"), F.col("options"))))


#: The parameters for the corpus of vectors; its vocabulary is learned from all patches, as its SQL does.
VECTORS = Params(delta=C.DELTA, token_budget=C.BUDGET, vocab_size=C.WORDS, kmeans_sample=None)


def vector_index(spark: SparkSession, sf_dir: str, params: Params = VECTORS) -> Index:
    return build_index(C.clock(spark, sf_dir), C.v_frames(spark, sf_dir), C.v_patches(spark, sf_dir), params)


OPTIONS = ["a man", "a door", "a car", "a dog"]


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.v_queries(spark, sf_dir).withColumns({"question": F.concat(F.lit("What follows vector "), F.col("query_id").cast("string"), F.lit("?")), "options": F.array(*map(F.lit, OPTIONS))})


def answers_on_vectors(spark: SparkSession, sf_dir: str, params: Params = VECTORS, model: str = "stub") -> DataFrame:
    """The vector corpus indexed once, its vocabulary learned, and all its queries answered."""
    folder = new_path(spark, "index")
    vector_index(spark, sf_dir, params).write(folder)
    found = answer(Index.read(spark, folder), vector_queries(spark, sf_dir), params, model)
    return found.select("query_id", "pred", F.round("score", 6).alias("score"), "response", "visual_tokens", "num_selected")
