"""Events from cuts: positions at which a sequence is divided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cuts_to_events(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, event_idx, start_sec, end_sec) that divide [0, duration) at cuts (video_id, cut_sec). Repeated cuts count
    once, cuts outside are left out, and a duration of 0 gives no event."""
    inside = cuts.join(videos.select("video_id", "duration"), "video_id").filter((F.col("cut_sec") > 0) & (F.col("cut_sec") < F.col("duration"))).select("video_id", F.col("cut_sec").alias("start_sec"))
    ends = videos.filter("duration > 0").select("video_id", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("start_sec"))
    order = Window.partitionBy("video_id").orderBy("start_sec")
    points = inside.unionByName(ends).distinct()
    paired = points.select("video_id", (F.row_number().over(order) - 1).alias("event_idx"), "start_sec", F.lead("start_sec").over(order).alias("end_sec"))
    return paired.filter("end_sec is not null")


def uniform_windows(videos: DataFrame, window: float = 5.0) -> DataFrame:
    """Events of equal length, the last may be shorter; a duration of 0 or less gives the event (0, 1)."""
    last = F.greatest(F.ceil(F.col("duration") / window), F.lit(1)).cast("int") - 1
    cut = videos.select("video_id", F.when(F.col("duration") > 0, F.col("duration")).otherwise(1.0).alias("duration"), F.when(F.col("duration") > 0, last).otherwise(0).alias("last"))
    return cut.select(
        "video_id",
        F.posexplode(F.sequence(F.lit(0), F.col("last"))).alias("event_idx", "k"), "duration", "last",
    ).select("video_id", "event_idx", (F.col("k") * F.lit(window)).alias("start_sec"), F.when(F.col("k") == F.col("last"), F.col("duration")).otherwise((F.col("k") + 1) * F.lit(window)).alias("end_sec"))


def precomputed_cuts(segments: DataFrame) -> DataFrame:
    """(video_id, cut_sec) from (video_id, segments array<array<double>>): the start of each segment but the first."""
    return segments.select("video_id", F.explode(F.transform(F.slice("segments", 2, F.greatest(F.size("segments"), F.lit(1))), lambda s: s[0])).alias("cut_sec"))


def score_cuts(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(video_id, cut_sec) where a scene begins, other than at the start, from a score for each frame (video_id, frame, score, fps): the first frame below the threshold after one that isn't."""
    before = F.lag("score").over(Window.partitionBy("video_id").orderBy("frame"))
    return scores.withColumn("before", before).filter((F.col("score") < threshold) & (F.col("before") >= threshold)).select("video_id", (F.col("frame") / F.col("fps")).alias("cut_sec"))


#: Segmenters by name: videos (and what a segmenter reads besides) -> events.
SEGMENTERS: dict[str, Callable[..., DataFrame]] = {
    "uniform": lambda videos, **options: uniform_windows(videos, options.get("window", 5.0)),
    "precomputed": lambda videos, segments, **_: cuts_to_events(precomputed_cuts(segments), videos),
    "shots": lambda videos, scores, **options: cuts_to_events(score_cuts(scores, options.get("threshold", 0.5)), videos),
    "content": lambda videos, scores, **options: cuts_to_events(score_cuts(scores.withColumn("score", -F.col("score")), -options.get("threshold", 27.0)), videos),
}


def segment(name: str, videos: DataFrame, **options) -> DataFrame:
    if name not in SEGMENTERS:
        raise ValueError(f"unknown segmenter {name}; there are {', '.join(SEGMENTERS)}")
    return SEGMENTERS[name](videos, **options)
