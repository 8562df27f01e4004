"""Which frames stand for an event, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration(fps: Column, total_frames: Column) -> Column:
    return F.when(fps > 0, total_frames / fps).otherwise(0.0)


def frames_per_event(start: Column, end: Column, interval: float = 4.0, most: int = 4) -> Column:
    return F.least(F.greatest(F.ceil((end - start) / interval), F.lit(1)), F.lit(most)).cast("int")


def frame_sampling(events: DataFrame, videos: DataFrame, interval: float = 4.0, most: int = 4) -> DataFrame:
    """video_id, event_idx, frame_no, t_sec, frame_id: the middles of equal parts of each event."""
    m = frames_per_event(F.col("start_sec"), F.col("end_sec"), interval, most)
    parts = events.withColumn("m", m).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("frame_no"))
    t = F.col("start_sec") + (F.col("frame_no") + 0.5) * (F.col("end_sec") - F.col("start_sec")) / F.col("m")
    joined = parts.join(videos.select("video_id", "fps", "total_frames"), "video_id").withColumn("t_sec", t)
    return joined.select("video_id", "event_idx", "frame_no", "t_sec", F.least((F.col("t_sec") * F.col("fps")).cast("long"), F.col("total_frames") - 1).alias("frame_id"))


def uniform_sampling(videos: DataFrame, budget: float = 8192, tokens_per_frame: int = 144) -> DataFrame:
    """video_id, frame_no, frame_id: frames spread evenly over a video within the budget (one at least), all if they fit."""
    n = F.least(F.greatest(F.lit(1), F.floor(F.lit(budget) / tokens_per_frame)), F.col("total_frames"))
    rows = videos.filter("total_frames > 0").withColumn("n", n.cast("int"))
    frames = rows.select("video_id", "total_frames", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_no"))
    inner = F.rint((F.col("frame_no") + 1) * (F.col("total_frames") - 1).cast("double") / (F.col("n") + 1)).cast("long")
    return frames.select("video_id", "frame_no", F.when(F.col("n") < F.col("total_frames"), inner).otherwise(F.col("frame_no").cast("long")).alias("frame_id"))


def event_costs(frames: DataFrame, tokens_per_frame: int = 144) -> DataFrame:
    """video_id, event_idx, n_frames, cost."""
    return frames.groupBy("video_id", "event_idx").agg(F.count("*").alias("n_frames")).withColumn("cost", F.col("n_frames") * F.lit(float(tokens_per_frame)))
