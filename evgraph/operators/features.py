"""Event features from frame features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, normalised


def event_mean_pool(frames: DataFrame) -> DataFrame:
    """video_id, event_idx, g: the mean of the normalised frame vectors (video_id, event_idx, vec); it isn't normalised again."""
    parts = frames.select("video_id", "event_idx", F.posexplode(normalised(doubles(F.col("vec")))).alias("dim", "x"))
    means = parts.groupBy("video_id", "event_idx", "dim").agg(F.avg("x").alias("x"))
    rows = means.groupBy("video_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("xs"))
    return rows.select("video_id", "event_idx", F.transform("xs", lambda s: s.x).alias("g"))


def event_patches(patches: DataFrame) -> DataFrame:
    """video_id, event_idx, patches: all normalised patches of an event in order of frame and patch."""
    rows = patches.groupBy("video_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct("frame_no", "patch_no", normalised(doubles(F.col("p"))).alias("p")))).alias("ps"))
    return rows.select("video_id", "event_idx", F.transform("ps", lambda s: s.p).alias("patches"))
