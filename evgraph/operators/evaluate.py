"""Samples into chunks; results into metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept


def chunk_assign(samples: DataFrame, num_chunks: int) -> DataFrame:
    """samples (id, video_path) with position (in the order of path, then id; a null path is empty) and chunk, contiguous
    and of equal size but for the last."""
    size = F.ceil(F.col("total") / num_chunks)
    ordered = ranked(samples.withColumn("_path", F.coalesce("video_path", F.lit(""))), ["_path", "id"], "position").drop("_path")
    total = samples.agg(F.count("*").alias("total"))  # one row
    return ordered.join(F.broadcast(total)).withColumn("chunk", F.floor(F.col("position") / size).cast("int")).drop("total")


def chunk_of(samples: DataFrame, num_chunks: int = 1, chunk_idx: int = 0, max_samples: int | None = None, order: tuple[str, ...] = ("row",)) -> DataFrame:
    """The samples of one chunk: the first max_samples in the order of the file, divided by chunk_assign."""
    taken = samples if max_samples is None else samples.orderBy(*order).limit(max_samples)
    return chunk_assign(taken, num_chunks).filter(F.col("chunk") == chunk_idx)


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in the order of the keys. Ranges of rows are sorted apart and written with the place
    within the range; then only the sizes of the ranges are summed up, so no key's rows need to meet in a task."""
    placed = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # the number of the range is in the upper bits, the place within it in the lower 33
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_at", "_range", "_own", "_before")


def error_records(samples: DataFrame) -> DataFrame:
    """id, error, pred, gt: samples whose video isn't there; they count as wrong."""
    return samples.filter("video_path is null").select("id", F.lit("video not found").alias("error"), F.lit(None).cast("string").alias("pred"), F.col("answer").alias("gt"))


def accuracy(results: DataFrame) -> DataFrame:
    """correct, valid, accuracy over results with a gt; a null pred is wrong."""
    valid = results.filter(F.coalesce("gt", F.lit("")) != "")
    hit = F.sum(F.coalesce(F.col("pred") == F.col("gt"), F.lit(False)).cast("long"))
    return valid.agg(F.coalesce(hit, F.lit(0)).alias("correct"), F.count("*").alias("valid")).withColumn("accuracy", F.col("correct") / F.greatest("valid", F.lit(1)))


def latency_rollup(results: DataFrame) -> DataFrame:
    """avg_tokens, avg_online, avg_offline (of those above 0), errors."""
    return results.agg(F.avg("visual_tokens").alias("avg_tokens"), F.avg("online_time").alias("avg_online"), F.avg(F.nullif("offline_time", F.lit(0.0))).alias("avg_offline"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
