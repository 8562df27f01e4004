"""Scans of question sets into samples, of boundary files and of videos on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .work import exists

SAMPLE = ["id", "video_path", "question", "options", "answer"]
EXTENSIONS = ("mp4", "mkv", "webm")


def plain_path(path: Column) -> Column:
    """A path without its scheme and doubled slashes, by which listed files and candidates are compared."""
    return F.regexp_replace(F.regexp_replace(path, r"^\w+:(?://[^/]*)?", ""), "//+", "/")


def resolved(samples: DataFrame, existing: DataFrame) -> DataFrame:
    """samples with video_path, the first of their candidates that is among existing (path), else null, for candidates."""
    keyed = samples.select(F.col("candidates").alias("_tried")).distinct().select(F.xxhash64("_tried").alias("id"), F.transform("_tried", plain_path).alias("candidates"), "_tried")
    first = resolve_first(keyed.select("id", "candidates"), existing.select(plain_path(F.col("path")).alias("path")))
    of = keyed.join(first, "id").select("_tried", "video_path")
    return samples.join(of, F.col("candidates") == F.col("_tried"), "left").drop("candidates", "_tried")


def resolve_first(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """id, video_path: of (id, candidates array<string>) the first that is among existing (path), else null."""
    tried = candidates.select("id", F.posexplode("candidates").alias("pos", "path")).join(existing.select("path").distinct(), "path", "left_semi")
    first = tried.groupBy("id").agg(F.min_by("path", "pos").alias("video_path"))
    return candidates.select("id").join(first, "id", "left")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path of the files under root, without their contents (none, if there is no such folder)."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def explode_qa(rows: DataFrame) -> DataFrame:
    """video_id, id, position, question, options, answer from (video_id, mcq): a map of key -> (question, options, answer),
    in the order of the digits in the key (0 without any)."""
    number = F.coalesce(F.expr("try_cast(nullif(regexp_replace(key, '[^0-9]', ''), '') as int)"), F.lit(0))
    asked = rows.select("video_id", F.explode("mcq").alias("key", "qa")).select("video_id", F.concat_ws("_", "video_id", "key").alias("id"), number.alias("position"), "qa")
    return asked.select("video_id", "id", "position", F.col("qa.question").alias("question"), F.col("qa.options").alias("options"), T.first_letter(F.col("qa.answer")).alias("answer"))


def letter_options(options: Column) -> Column:
    """A map of letter -> text as "K. text" in order of the letters."""
    return F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e.key, F.lit(". "), e.value))


def video_mme(spark: SparkSession, root: str, split: str = "test", existing: DataFrame | None = None) -> DataFrame:
    """Samples of one Parquet file of annotations, with row, their place in the file; a video is an mp4 or mkv file in videos."""
    rows = spark.read.parquet(f"{root}/videomme/{split}-00000-of-00001.parquet").withColumn("row", F.monotonically_increasing_id())
    names = F.transform(F.array(F.lit("mp4"), F.lit("mkv")), lambda e: F.concat(F.lit(f"{root}/videos/"), F.col("videoID"), F.lit("."), e))
    samples = rows.select(F.col("question_id").alias("id"), "row", F.col("videoID").alias("video_id"), names.alias("candidates"), "question", "options", "answer", *[c for c in ("duration", "task_type") if c in rows.columns])
    return resolved(samples, listing(spark, f"{root}/videos") if existing is None else existing)


def vr_bench(spark: SparkSession, root: str, existing: DataFrame | None = None) -> DataFrame:
    """Samples of a JSON-lines file, with row, the place of their video in the file; a missing file is an error, blank lines
    and rows without questions are passed over. Options may be a list or a map. A video lies in videos, in videos/v001,
    or at its own video_path."""
    as_list = "struct<video_id:string,video_path:string,mcq:map<string,struct<question:string,options:array<string>,answer:string>>>"
    as_map = as_list.replace("options:array<string>", "options:map<string,string>")
    lines = spark.read.text(f"{root}/VRBench_eval.jsonl").withColumn("row", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    listed, mapped = F.from_json("value", as_list), F.from_json("value", as_map)
    both = lines.select("row", listed.alias("l"), mapped.alias("m"))
    merged = F.transform_values("l.mcq", lambda k, q: F.struct(q.question.alias("question"), F.coalesce(q.options, letter_options(F.try_element_at(F.col("m.mcq"), k).options)).alias("options"), q.answer.alias("answer")))
    rows = both.select("row", F.coalesce("l.video_id", "m.video_id").alias("video_id"), F.coalesce("l.video_path", "m.video_path").alias("own_path"), merged.alias("mcq"))
    own = F.when(F.col("own_path") != "", F.array(F.concat(F.lit(f"{root}/"), "own_path"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.transform(F.array(F.lit("videos"), F.lit("videos/v001")), lambda d: F.concat(F.lit(f"{root}/"), d, F.lit("/"), F.col("video_id"), F.lit(".mp4"))), own)
    asked = explode_qa(rows.filter("mcq is not null")).join(rows.select("video_id", "row", names.alias("candidates")), "video_id")
    return resolved(asked, listing(spark, root) if existing is None else existing)


def cine_pile(rows: DataFrame, split: str = "test", root: str = "") -> DataFrame:
    """Samples of clips (movie_name, yt_clip_title, yt_clip_link, question, choices, answer_key_position, and row, their place
    in the source); fetching clips is left to a step before the scan."""
    title = T.sanitized(F.col("yt_clip_title"))
    path = F.concat(F.lit(f"{root}/yt_videos/"), F.col("movie_name"), F.lit("_"), title, F.lit(".mp4"))
    return rows.select(F.concat(F.lit(f"cinepile_{split}_"), F.col("row").cast("string")).alias("id"), "row", title.alias("video_id"), path.alias("video_path"), F.col("yt_clip_link").alias("url"), "question", F.col("choices").alias("options"), T.letter_code(F.col("answer_key_position").cast("int")).alias("answer"))


def without_failed(clips: DataFrame, failed: DataFrame) -> DataFrame:
    """Clips whose url hasn't failed before."""
    return clips.join(failed.select("url"), "url", "left_anti")


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, segments from a JSON file [[start, end], ...] for each video."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder).select("*", "_metadata.file_path")
    return files.select(T.base_name(F.col("file_path")).alias("video_id"), F.from_json("value", "array<array<double>>").alias("segments"))


DATASETS: dict[str, Callable[..., DataFrame]] = {"videomme": video_mme, "vrbench": vr_bench, "cinepile": cine_pile}
