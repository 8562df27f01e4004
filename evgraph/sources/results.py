"""Result sinks and scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import accuracy, latency_rollup
from .work import drop_folder, exists

RESULT = "id string, pred string, raw_response string, gt string, q string, error string, trace struct<selected:array<int>,records:map<string,string>,verified_edges:array<struct<src:int,dst:int,statement:string>>,rejected_edges:array<struct<src:int,dst:int>>,paths:array<struct<path:array<int>,score:double,answer:string>>,votes:map<string,double>,visual_tokens:double,num_events:int,offline_time:double,online_time:double>"


def write_chunk(results: DataFrame, folder: str, chunk: int) -> None:
    results.write.mode("overwrite").json(f"{folder}/results_chunk{chunk}.json")


def scan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the chunks, without partial files, with the name of their file."""
    rows = spark.read.schema(RESULT).option("recursiveFileLookup", "true").json(folder).select("*", F.col("_metadata.file_path").alias("source"))
    return rows.filter(F.col("source").rlike("_chunk[0-9]+[.]json") & ~F.col("source").contains(".partial"))


def unfinished(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a record yet, so that a run can be taken up again."""
    return samples.join(done.select("id"), "id", "left_anti")


def run_chunk(samples: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, chunk: int, parts: int = 10) -> None:
    """Writes the chunk of answer's records of samples (id, ...), made part by part. Each part is added to a partial file set
    when it is done, so that a run that broke off goes on with the samples that have no record there; at the end
    they become the chunk's file and the partial one goes."""
    spark, partial = samples.sparkSession, f"{folder}/results_chunk{chunk}.partial.json"
    for k in range(parts):
        left = samples.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        if exists(spark, partial):
            left = unfinished(left, spark.read.schema(RESULT).json(partial))
        answer(left).write.mode("append").json(partial)
    write_chunk(spark.read.schema(RESULT).json(partial), folder, chunk)
    drop_folder(spark, partial)


def merge(spark: SparkSession, folder: str) -> DataFrame:
    """Writes merged.json, in order of the files, and returns the metrics, one row."""
    rows = scan_chunks(spark, folder)
    rows.orderBy("source", "id").drop("source").write.mode("overwrite").json(f"{folder}/merged.json")
    flat = rows.select("pred", "gt", "error", F.col("trace.visual_tokens").alias("visual_tokens"), F.col("trace.online_time").alias("online_time"), F.col("trace.offline_time").alias("offline_time"))
    return accuracy(flat).join(F.broadcast(latency_rollup(flat)))  # one row each
