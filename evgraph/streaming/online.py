"""Queries that arrive in files, answered as they come over a written index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..params import Params
from ..plans import engine

QUERY = "query_id long, video_id int, q array<double>, question string, options array<string>"


def answer_stream(spark: SparkSession, index_folder: str, queries_folder: str, out_folder: str, checkpoint: str, params: Params, model: str = "stub"):
    """A streaming query: each micro-batch of JSON files in queries_folder is answered over the index and written under its
    number, so that a batch that is run again takes its own place."""
    index = engine.Index.read(spark, index_folder)

    def one(batch: DataFrame, number: int) -> None:
        engine.answer(index, batch, params, model).write.mode("overwrite").parquet(f"{out_folder}/batch={number}")

    stream = spark.readStream.schema(QUERY).json(queries_folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
