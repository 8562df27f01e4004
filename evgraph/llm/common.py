"""Shared pieces: work tables in the cluster's shared folder, batches of texts, a hash of doc_id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import drop_folder, new_path, work_folder, write_work  # noqa: F401

#: Bytes of text in a batch that stays in Arrow.
BATCH_BYTES = 3_000_000
#: Characters of text that one inner batch holds at most (a longer text is a batch of its own).
BATCH_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_batches(batch: pa.RecordBatch, column: str = "text", chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) over runs of rows of bounded size; null texts are empty."""
    values = batch.column(column)
    first, held, size = 0, [], 0
    for k in range(len(values)):
        text = values[k].as_py() or ""
        if held and size + len(text) > chars:
            yield first, held
            first, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def sliced_batches(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of at most so many bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


def split_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into runs of bounded text, each with its texts (null: empty)."""
    for batch in batches:
        for first, texts in text_batches(batch, column):
            yield batch.slice(first, len(texts)), texts


def more_partitions(df: DataFrame, size: int = 128 << 20) -> list[int]:
    """[n] if parts of about `size` bytes of df are more than the session's shuffle partitions, else [], for repartitioning
    calls whose count Spark may otherwise choose and merge. [] too where the size isn't known, as after a join, whose size
    Spark takes for the product of its sides'."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Join" in plan.toString():
        return []
    n = -(-int(plan.stats().sizeInBytes()) // size)
    if n > 10_000_000:  # a petabyte: Spark's way of saying that it doesn't know
        return []
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def fresh(df: DataFrame, name: str) -> str:
    """A name of a column that df doesn't have, whatever the case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{name}"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the decimal text of an id (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
