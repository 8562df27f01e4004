"""Work tables in the cluster's shared folder: written once, read again, and dropped at the end of the session."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one of this machine, if all of Spark runs
    in one process here; on a cluster other machines couldn't read it, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base and not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not base:
        base = getattr(work_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="evgraph-")
        work_folder.own = base
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a work table through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_folder(spark, path)
    except Exception:  # the session is gone: the cluster's own cleaning removes the folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the work folder, dropped at the end."""
    path = f"{work_folder(spark)}/evgraph-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def write_work(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage. Returns it and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    return write_work(df, name)[0]
