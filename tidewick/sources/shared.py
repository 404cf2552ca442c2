"""Tables between the steps of a job, in reliable storage that all executors share, so that lost ones cost little."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that pass to a Python worker at once. Spark's own 10,000 are 50 MB of pairs of texts, in the worker and beside the JVM's heap.
BATCH_ROWS = 1000


@contextmanager
def setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, the session has these settings."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when the action ends, as what it made is in reliable storage by then.

    Batches of rows for Python workers have at most BATCH_ROWS rows there.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(rows))
    with setting(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS)}):
        yield


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session.

    Where that is unset, a local session (as in tests) takes a folder below its warehouse; any other one raises
    ValueError, as a folder of one machine would be of no use to the others.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which the driver deletes when it ends."""
    made = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return made


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` as a table of Parquet files that was computed once."""
    with releasing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """`df` computed once and kept as a compressed table in the shared folder."""
    return written(df, folder(df.sparkSession, name) + "/table")
