"""Loading many symbols one by one, in batches that are kept: a load that breaks off goes on with what is pending."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import BAR_SCHEMA

STATUS_SCHEMA = "symbol string, status string, attempts int, n_rows long, error string, batch string"
_COLUMNS = [c.split()[0] for c in BAR_SCHEMA.split(", ")]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The newest status of each symbol that was tried: ok or failed, attempts, rows, the last error, its batch."""
    if not _exists(spark, f"{folder}/status"):
        return spark.createDataFrame([], STATUS_SCHEMA)
    every = spark.read.schema(STATUS_SCHEMA).parquet(f"{folder}/status")
    # ok stays ok; of failures the newest counts, and batches are named by their time
    newest = F.max_by(F.struct("status", "attempts", "n_rows", "error", "batch"), F.struct(F.col("status") == "ok", "batch"))
    return every.groupBy("symbol").agg(newest.alias("s")).select("symbol", "s.*")


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of all symbols that are ok, each from the batch that has loaded it."""
    if not _exists(spark, f"{folder}/bars"):
        return spark.createDataFrame([], BAR_SCHEMA)
    ok = status(spark, folder).where("status = 'ok'").select("symbol", "batch")
    bars = spark.read.schema(f"{BAR_SCHEMA}, batch string").option("basePath", f"{folder}/bars").parquet(f"{folder}/bars")
    return bars.join(ok, ["symbol", "batch"], "left_semi").select(*_COLUMNS)


def pending(listing: DataFrame, folder: str) -> DataFrame:
    """The rows of `listing` (symbol, where) whose symbols aren't ok yet."""
    return listing.join(status(listing.sparkSession, folder).where("status = 'ok'"), "symbol", "left_anti")


def load(listing: DataFrame, fetch: Callable[[str, str], pd.DataFrame], folder: str, attempts: int = 3, together: int = 200, tasks: int = 8, least: int = 1, pause: float = 0.0) -> DataFrame:
    """Loads what is pending of `listing` (symbol, where) into `folder` and returns the status of all symbols tried.

    `fetch` is called with a symbol and its place, in tasks, and returns its bars as a frame (bar_date, open, high, low,
    close, adj_close, volume) or raises; it is tried `attempts` times, `pause` seconds apart. A symbol with fewer than
    `least` bars has failed. Symbols go in batches of about `together`, `tasks` at a time; a batch's bars are written
    first and its statuses after them, and bars count only with their status, so a batch that breaks off in between
    leaves nothing behind and is loaded again. A symbol that is listed twice is loaded once.
    """
    spark = listing.sparkSession
    todo = pending(listing, folder).groupBy("symbol").agg(F.min("where").alias("where"))
    n = todo.count()
    batches = max(1, -(-n // together)) if n else 0
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64("symbol"), F.lit(max(1, batches))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for symbol, where in zip(part["symbol"], part["where"], strict=True):
                error, rows, tried = None, None, 0
                while rows is None and tried < attempts:
                    tried += 1
                    try:
                        rows = fetch(symbol, where)
                        if len(rows) < least:
                            raise ValueError(f"{len(rows)} bars, {least} needed")
                    except Exception as e:  # any failure of a source counts as an attempt
                        rows, error = None, f"{type(e).__name__}: {e}"
                        if pause and tried < attempts:
                            time.sleep(pause)
                if rows is None:
                    rows = pd.DataFrame([{c: None for c in _COLUMNS}])
                else:
                    error = None
                yield rows.assign(symbol=symbol, _attempts=tried, _error=error)[[*_COLUMNS, "_attempts", "_error"]]

    listed = spark.read.schema(todo.schema)  # the listing as it was when the load began
    kept = f"{folder}/listing/{uuid.uuid4().hex}"
    todo.write.parquet(kept)
    for k in range(batches):
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        own = listed.parquet(kept).where(F.col("_batch") == k).select("symbol", "where").repartition(tasks, "symbol")
        got = own.mapInPandas(run, f"{BAR_SCHEMA}, _attempts int, _error string")
        got.write.parquet(f"{folder}/got/{name}")
        got = spark.read.parquet(f"{folder}/got/{name}")
        got.where("_error is null").select(*_COLUMNS).write.parquet(f"{folder}/bars/batch={name}")
        tried = got.groupBy("symbol").agg(
            F.when(F.max("_error").isNull(), "ok").otherwise("failed").alias("status"), F.max("_attempts").alias("attempts"), F.count("bar_date").alias("n_rows"), F.max("_error").alias("error"), F.lit(name).alias("batch"),
        )
        tried.write.mode("append").parquet(f"{folder}/status")
    return status(spark, folder)
