"""Reading the given tables, and cutting lineage so that lost executors cost little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import folder, releasing, setting, shared_dir, stored, written

__all__ = ["Scratch", "folder", "releasing", "setting", "settled", "shared_dir", "stored", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in reliable storage, in the folder the cluster names in spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    with releasing(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables between the steps of one operator, in a folder of their own that goes when its result is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, folder(spark, "scratch")

    def __call__(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self.path}/{uuid.uuid4().hex}")

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as a table of its own; all tables of this folder are deleted."""
        out = stored(df)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out
