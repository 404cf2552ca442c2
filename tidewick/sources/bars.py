"""Where bars come from: ticks, CSV files, Parquet; and where they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.prefix import ranked

BAR_SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume bigint"
CSV_SCHEMA = "Date date, Open double, High double, Low double, Close double, Volume bigint"


def tick_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars from order lines as ticks: the flags are the symbol, prices are scaled, dates moved by 28 years.

    Opening and closing ticks are those of the least and greatest key of the day. One shuffle of pre-aggregated days.
    """
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ticks = lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.add_months(F.to_date("l_shipdate"), 336).alias("bar_date"),
        (F.lit(100.0) + F.lit(8.0) * F.col("l_extendedprice") / F.lit(105000.0)).alias("px"), "l_quantity", key.alias("key"),
    )
    return ticks.groupBy("symbol", "bar_date").agg(
        F.min_by("px", "key").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "key").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def file_name(symbol):
    """The name of a symbol's CSV file: dots become underscores and slashes dashes."""
    return F.concat(F.regexp_replace(F.regexp_replace(symbol, r"\.", "_"), "/", "-"), F.lit(".csv"))


def read_csv_bars(spark: SparkSession, folder: str, min_days: int = DEFAULT.min_trading_days) -> DataFrame:
    """Bars from one CSV file per symbol; symbols with fewer than `min_days` rows are left out."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).csv(folder)
    bars = raw.select(F.regexp_replace(name, "_NS$", ".NS").alias("symbol"), F.col("Date").alias("bar_date"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")])
    return with_history(bars, min_days)


def with_history(bars: DataFrame, min_days: int = DEFAULT.min_trading_days) -> DataFrame:
    """Bars of symbols with at least `min_days` rows. The counts are one row per symbol."""
    enough = bars.groupBy("symbol").count().where(F.col("count") >= min_days).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by symbol; mode `ignore` keeps what is there."""
    bars.repartition("symbol").write.mode(mode).partitionBy("symbol").parquet(path)


def ordered_distinct(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """Each value once, with its place by first occurrence in `order`. One row per value is ranked, over range partitions."""
    firsts = rows.groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return ranked(firsts, [], ["_first", column], "place").select(column, F.col("place").cast("int").alias("place"))


def pending(asked: DataFrame, have: DataFrame) -> DataFrame:
    """Symbols of `asked` without any bar in `have`: what a load that was cut off has yet to read."""
    return asked.select("symbol").distinct().join(have.select("symbol"), "symbol", "left_anti")


def load_status(asked: DataFrame, have: DataFrame) -> DataFrame:
    """How many of the symbols asked for have bars (`ok`) and how many have none (`failed`)."""
    got = have.select("symbol").distinct().withColumn("_got", F.lit(True))
    status = F.when(F.col("_got"), "ok").otherwise("failed").alias("status")
    return asked.select("symbol").distinct().join(got, "symbol", "left").groupBy(status).agg(F.count("*").alias("n"))


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header, in one folder."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(figures: dict[str, object], spark: SparkSession, path: str) -> None:
    """A dict of figures as a CSV of one row."""
    write_report(spark.createDataFrame([{k: str(v) for k, v in figures.items()}]).select(*figures).coalesce(1), path)
