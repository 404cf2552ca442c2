"""Files of differing headers and of doubtful content: what can be read is read, the rest is set aside with its reason."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of bars as CSV files have them, by their normal names.
BAR_COLUMNS = {"date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "adj_close": "double", "volume": "bigint"}
BAR_NEEDS = ["date", "open", "high", "low", "close", "volume"]
#: Columns of reports, by their types; others are texts.
REPORT_COLUMNS = {
    "bar_date": "date", "date": "date", "rank": "int", "p_bear": "double", "p_neutral": "double", "p_bull": "double", "confidence_value": "double", "entry_price": "double", "stoploss": "double",
    "risk_pct": "double", "pattern_strength": "double", "continuation_probability": "double", "reversal_probability": "double", "reject_signal": "boolean",
}


def normal(name: Column) -> Column:
    """A header's name in lower case with single underscores: ` Adj Close*` is `adj_close`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, "^﻿", "")), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def _with_fields(lines: DataFrame, line: str, n: int) -> DataFrame:
    """Adds `fields`, the first `n` fields of a CSV line as texts (missing ones are null), parsed once."""
    parsed = lines.select("*", F.inline(F.array(F.from_csv(line, ", ".join(f"_c{k} string" for k in range(n))))))
    return parsed.select(*lines.columns, F.array(*[f"_c{k}" for k in range(n)]).alias("fields"))


def empty_files(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    """Rows file, reason: files without a byte, which Spark's readers pass over in silence. The driver lists the folders."""
    found, hadoop = [], spark._jvm.org.apache.hadoop.fs
    for path in [paths] if isinstance(paths, str) else paths:
        system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        files = system.listFiles(hadoop.Path(path), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if f.getLen() == 0 and name.endswith(suffix) and name[0] not in "._":
                found.append((f.getPath().toString(), "empty file"))
    return spark.createDataFrame(found, "file string, reason string")


def read_csv(spark: SparkSession, paths: str | list[str], kinds: dict[str, str], needs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files, each read by its own header, and what was set aside: rows file, line, reason.

    Columns are found by their normal names; the good rows have `file` and all columns of `kinds`, null where a file has
    no such column. A file without one of `needs` is set aside as a whole (line null), and so is an empty one; a row is,
    if a value isn't of its column's kind or one of `needs` is missing. A column in the files that `kinds` doesn't name is
    left out. Blank lines are none.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("begins"), F.monotonically_increasing_id().alias("at"))
    text = text.where(F.trim("value") != "")
    heads = text.where("begins").groupBy("file").agg(F.min("at").alias("head_at"), F.min_by("value", "at").alias("head"))  # a row for each file
    wide = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    heads = _with_fields(heads, "head", wide).select("file", "head_at", F.transform("fields", normal).alias("names"))
    lines = text.join(heads, "file").where(F.col("at") != F.col("head_at"))
    missing = F.array_except(F.array(*[F.lit(c) for c in needs]), F.col("names"))
    values = _with_fields(lines, "value", wide).withColumn("missing", missing)
    raw = {c: F.nullif(F.trim(F.get("fields", (F.array_position("names", F.lit(c)) - 1).cast("int"))), F.lit("")) for c in kinds}
    cast = {c: raw[c].try_cast(kind) for c, kind in kinds.items()}
    wrong = [F.when(raw[c].isNotNull() & cast[c].isNull(), f"{c} isn't a {kind}") for c, kind in kinds.items()]
    empty = [F.when(raw[c].isNull(), f"{c} is missing") for c in needs]
    judged = values.select("file", "value", "missing", F.concat_ws("; ", *wrong, *empty).alias("reason"), *[cast[c].alias(c) for c in kinds])
    good = judged.where("size(missing) = 0 and reason = ''").select("file", *kinds)
    bad = judged.where("size(missing) = 0 and reason != ''").select("file", F.col("value").alias("line"), "reason")
    lost = heads.withColumn("missing", missing).where("size(missing) > 0").select("file", F.lit(None).cast("string").alias("line"), F.concat(F.lit("no column "), F.array_join("missing", ", ")).alias("reason"))
    blank = empty_files(spark, paths, ".csv").select("file", F.lit(None).cast("string").alias("line"), "reason")
    return good, bad.union(lost).union(blank)


def read_csv_bars(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Bars from CSV files of any header, one file for each symbol, and what was set aside."""
    good, bad = read_csv(spark, paths, BAR_COLUMNS, BAR_NEEDS)
    symbol = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.csv$", 1), "_NS$", ".NS")
    return good.select(symbol.alias("symbol"), F.col("date").alias("bar_date"), *[c for c in BAR_COLUMNS if c != "date"]), bad


def read_reports(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """The rows of reports that write_report has written, old and new ones together; columns a report lacks are null."""
    return read_csv(spark, paths, {c: REPORT_COLUMNS.get(c, "string") for c in columns}, [])[0].drop("file")


def _reason(content: bytes, schema: pa.Schema) -> str | None:
    """Why a Parquet file can't be read as `schema`; None if it can."""
    if not content:
        return "empty file"
    try:
        found = pq.ParquetFile(io.BytesIO(content))
        names = found.schema_arrow.names
        wrong = [f.name for f in schema if f.name in names and found.schema_arrow.field(f.name).type != f.type]
        if wrong:
            return f"other type: {', '.join(wrong)}"
        lacking = [f.name for f in schema if f.name not in names]
        if lacking:
            return f"no column {', '.join(lacking)}"
        for k in range(found.num_row_groups):
            found.read_row_group(k)
    except Exception as error:  # whatever is wrong with a file is its reason
        return f"unreadable: {type(error).__name__}"
    return None


def read_parquet(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of the good Parquet files below `path`, and the others: rows file, reason.

    Each file is looked at whole by one task, through Spark's own reader, so files should be of the size of a symbol's
    bars. Partition columns in the path aren't looked for in the files.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    wanted = to_arrow_schema(schema)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["path"], "reason": [_reason(c, wanted) for c in batch["content"]]})

    bad = files.select("path", "content").mapInPandas(look, "file string, reason string").where("reason is not null").union(empty_files(spark, path, ".parquet"))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    good = rows.select("*", F.col("_metadata.file_path").alias("_file")).join(bad.select(F.col("file").alias("_file")), "_file", "left_anti")
    return good.drop("_file"), bad
