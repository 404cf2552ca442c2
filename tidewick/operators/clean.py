"""Cleaning: splits, missing days, outliers, invalid candles and types, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, YEARLY_HOLIDAYS, Config
from ..functions.windows import by_symbol, lag

PRICES = ["open", "high", "low", "close"]


def adjust(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Prices scaled to the adjusted close, where any bar of the symbol differs by more than the tolerance.

    Bars without `adj_close` get their close. The close always becomes the adjusted close.
    """
    if "adj_close" not in bars.columns:
        return bars.withColumn("adj_close", F.col("close"))
    ratio = F.col("adj_close") / F.nullif("close", F.lit(0.0))
    split = F.max(F.coalesce(F.abs(ratio - 1) > cfg.split_tolerance, F.lit(False))).over(Window.partitionBy("symbol"))
    marked = bars.withColumn("_ratio", ratio).withColumn("_split", split)
    scaled = {c: F.when(F.col("_split"), F.col(c) * F.col("_ratio")).otherwise(F.col(c)) for c in ("open", "high", "low")}
    return marked.withColumns(scaled).withColumn("close", F.col("adj_close")).drop("_ratio", "_split")


def trading_days(spans: DataFrame, holidays: list[tuple[int, int]] = YEARLY_HOLIDAYS) -> DataFrame:
    """Rows symbol, bar_date: weekdays from first_date to last_date of each symbol, without yearly holidays."""
    days = spans.select("symbol", F.explode(F.sequence("first_date", "last_date")).alias("bar_date"))
    off = F.struct(F.month("bar_date"), F.dayofmonth("bar_date")).isin([F.struct(F.lit(m), F.lit(d)) for m, d in holidays])
    return days.where((F.weekday("bar_date") < 5) & ~off)


def spine(bars: DataFrame) -> DataFrame:
    return trading_days(bars.groupBy("symbol").agg(F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date")))


def missing_days(bars: DataFrame) -> DataFrame:
    return spine(bars).join(bars.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_anti")


def gap_days(missing: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Missing days with the number of their run; a day joins the run of the one before if at most three days later."""
    new = F.coalesce(F.datediff("bar_date", lag("bar_date")) > cfg.gap_join_days, F.lit(True)).cast("int")
    return missing.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_symbol())).drop("_new")


def gap_runs(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    days = gap_days(missing_days(bars), cfg)
    return days.groupBy("symbol", "run").agg(F.min("bar_date").alias("first_missing"), F.max("bar_date").alias("last_missing"), F.count("*").alias("n_days"))


def fill_gaps(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Bars on the calendar: short gaps filled from the bar before, long ones left out.

    Symbols that miss no day keep all their bars, those on other days too.
    """
    days = gap_days(missing_days(bars), cfg)
    holes = days.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "run"))).select("symbol", "bar_date", (F.col("_n") > cfg.max_gap_fill).alias("_long"))
    holed = holes.select("symbol").distinct().withColumn("_holed", F.lit(True))
    values = [c for c in bars.columns if c not in ("symbol", "bar_date")]
    on_days = spine(bars).join(bars, ["symbol", "bar_date"], "left").join(holes, ["symbol", "bar_date"], "left")
    recent = by_symbol().rowsBetween(-cfg.max_gap_fill, 0)
    filled = on_days.select("symbol", "bar_date", "_long", *[F.last(c, ignorenulls=True).over(recent).alias(c) for c in values])
    kept = filled.where(F.col("close").isNotNull() & ~F.coalesce("_long", F.lit(False))).join(holed, "symbol", "left_semi")
    whole = bars.join(holed, "symbol", "left_anti")
    return kept.select(*bars.columns).unionByName(whole.select(*bars.columns))


def clip_outliers(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Closes that move by more than the limit set to the limit, the other prices of the day in proportion."""
    before = lag("close")
    move = F.col("close") / F.nullif(before, F.lit(0.0)) - 1
    marked = bars.withColumn("_before", before).withColumn("_move", move).withColumn("_hit", F.coalesce(F.abs("_move") > cfg.max_return, F.lit(False)))
    new = F.when(F.col("_hit"), F.col("_before") * (1 + F.when(F.col("_move") > 0, cfg.max_return).otherwise(-cfg.max_return))).otherwise(F.col("close"))
    marked = marked.withColumn("_new", new).withColumn("_any", F.max("_hit").over(Window.partitionBy("symbol")))
    factor = F.col("_new") / F.nullif("close", F.lit(0.0))
    scaled = {c: F.when(F.col("_hit"), F.col(c) * factor).otherwise(F.col(c)) for c in ("open", "high", "low")}
    scaled["high"] = F.when(F.col("_any"), F.greatest(scaled["high"], scaled["low"])).otherwise(scaled["high"])
    if "adj_close" in bars.columns:
        scaled["adj_close"] = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("adj_close"))
    out = marked.withColumns(scaled).withColumn("close", F.col("_new"))
    return out.select(*bars.columns)


def valid_candles(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    parts = [F.coalesce(c, F.lit(False)) for c in (F.col("high") < F.col("low"), F.col("close") <= 0, F.col("volume") == 0, F.abs(F.col("high") - F.col("low")) < cfg.min_range * F.abs("close"))]
    return bars.where(~(parts[0] | parts[1] | parts[2] | parts[3]))


def enforce_types(bars: DataFrame) -> DataFrame:
    typed = bars.withColumns({c: F.col(c).try_cast("double") for c in PRICES} | {"volume": F.coalesce(F.col("volume").try_cast("long"), F.lit(0).cast("long"))})
    return typed.na.drop(subset=PRICES)


def preprocess(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All steps; symbols with too few bars afterwards are left out."""
    out = bars.transform(adjust, cfg).transform(fill_gaps, cfg).transform(clip_outliers, cfg).transform(valid_candles, cfg).transform(enforce_types)
    counted = out.withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    return counted.where(F.col("_n") >= cfg.min_clean_rows).select("symbol", "bar_date", *PRICES, "volume", "adj_close")


def quality_audit(bars: DataFrame) -> DataFrame:
    """Nulls, prices of zero or less, and gaps of more than five days, by symbol."""
    gaps = bars.withColumn("_gap", F.datediff("bar_date", lag("bar_date")))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    nulls = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull()
    low = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    return gaps.groupBy("symbol").agg(F.count("*").alias("n_rows"), count(nulls).alias("n_null"), count(low).alias("n_not_positive"), count(F.col("_gap") > 5).alias("n_gaps"))


def clean_counts(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows of each symbol before and after cleaning, and prices that are infinite afterwards; a symbol may lose all rows."""
    endless = lambda c: F.abs(c) == float("inf")
    infinite = F.sum(sum((F.coalesce(endless(F.col(c)), F.lit(False)).cast("int") for c in PRICES), F.lit(0))).cast("long")
    after = cleaned.groupBy("symbol").agg(F.count("*").alias("n_clean"), infinite.alias("n_infinite"))
    joined = raw.groupBy("symbol").agg(F.count("*").alias("n_raw")).join(after, "symbol", "left")
    return joined.na.fill(0, ["n_clean", "n_infinite"])
