"""The feature catalogue: 79 model inputs and the label, as chained column expressions over one order of the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.windows import clip, flag, full, lag, over
from . import indicators, patterns

PRICE = ["body_size", "upper_wick", "lower_wick", "total_range", "body_to_range_ratio", "wick_to_body_ratio", "candle_direction"]
TREND = ["ema_20", "ema_50", "ema_200", "price_vs_ema20", "price_vs_ema50", "ema20_slope", "ema50_slope", "trend_strength", "higher_highs", "lower_lows"]
VOLATILITY = ["atr_14", "atr_ratio", "volatility_expansion", "volatility_contraction", "bbands_upper", "bbands_lower", "bb_width", "bb_position"]
GAP = ["gap", "gap_pct", "gap_up", "gap_down", "gap_fill_pct"]
VOLUME = ["volume_sma20", "volume_ratio", "volume_spike", "relative_volume", "volume_trend"]
MOMENTUM = ["rsi_14", "rsi_oversold", "rsi_overbought", "macd_line", "macd_signal", "macd_hist", "macd_crossover", "roc_10", "momentum_score"]
LEVELS = ["rolling_high_20", "rolling_low_20", "distance_from_resistance", "distance_from_support", "breakout_strength"]
PATTERN = [f"pat_{n}" for n in patterns.NAMES] + [
    "pattern_strength", "pattern_direction_num", "pattern_candle_count", "pattern_signed_strength", "hammer_in_downtrend", "shooting_star_in_uptrend",
    "engulfing_high_volume", "bearish_engulfing_vol", "doji_near_resistance", "doji_near_support", "marubozu_with_breakout", "star_rsi_extreme",
    "harami_low_volume", "pattern_bullish_score", "pattern_bearish_score",
]
COLUMNS = PRICE + TREND + VOLATILITY + GAP + VOLUME + MOMENTUM + LEVELS + PATTERN
#: Inputs of a few values each, which are never scaled. Fixed values.
FEW_VALUES = [
    "candle_direction", "higher_highs", "lower_lows", "volatility_expansion", "volatility_contraction", "gap_up", "gap_down", "volume_spike", "volume_trend", "rsi_oversold", "rsi_overbought",
    "macd_crossover", "breakout_strength", "pattern_direction_num", "pattern_candle_count",
]
BINARY = [c for c in COLUMNS if c in FEW_VALUES or c.startswith("pat_")]
INTEGERS = set(BINARY) | {"candle_direction", "macd_crossover", "pattern_direction_num", "pattern_candle_count"} | set(PATTERN[19:28])


def price(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = df.withColumns({"body_size": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - l, "total_range": h - l})
    return out.withColumns({
        "body_to_range_ratio": over(F.col("body_size"), F.col("total_range")),
        "wick_to_body_ratio": (F.col("upper_wick") + F.col("lower_wick")) / (F.col("body_size") + 1e-9),
        "candle_direction": F.when(c > o, 1).otherwise(-1),
    })


def trend(df: DataFrame) -> DataFrame:
    spans = [n for n in (20, 50, 200) if f"ema_{n}" not in df.columns]
    df = indicators.smoothed(df, *map(indicators.span, spans)) if spans else df
    e20, e50, e200, c = (F.col(x) for x in ("ema_20", "ema_50", "ema_200", "close"))
    bull = (e20 > e50).cast("int") + (e50 > e200).cast("int") + (e20 > e200).cast("int")
    bear = (e20 < e50).cast("int") + (e50 < e200).cast("int") + (e20 < e200).cast("int")
    return df.withColumns({
        "price_vs_ema20": over(c - e20, e20), "price_vs_ema50": over(c - e50, e50),
        "ema20_slope": (e20 - lag("ema_20", 5)) / 5, "ema50_slope": (e50 - lag("ema_50", 5)) / 5, "trend_strength": (bull - bear) / F.lit(3.0),
        "higher_highs": flag((F.col("high") > lag("high")) & (lag("high") > lag("high", 2))), "lower_lows": flag((F.col("low") < lag("low")) & (lag("low") < lag("low", 2))),
    })


def volatility(df: DataFrame) -> DataFrame:
    df = indicators.bollinger(df if "atr_14" in df.columns else indicators.atr(df))
    c, up, low = F.col("close"), F.col("bbands_upper"), F.col("bbands_lower")
    return df.withColumns({
        "atr_ratio": over(F.col("atr_14"), c), "volatility_expansion": flag(F.col("atr_14") > 1.2 * lag("atr_14", 5)),
        "volatility_contraction": flag(F.col("atr_14") < 0.8 * lag("atr_14", 5)), "bb_width": over(up - low, c), "bb_position": over(c - low, up - low),
    }).drop("bbands_mid")


def gap(df: DataFrame) -> DataFrame:
    df = df.withColumn("gap", F.col("open") - lag("close")).withColumn("gap_pct", over(F.col("gap"), lag("close")))
    df = df.withColumns({"gap_up": flag(F.col("gap_pct") > 0.005), "gap_down": flag(F.col("gap_pct") < -0.005)})
    size = F.nullif(F.abs("gap"), F.lit(0.0))
    filled = F.when(F.col("gap_up") == 1, clip((F.col("open") - F.col("low")) / size, 0.0, 1.0)).when(F.col("gap_down") == 1, clip((F.col("high") - F.col("open")) / size, 0.0, 1.0))
    return df.withColumn("gap_fill_pct", F.coalesce(filled, F.lit(0.0)))


def volume(df: DataFrame) -> DataFrame:
    v = F.col("volume")
    df = df.withColumn("volume_sma20", full(F.avg("volume"), "volume", 20)).withColumn("volume_ratio", over(v, F.col("volume_sma20")))
    return df.withColumns({
        "volume_spike": flag(F.col("volume_ratio") > 2.0), "relative_volume": over(v, full(F.avg("volume"), "volume", 5)),
        "volume_trend": flag((v > lag("volume")) & (lag("volume") > lag("volume", 2))),
    })


def momentum(df: DataFrame) -> DataFrame:
    df = df if {"rsi_14", "macd_hist"} <= set(df.columns) else indicators.macd(indicators.rsi(df))
    r, now = F.col("rsi_14"), F.col("macd_line") > F.col("macd_signal")
    before = F.coalesce(lag("macd_line") > lag("macd_signal"), F.lit(False))
    df = df.withColumns({
        "rsi_oversold": flag(r < 35), "rsi_overbought": flag(r > 65), "macd_crossover": F.when(~before & now, 1).when(before & ~now, -1).otherwise(0),
        "roc_10": over(F.col("close"), lag("close", 10)) - 1,
    })
    return df.withColumn("momentum_score", ((r - 50) / 50 + F.signum("macd_hist") + F.signum("roc_10")) / 3.0)


def levels(df: DataFrame) -> DataFrame:
    c = F.col("close")
    df = df.withColumns({"rolling_high_20": full(F.max("high"), "high", 20), "rolling_low_20": full(F.min("low"), "low", 20)})
    return df.withColumns({
        "distance_from_resistance": over(F.col("rolling_high_20") - c, c), "distance_from_support": over(c - F.col("rolling_low_20"), c),
        "breakout_strength": flag(c > lag("rolling_high_20")),
    })


def pattern(df: DataFrame) -> DataFrame:
    """Pattern columns of tagged bars that have trend, volume, momentum and level features; missing ones count as 0."""
    name = F.col("pattern_name")
    df = df.withColumns({f"pat_{n}": flag(name == n) for n in patterns.NAMES})
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    df = df.withColumns({
        "pattern_strength": F.coalesce("pattern_strength", F.lit(0.0)),
        "pattern_direction_num": F.when(F.col("pattern_direction") == "bullish", 1).when(F.col("pattern_direction") == "bearish", -1).otherwise(0),
        "pattern_candle_count": F.when(F.col("pattern_type") == "single", 1).when(F.col("pattern_type") == "multi", 2).otherwise(0),
    })
    is_ = lambda n: F.col(f"pat_{n}") == 1
    s, d, ts, spike = F.col("pattern_strength"), F.col("pattern_direction_num"), have("trend_strength", 0.0), have("volume_spike", 0) == 1
    extreme = (have("rsi_oversold", 0) == 1) | (have("rsi_overbought", 0) == 1)
    return df.withColumns({
        "pattern_signed_strength": s * d, "hammer_in_downtrend": flag(is_("hammer") & (ts < -0.33)), "shooting_star_in_uptrend": flag(is_("shooting_star") & (ts > 0.33)),
        "engulfing_high_volume": flag(is_("bullish_engulfing") & spike), "bearish_engulfing_vol": flag(is_("bearish_engulfing") & spike),
        "doji_near_resistance": flag(is_("doji") & (F.col("distance_from_resistance") < 0.02)), "doji_near_support": flag(is_("doji") & (F.col("distance_from_support") < 0.02)),
        "marubozu_with_breakout": flag(is_("bullish_marubozu") & (F.col("breakout_strength") == 1)), "star_rsi_extreme": flag((is_("morning_star") | is_("evening_star")) & extreme),
        "harami_low_volume": flag((is_("bullish_harami") | is_("bearish_harami")) & ~spike),
        "pattern_bullish_score": s * F.greatest(F.lit(0), d), "pattern_bearish_score": s * F.greatest(F.lit(0), -d),
    })


def target(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The return over the next bars, and its label against the average range; both null where the future is unknown."""
    from ..functions.windows import by_symbol

    later = F.lead("close", cfg.horizon).over(by_symbol())
    df = df.withColumn("forward_return_5d", over(later - F.col("close"), F.col("close")))
    scaled = F.col("forward_return_5d") / (F.col("atr_ratio") + 1e-9)
    return df.withColumn("target_label", F.when(scaled > cfg.label_edge, 1).when(scaled < -cfg.label_edge, -1).when(scaled.isNotNull(), 0))


def wide(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All features and the target on every bar, with nulls where history is short."""
    tagged = patterns.tag(indicators.every(bars), cfg)
    for step in (price, trend, volatility, gap, volume, momentum, levels, pattern):
        tagged = step(tagged)
    return target(tagged, cfg)


def scoring_rows(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows with all features, the newest bars included, of which the target isn't known yet."""
    return wide(bars, cfg).na.drop(subset=COLUMNS)


def features(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows with all features and a known target, of symbols that have enough of them."""
    rows = wide(bars, cfg).na.drop(subset=[*COLUMNS, "target_label"])
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= cfg.min_feature_rows)
    return counted.select("symbol", "bar_date", "open", "high", "low", "close", "volume", "pattern_name", "pattern_direction", *COLUMNS, "forward_return_5d", "target_label")


def label_shares(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("target_label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
