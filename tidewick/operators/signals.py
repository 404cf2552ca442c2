"""Trading signals: context, quality flags, confidence, class, stop and rejection of every scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Confidences from which a signal is of the tier HIGH or MEDIUM, and below which it is rejected.
HIGH, MEDIUM, LEAST = 0.70, 0.55, 0.50


def fixed(value: Column, places: int) -> Column:
    """A number with fixed decimal places; ties of the binary value go to the even digit."""
    return F.translate(F.format_number(value, places), ",", "")


def given(name: str, other) -> Column:
    return F.coalesce(F.col(name), F.lit(other))


def context(rows: DataFrame) -> DataFrame:
    """Adds eight columns that describe where a bar stands; features that are null count as neutral."""
    ts, rsi = given("trend_strength", 0.0), given("rsi_14", 50.0)
    fast, slow = given("ema_20", 0.0) > given("ema_50", 0.0), given("ema_50", 0.0) > given("ema_200", 0.0)
    return rows.withColumns({
        "trend_context": F.when(ts >= 0.33, "UPTREND").when(ts <= -0.33, "DOWNTREND").otherwise("SIDEWAYS"),
        "rsi_zone": F.when(rsi <= 35, "OVERSOLD").when(rsi >= 65, "OVERBOUGHT").otherwise("NEUTRAL"),
        "volume_confirmation": given("volume_ratio", 1.0) >= 1.5,
        "volatility_state": F.when(given("volatility_expansion", 0) != 0, "EXPANDING").when(given("volatility_contraction", 0) != 0, "CONTRACTING").otherwise("NEUTRAL"),
        "near_support": F.abs(given("distance_from_support", 1.0)) <= 0.02, "near_resistance": F.abs(given("distance_from_resistance", 1.0)) <= 0.02,
        "gap_present": (given("gap_up", 0) != 0) | (given("gap_down", 0) != 0),
        "ema_alignment": F.when(fast & slow, "BULLISH").when(~fast & ~slow, "BEARISH").otherwise("MIXED"),
    })


def quality_flags(rows: DataFrame) -> DataFrame:
    """Adds seven flags to rows that have their context."""
    close = given("close", 1.0)
    share = F.when(close > 0, given("total_range", 0.0) / F.nullif(close, F.lit(0.0))).otherwise(0.0)
    return rows.withColumns({
        "high_volume": given("volume_ratio", 1.0) >= 1.5, "strong_trend": F.abs(given("trend_strength", 0.0)) >= 0.67,
        "momentum_confirmation": (F.abs(given("momentum_score", 0.0)) >= 0.33) | (given("macd_crossover", 0) != 0),
        "level_reaction": F.col("near_support") | F.col("near_resistance"), "sideways_market": F.col("trend_context") == "SIDEWAYS",
        "candle_too_small": share < 0.01, "candle_too_large": share > 0.10,
    })


def derived_probabilities(rows: DataFrame) -> DataFrame:
    going = F.least(F.abs(given("trend_strength", 0.0)) * (F.abs(given("momentum_score", 0.0)) + 0.5), F.lit(1.0))
    turning = F.least(F.abs(given("rsi_14", 50.0) - 50) / 50.0 * given("pattern_strength", 0.0) * (1.0 + given("volume_spike", 0) * 0.5), F.lit(1.0))
    return rows.withColumns({"continuation_probability": F.round(going, 4), "reversal_probability": F.round(turning, 4)})


def normalized(rows: DataFrame) -> DataFrame:
    total = F.coalesce(F.nullif(F.col("p_bull") + F.col("p_bear") + F.col("p_neutral"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({c: F.col(c) / total for c in ("p_bull", "p_bear", "p_neutral")})


def confidence(rows: DataFrame) -> DataFrame:
    """The larger directional probability, raised and lowered by the flags, and its tier."""
    score = F.greatest("p_bull", "p_bear")
    for name in ("high_volume", "strong_trend", "momentum_confirmation", "level_reaction"):
        score = score + F.when(F.col(name), 0.05).otherwise(0.0)
    score = score - F.when(F.col("sideways_market"), 0.10).otherwise(0.0) - F.when(F.col("candle_too_small") | F.col("candle_too_large"), 0.15).otherwise(0.0)
    out = rows.withColumn("confidence_value", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4))
    return out.withColumn("confidence_score", F.when(F.col("confidence_value") >= HIGH, "HIGH").when(F.col("confidence_value") >= MEDIUM, "MEDIUM").otherwise("LOW"))


def classify(rows: DataFrame) -> DataFrame:
    bull, bear, way = F.col("p_bull"), F.col("p_bear"), F.coalesce("pattern_direction", F.lit("neutral"))
    margin = bull - bear
    out = rows.withColumn("signal", F.when((bull >= 0.45) & ((margin > 0.05) | (way == "bullish")), "BUY").when((bear >= 0.45) & ((margin < -0.05) | (way == "bearish")), "SELL").otherwise("HOLD"))
    return out.withColumn("signal_strength", F.when(F.col("confidence_value") >= HIGH, "STRONG").when(F.col("confidence_value") >= MEDIUM, "MODERATE").otherwise("WEAK"))


def stoploss(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds stop, risk in percent and method. A pattern of several bars stops beyond its range if `pattern_low` and
    `pattern_high` are given, else by average range; other bars stop beyond their wick where that is near enough."""
    entry, low, high = given("close", 0.0), given("lower_wick", 0.0), given("upper_wick", 0.0)
    a = F.coalesce(F.col("atr_14"), entry * 0.01)
    buy, sell = F.col("signal") == "BUY", F.col("signal") == "SELL"
    by_atr = F.when(buy, entry - cfg.stop_atr * a).otherwise(entry + cfg.stop_atr * a)
    by_wick = F.when(buy, entry - low - cfg.buffer_atr * a).otherwise(entry + high + cfg.buffer_atr * a)
    near = (by_wick > 0) & (F.abs(entry - by_wick) < 2 * a)
    several = given("pattern_candle_count", 0) >= 2
    ranged = {"pattern_low", "pattern_high"} <= set(rows.columns)
    wide = F.when(buy, given("pattern_low", 0.0) - cfg.buffer_atr * a).otherwise(given("pattern_high", 0.0) + cfg.buffer_atr * a) if ranged else by_atr
    stop = F.when(several, wide).when(near, by_wick).otherwise(by_atr)
    method = F.when(several, F.lit("pattern" if ranged else "atr_fallback")).when(near, "pattern").otherwise("atr_fallback")
    risk = F.when(entry > 0, F.abs(entry - stop) / F.nullif(entry, F.lit(0.0))).otherwise(0.0)
    out = rows.withColumn("_trade", buy | sell)
    return out.withColumns({
        "entry_price": F.round(entry, 2), "stoploss": F.when(F.col("_trade"), F.round(stop, 2)).otherwise(F.round(entry, 2)),
        "risk_pct": F.when(F.col("_trade"), F.round(risk * 100, 3)).otherwise(0.0), "stoploss_method": F.when(F.col("_trade"), method).otherwise("none"),
    }).drop("_trade")


def rejection(rows: DataFrame) -> DataFrame:
    """Adds the reasons why a signal is rejected. Their texts are fixed values, as users read them in reports."""
    reasons = [
        F.when(F.col("candle_too_small"), "candle range < 1% of close (too small)"),
        F.when(F.col("candle_too_large"), "candle range > 10% of close (likely news / circuit)"),
        F.when(F.col("confidence_value") < LEAST, F.concat(F.lit("confidence "), fixed(F.col("confidence_value"), 2), F.lit(" < minimum 0.5"))),
        F.when(F.col("sideways_market") & ~F.col("high_volume"), "pattern in sideways market without volume confirmation"),
    ]
    out = rows.withColumn("reject_reason", F.concat_ws("; ", *reasons))
    return out.withColumn("reject_signal", F.col("reject_reason") != "")


def direction(rows: DataFrame) -> DataFrame:
    """Rows whose `pattern_direction` is never null: without a name, or if that is neutral, `pattern_direction_num` decides."""
    name = F.coalesce(F.nullif("pattern_direction", F.lit("")), F.lit("neutral"))
    sign = given("pattern_direction_num", 0) if "pattern_direction_num" in rows.columns else F.lit(0)
    by_sign = F.when(sign == 1, "bullish").when(sign == -1, "bearish").otherwise("neutral")
    return rows.withColumn("pattern_direction", F.when(name == "neutral", by_sign).otherwise(name))


def with_last_bar(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows with the prices and volume of the newest bar of their symbol; without such a bar they keep their own."""
    cols = ["open", "high", "low", "close", "volume"]
    newest = bars.groupBy("symbol").agg(F.max_by(F.struct(*cols), "bar_date").alias("_bar"))
    joined = rows.join(newest, "symbol", "left")
    return joined.withColumns({c: F.when(F.col("_bar").isNull(), F.col(c)).otherwise(F.col(f"_bar.{c}")) for c in cols if c in rows.columns}).select(*rows.columns)


def signals(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One signal for each scored row."""
    out = scored.transform(direction).transform(normalized).transform(context).transform(quality_flags).transform(derived_probabilities).transform(confidence).transform(classify)
    return out.transform(stoploss, cfg).transform(rejection).withColumn("pattern_detected", F.coalesce("pattern_name", F.lit("none")))


def with_probabilities(rows: DataFrame, output: DataFrame) -> DataFrame:
    """Rows with the model output (symbol, bar_date, p_bull, p_bear, p_neutral) of their bar; a third each where it is missing."""
    out = rows.join(output.select("symbol", "bar_date", "p_bull", "p_bear", "p_neutral"), ["symbol", "bar_date"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(1 / 3)) for c in ("p_bull", "p_bear", "p_neutral")})


def daily_report(found: DataFrame, top_n: int = DEFAULT.top_n) -> DataFrame:
    """The `top_n` valid signals of each day by confidence, ties by symbol."""
    order = Window.partitionBy("bar_date").orderBy(F.desc("confidence_value"), "symbol")
    return found.where(~F.coalesce("reject_signal", F.lit(True))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def report_text(report: DataFrame) -> DataFrame:
    """The lines of a report in fixed columns."""
    percent = lambda c, n: F.concat(F.lpad(fixed(F.col(c) * 100, 1), n, " "), F.lit("%"))
    line = F.concat_ws(
        " ", F.rpad("symbol", 14, " "), F.rpad("pattern_detected", 22, " "), F.rpad(F.coalesce("pattern_direction", F.lit("neutral")), 9, " "),
        percent("p_bull", 5), percent("p_bear", 5), percent("confidence_value", 5), F.lpad("confidence_score", 6, " "), F.rpad("signal", 6, " "), F.rpad("signal_strength", 9, " "),
        F.lpad(fixed(F.col("entry_price"), 2), 9, " "), F.lpad(fixed(F.col("stoploss"), 2), 9, " "), F.concat(F.lpad(fixed(F.col("risk_pct"), 2), 5, " "), F.lit("%")),
    )
    return report.select("bar_date", "rank", line.alias("line"))


_HEAD = [("symbol", 14), ("pattern", 22), ("direction", 9), ("bull", -6), ("bear", -6), ("conf", -6), ("tier", -6), ("signal", 6), ("strength", 9), ("entry", -9), ("stop", -9), ("risk", -6)]


def report_page(report: DataFrame) -> DataFrame:
    """The lines of a report with a title and a header for each day, at ranks -1 and 0."""
    names = " ".join(name.ljust(n) if n > 0 else name.rjust(-n) for name, n in _HEAD)
    days = report.select("bar_date").distinct()
    title = F.struct(F.lit(-1).alias("rank"), F.concat(F.lit("Signals of "), F.date_format("bar_date", "yyyy-MM-dd")).alias("line"))
    head = F.struct(F.lit(0).alias("rank"), F.lit(names).alias("line"))
    return days.select("bar_date", F.inline(F.array(title, head))).unionByName(report_text(report))


def eod_summary(found: DataFrame, top_n: int = DEFAULT.top_n) -> DataFrame:
    """Counts of each day: all signals, rejected ones, those of each class, and the tiers of the report's rows."""
    order = Window.partitionBy("bar_date").orderBy(F.col("reject_signal").cast("int"), F.desc("confidence_value"), "symbol")
    rows = found.withColumn("_shown", ~F.col("reject_signal") & (F.row_number().over(order) <= top_n))
    n = lambda c: F.sum(c.cast("int")).cast("long")
    ok = ~F.col("reject_signal")
    return rows.groupBy("bar_date").agg(
        F.count("*").alias("signals_generated"), n(F.col("reject_signal")).alias("signals_rejected"), n(F.col("_shown")).alias("valid_signals"),
        n(ok & (F.col("signal") == "BUY")).alias("buy_signals"), n(ok & (F.col("signal") == "SELL")).alias("sell_signals"), n(ok & (F.col("signal") == "HOLD")).alias("hold_signals"),
        *[n(F.col("_shown") & (F.col("confidence_score") == t)).alias(f"{t.lower()}_confidence") for t in ("HIGH", "MEDIUM", "LOW")],
    )


def latest_rows(rows: DataFrame, n: int = 1) -> DataFrame:
    """The newest `n` rows of each symbol."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_date")))).where(F.col("_r") <= n).drop("_r")
