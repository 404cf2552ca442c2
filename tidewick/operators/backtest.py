"""Trades, portfolio and metrics of signals on bars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DATED_HOLIDAYS, DEFAULT, Config
from ..functions.fold import SEGMENT, folded
from ..functions.windows import by_symbol, lag


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~day.isin([F.lit(d).cast("date") for d in DATED_HOLIDAYS])


def next_trading_days(days: DataFrame) -> DataFrame:
    """Adds `next_day`, the first trading day after `bar_date`; no closure lasts longer than two weeks."""
    later = F.filter(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: F.date_add("bar_date", k)), is_trading_day)
    return days.withColumn("next_day", F.get(later, F.lit(0)))


def circuits(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds `circuit`: the bar's high or low is as far from the close before as the limit."""
    before = lag("close")
    far = F.greatest((F.col("high") - before) / F.nullif(before, F.lit(0.0)), (before - F.col("low")) / F.nullif(before, F.lit(0.0)))
    return bars.withColumn("circuit", F.coalesce(far >= cfg.circuit, F.lit(False)))


def with_defaults(signals: DataFrame) -> DataFrame:
    """Signals with every column that a trade needs: a stop two percent below the entry, low confidence and no pattern where missing."""
    entry = F.col("entry_price") if "entry_price" in signals.columns else F.lit(0.0)
    other = {"stoploss": entry * 0.98, "confidence_score": F.lit("LOW"), "confidence_value": F.lit(0.0), "pattern_detected": F.lit("none"), "pattern_strength": F.lit(0.0)}
    return signals.withColumns({c: v for c, v in other.items() if c not in signals.columns})


def trades(signals: DataFrame, bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each BUY or SELL signal that can be entered at the next trading day's open.

    A bar carries the trading-day bars that follow it, so an exit is the first of these that meets the stop or, else, the
    target; a trade ends at the last close if none does. Signals and bars meet in one equi-join.
    """
    days = circuits(bars, cfg).where(is_trading_day(F.col("bar_date")))
    after = F.collect_list(F.struct("bar_date", "high", "low", "close")).over(by_symbol().rowsBetween(1, cfg.hold_days))
    entries = days.withColumn("_next", after).where(~F.col("circuit")).select("symbol", F.col("bar_date").alias("next_day"), F.col("open").alias("_entry"), "_next")
    asked = next_trading_days(with_defaults(signals).where(F.col("signal").isin("BUY", "SELL")))
    rows = asked.join(entries, ["symbol", "next_day"]).withColumn("_way", F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0))
    rows = rows.withColumn("_target", F.col("_entry") + 2 * F.abs(F.col("_entry") - F.col("stoploss")) * F.col("_way")).where((F.col("_entry") > 0) & (F.abs(F.col("_entry") - F.col("stoploss")) >= 0.01))
    buy = F.col("signal") == "BUY"
    stopped = lambda b: F.when(buy, b["low"] <= F.col("stoploss")).otherwise(b["high"] >= F.col("stoploss"))
    reached = lambda b: F.when(buy, b["high"] >= F.col("_target")).otherwise(b["low"] <= F.col("_target"))
    rows = rows.withColumn("_hit", F.get(F.filter("_next", lambda b: stopped(b) | reached(b)), F.lit(0))).withColumn("_last", F.get("_next", F.size("_next") - 1))
    hit = F.col("_hit").isNotNull()
    low = hit & stopped(F.col("_hit"))
    price = F.when(low, F.col("stoploss")).when(hit, F.col("_target")).otherwise(F.coalesce("_last.close", "_entry"))
    rows = rows.withColumns({
        "_exit": price, "exit_date": F.coalesce(F.when(hit, F.col("_hit.bar_date")), F.col("_last.bar_date"), F.col("next_day")),
        "exit_reason": F.when(low, "STOPLOSS").when(hit, "TARGET").otherwise("HOLD_EXPIRED"),
    })
    raw = (F.col("_exit") - F.col("_entry")) * F.col("_way") / F.col("_entry")
    net = raw - cfg.cost
    return rows.select(
        "symbol", F.col("bar_date").alias("signal_date"), F.col("next_day").alias("entry_date"), "exit_date", F.col("signal").alias("direction"), F.round("_entry", 2).alias("entry_price"),
        F.round("_exit", 2).alias("exit_price"), F.round("stoploss", 2).alias("stoploss"), F.round("_target", 2).alias("target"), "exit_reason", F.round(raw * 100, 3).alias("raw_return_pct"),
        F.round(net * 100, 3).alias("net_return_pct"), (net > 0).alias("win"), "pattern_detected", "confidence_score", "confidence_value", "pattern_strength",
        F.col("_entry").alias("entry_open"),
    )


_ORDER = ["signal_date", "symbol", "entry_open", "stoploss", "net_return_pct"]


def _walk(done: DataFrame, cfg: Config, segment: int = SEGMENT) -> DataFrame:
    """The trades of each run in order of signal date and symbol, with the value and its peak after each."""
    runs = done if "run" in done.columns else done.withColumn("run", F.lit(0))

    def step(trades: pd.DataFrame, left: tuple | None) -> pd.DataFrame:
        value, peak = left or (cfg.capital, cfg.capital)
        rows = []
        for entry, stop, pct in zip(trades["entry_open"].tolist(), trades["stoploss"].tolist(), trades["net_return_pct"].tolist(), strict=True):
            risk, most = abs(entry - stop), cfg.max_notional * value
            shares = max(1, math.floor(cfg.risk * value / risk)) if risk > 0 else 0
            if shares * entry > most:
                shares = max(1, math.floor(most / entry))
            notional = shares * entry
            pnl = notional * (pct / 100)
            value += pnl
            peak = max(peak, value)
            rows.append((shares, notional, pnl, value, peak))
        return trades.assign(**dict(zip(("shares", "notional", "pnl", "portfolio_after", "peak"), zip(*rows, strict=True), strict=True)))

    added = "shares long, notional double, pnl double, portfolio_after double, peak double"
    return folded(runs.select("run", *_ORDER), "run", _ORDER, step, added, ["portfolio_after", "peak"], segment)


def portfolio(done: DataFrame, cfg: Config = DEFAULT, segment: int = SEGMENT) -> DataFrame:
    """The value after each trade, in order of signal date and symbol, with shares and notional.

    Each step depends on the value before it, so a run is folded in segments, one after the other, and no task holds more
    than a segment. Runs of different strategies fold side by side if there is a `run` column.
    """
    out = _walk(done, cfg, segment).select("run", F.col("_seq").cast("int").alias("seq"), "signal_date", "symbol", "shares", "notional", "pnl", "portfolio_after")
    return out if "run" in done.columns else out.drop("run")


def position_limits(done: DataFrame, most_open: int, segment: int = SEGMENT) -> DataFrame:
    """Trades with `taken`: in order of entry date, signal date and symbol, a trade is taken unless `most_open` of those
    taken before are still open, or one of the same symbol. A trade is open through its exit date.

    For each run if there is a `run` column. What goes from segment to segment is the open trades, `most_open` at most.
    """
    runs = done if "run" in done.columns else done.withColumn("run", F.lit(0))

    def step(trades: pd.DataFrame, left: tuple | None) -> pd.DataFrame:
        held = dict(zip(*left, strict=True)) if left and left[0] is not None else {}
        taken = []
        for symbol, entry, leave in zip(trades["symbol"].tolist(), trades["entry_date"].tolist(), trades["exit_date"].tolist(), strict=True):
            held = {s: d for s, d in held.items() if d >= entry}
            taken.append(len(held) < most_open and symbol not in held)
            if taken[-1]:
                held[symbol] = leave
        last = [None] * (len(trades) - 1)
        return trades.assign(taken=taken, held=[*last, list(held)], until=[*last, list(held.values())])

    order = ["entry_date", "signal_date", "symbol", "exit_date", "entry_price", "net_return_pct"]
    out = folded(runs, "run", order, step, "taken boolean, held array<string>, until array<date>", ["held", "until"], segment)
    return out.select(*done.columns, "taken")


def drawdown(curve: DataFrame, cfg: Config = DEFAULT, segment: int = SEGMENT) -> DataFrame:
    """The curve with its peak so far (the capital at first) and the fall from it, for each run if there is a `run` column.

    The peak is one over the segments before and one within the segment, so no task holds a run's curve.
    """
    runs = ["run"] if "run" in curve.columns else []
    rows = curve.select(*runs, "seq", "portfolio_after", F.expr(f"(seq - 1) div {segment}").alias("_segment"))
    highs = rows.groupBy(*runs, "_segment").agg(F.max("portfolio_after").alias("_high"))
    earlier = (Window.partitionBy(*runs) if runs else Window).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = highs.select(*runs, "_segment", F.max("_high").over(earlier).alias("_before"))  # a row for each segment
    inside = Window.partitionBy(*runs, "_segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("portfolio_after").over(inside), F.col("_before"), F.lit(cfg.capital))
    out = rows.join(before, [*runs, "_segment"]).withColumn("peak", peak)
    return out.select(*runs, "seq", "portfolio_after", "peak", ((F.col("portfolio_after") - F.col("peak")) / F.col("peak")).alias("drawdown"))


def equity_points(curve: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What a plot of the curve shows: the value after each trade, from the capital at trade 0, and whether it is above that."""
    runs = ["run"] if "run" in curve.columns else []
    start = F.struct(F.lit(0).alias("seq"), F.lit(None).cast("date").alias("signal_date"), F.lit(cfg.capital).cast("double").alias("portfolio_after"))
    point = F.struct("seq", "signal_date", "portfolio_after")
    points = curve.select(*runs, F.inline(F.when(F.col("seq") == 1, F.array(start, point)).otherwise(F.array(point))))
    return points.withColumn("above", F.col("portfolio_after") >= cfg.capital)


def metrics(done: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of figures for each run (for all trades without a `run` column); none without trades.

    Without losses the profit factor is infinite. Trades are read once.
    """
    runs = ["run"] if "run" in done.columns else []
    curve = _walk(done, cfg).withColumn("drawdown", (F.col("portfolio_after") - F.col("peak")) / F.col("peak"))
    r = F.col("net_return_pct") / 100
    won, lost = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(r <= 0, r)), F.lit(0.0)))
    rows = curve.groupBy("run").agg(
        F.count("*").alias("total_trades"), F.sum((r > 0).cast("int")).cast("long").alias("wins"), F.sum((r <= 0).cast("int")).cast("long").alias("losses"),
        F.coalesce(F.avg(F.when(r > 0, r)) * 100, F.lit(0.0)).alias("avg_win_pct"), F.coalesce(F.avg(F.when(r <= 0, r)) * 100, F.lit(0.0)).alias("avg_loss_pct"),
        F.when(lost == 0, F.lit(float("inf"))).otherwise(won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), (F.avg(r) / (F.stddev_pop(r) + 1e-9) * F.sqrt(F.lit(252.0))).alias("sharpe_ratio"),
        F.max_by("portfolio_after", "_seq").alias("final_equity"), F.min("drawdown").alias("_dd"),
    )
    growth = F.col("final_equity") / cfg.capital
    return rows.select(
        *runs, "total_trades", "wins", "losses", F.round(F.col("wins") / F.col("total_trades") * 100, 2).alias("win_rate_pct"), F.round("avg_win_pct", 3).alias("avg_win_pct"), F.round("avg_loss_pct", 3).alias("avg_loss_pct"),
        F.round("profit_factor", 3).alias("profit_factor"), F.round(F.least(F.col("_dd"), F.lit(0.0)) * 100, 2).alias("max_drawdown_pct"), F.round("sharpe_ratio", 3).alias("sharpe_ratio"),
        F.round((F.pow(growth, 1 / ((F.col("total_trades") + 1) / 252.0)) - 1) * 100, 2).alias("cagr_pct"), F.round("final_equity", 2).alias("final_equity"), F.round((growth - 1) * 100, 2).alias("total_return_pct"),
    )


def win_rates(done: DataFrame, by: str, least: int = 1) -> DataFrame:
    return done.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("win").cast("double")) * 100, 1).alias("win_rate_pct")).where(F.col("n") >= least)


def cumulative_return(rows: DataFrame, value: str) -> DataFrame:
    """Adds the growth of one unit along each symbol's bars."""
    return rows.withColumn("cumulative", F.exp(F.sum(F.log(1 + F.col(value))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts of values of 0 to 1 in bins of equal width; 1 is in the last one."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
