"""Exponential means against a plain loop, over many blocks; oscillators at their edges; gaps and clipping by hand."""

import datetime

import numpy as np
import pytest

from tidewick.operators import backtest, clean, indicators


def frame(spark, closes, symbol="A", start=datetime.date(2024, 1, 1), step=1, volume=10):
    rows = [(symbol, start + datetime.timedelta(i * step), c, c + 1, c - 1, c, volume) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume long")


@pytest.mark.parametrize("span", [3, 9, 200])
def test_exponential_mean(spark, span):
    x = np.random.default_rng(1).normal(100, 5, 900)
    got = [r[f"ema_{span}"] for r in indicators.ema(frame(spark, x), span).orderBy("bar_date").collect()]
    want, a = [x[0]], 2 / (span + 1)
    for v in x[1:]:
        want.append(want[-1] + a * (v - want[-1]))
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_rsi_is_null_without_losses(spark):
    assert all(r.rsi_14 is None for r in indicators.rsi(frame(spark, range(1, 30))).collect())


def test_gaps(spark):
    days = [datetime.date(2024, 1, d) for d in (1, 2, 5, 8, 9, 15, 16)]
    bars = spark.createDataFrame([("A", d, 1.0, 2.0, 0.5, 1.0, 5) for d in days], "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    runs = [(r.first_missing.day, r.n_days) for r in clean.gap_runs(bars).orderBy("run").collect()]
    assert runs == [(3, 2), (10, 3)]
    assert [r.bar_date.day for r in clean.fill_gaps(bars).orderBy("bar_date").collect()] == [1, 2, 3, 4, 5, 8, 9, 15, 16]


def test_clip_uses_the_close_before_clipping(spark):
    got = [r.close for r in clean.clip_outliers(frame(spark, [100, 125, 130])).orderBy("bar_date").collect()]
    assert got == pytest.approx([100, 120, 130])


def test_stop_comes_first_and_entry_skips_holidays(spark):
    bars = spark.createDataFrame(
        [("A", datetime.date(2024, 1, d), o, h, l, c, 10) for d, o, h, l, c in ((24, 100.0, 101.0, 99.0, 100.0), (25, 100.0, 101.0, 99.0, 100.0), (29, 100.0, 101.0, 99.0, 100.0), (30, 100.0, 120.0, 90.0, 100.0))],
        "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    sig = spark.createDataFrame([("A", datetime.date(2024, 1, 25), "BUY", 95.0, "none", "LOW", 0.5, 0.0)], "symbol string, bar_date date, signal string, stoploss double, pattern_detected string, confidence_score string, confidence_value double, pattern_strength double")
    t = backtest.trades(sig, bars).first()
    assert (t.entry_date, t.exit_date, t.exit_reason, t.exit_price) == (datetime.date(2024, 1, 29), datetime.date(2024, 1, 30), "STOPLOSS", 95.0)
    assert t.net_return_pct == pytest.approx(-5.436)
    p = backtest.portfolio(backtest.trades(sig, bars)).first()
    assert p.shares == 2000 and p.portfolio_after == pytest.approx(1_000_000 - 200_000 * 0.05436)


def test_registry_imports_without_text_operators():
    from tidewick.plans import registry

    assert len(registry.QUERIES) > 70 and set(registry.ORACLES) <= set(registry.QUERIES)


def test_all_means_share_four_sorts(spark):
    import datetime as dt
    import random

    from tidewick.operators import features

    r, day = random.Random(4), dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(k), *(100 + r.random() for _ in range(4)), r.randint(1, 99)) for s in ("a", "b") for k in range(700)]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume long")
    plan = features.wide(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 4 and plan.count("Exchange ") == 1
    one = indicators.every(df)
    each = indicators.macd(indicators.rsi(indicators.atr(indicators.ema(indicators.ema(indicators.ema(df, 20), 50), 200))))
    pick = lambda x: sorted(map(tuple, x.select("symbol", "bar_date", "ema_20", "ema_50", "ema_200", "atr_14", "rsi_14", "macd_line", "macd_signal", "macd_hist").collect()))
    for x, y in zip(pick(one), pick(each), strict=True):
        assert x[:2] == y[:2] and all((a is None and b is None) or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(x[2:], y[2:], strict=True))
