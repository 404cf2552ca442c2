"""The portfolio fold, its figures, and the gates and lookups of the model path, against plain Python."""

import datetime as dt
import math
import random

import pytest

from tidewick.config import DEFAULT
from tidewick.operators import backtest, model


def trades(spark, n, runs=1, seed=1):
    r = random.Random(seed)
    day = dt.date(2025, 1, 1)
    rows = [(k % runs, day + dt.timedelta(k // 7), f"S{k:05d}", 50 + 50 * r.random(), 45 + 50 * r.random(), round(4 * r.random() - 1.9, 3)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "run int, signal_date date, symbol string, entry_open double, stoploss double, net_return_pct double")


def folded(rows):
    value, out = DEFAULT.capital, []
    for _, _, _, entry, stop, pct in sorted(rows, key=lambda x: x[1:3]):
        shares = max(1, math.floor(DEFAULT.risk * value / abs(entry - stop)))
        if shares * entry > DEFAULT.max_notional * value:
            shares = max(1, math.floor(DEFAULT.max_notional * value / entry))
        value += shares * entry * pct / 100
        out.append((shares, round(value, 4)))
    return out


def test_runs_fold_side_by_side(spark):
    rows, df = trades(spark, 200, runs=3)
    curve = backtest.portfolio(df).orderBy("run", "seq").collect()
    falls = {(x.run, x.seq): x.drawdown for x in backtest.drawdown(backtest.portfolio(df)).collect()}
    for run in range(3):
        mine, want = [x for x in curve if x.run == run], folded([x for x in rows if x[0] == run])
        assert [(x.shares, round(x.portfolio_after, 4)) for x in mine] == want and [x.seq for x in mine] == list(range(1, len(want) + 1))
        peak = DEFAULT.capital
        for x in mine:
            peak = max(peak, x.portfolio_after)
            assert abs(falls[run, x.seq] - (x.portfolio_after - peak) / peak) < 1e-12
    found = {x.run: x for x in backtest.metrics(df).collect()}
    assert sorted(found) == [0, 1, 2] and all(x.total_trades == len([y for y in rows if y[0] == run]) for run, x in found.items())


def test_figures_without_losses_and_without_trades(spark):
    _, df = trades(spark, 30)
    good = df.drop("run").selectExpr("* except (net_return_pct)", "abs(net_return_pct) + 0.1 as net_return_pct")
    x = backtest.metrics(good).first()
    assert x.losses == 0 and x.profit_factor == math.inf and x.max_drawdown_pct == 0
    assert backtest.metrics(good.where("false")).collect() == [] and backtest.portfolio(good.where("false")).columns[0] == "seq"


def test_gates_folds_and_lookups(spark):
    day = dt.date(2025, 1, 1)
    rows = spark.createDataFrame([("A", day + dt.timedelta(k), k % 3 - 1, k % 3 - 1, 0.2, 0.5, 0.3) for k in range(60)], "symbol string, bar_date date, target_label int, prediction int, p_bear double, p_neutral double, p_bull double")
    with pytest.raises(ValueError, match="too few rows"):
        model.train_model(rows)
    fold = model.last_fold(rows).groupBy("fold").count().collect()
    assert {x["fold"]: x["count"] for x in fold} == {"fit": 50, "validate": 10}
    assert model.predict_single(rows, "A", "2025-01-03")["predicted_class"] == "bullish" and "error" in model.predict_single(rows, "B", "2025-01-03")
    x = model.evaluate(rows).first()
    assert (x.n, x.accuracy, x.roc_auc_macro) == (60, 1.0, 0.5)


def test_counts_and_direction_are_never_scaled():
    from tidewick.operators.features import BINARY

    assert {"candle_direction", "pattern_direction_num", "pattern_candle_count", "macd_crossover"} <= set(BINARY)
