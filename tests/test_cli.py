"""The command line from CSV files to a backtest, and the small operators beside the main path, on made-up rows."""

import datetime as dt
import json
import os
import random

import pytest

from tidewick import cli
from tidewick.operators import backtest, clean, model, signals
from tidewick.plans import registry
from tidewick.sources import bars as source
from tidewick.sources import checked


def csv_folder(folder, days=460):
    """Two symbols with a bar on each weekday, and one with too few."""
    r = random.Random(5)
    for symbol, n in (("AA_NS", days), ("BB_NS", days), ("CC_NS", 20)):
        close, day, lines = 100.0, dt.date(2022, 1, 3), ["Date,Open,High,Low,Close,Volume"]
        for _ in range(n):
            opened, close = close * (1 + r.gauss(0, 0.004)), close * (1 + r.gauss(0, 0.02))
            high, low = max(opened, close) * (1 + abs(r.gauss(0, 0.006))), min(opened, close) * (1 - abs(r.gauss(0, 0.006)))
            lines.append(f"{day},{opened:.4f},{high:.4f},{low:.4f},{close:.4f},{r.randint(1_000, 9_000)}")
            day += dt.timedelta(3 if day.weekday() == 4 else 1)
        (folder / f"{symbol}.csv").write_text("\n".join(lines) + "\n")


def figures(path):
    rows = []
    for name in os.listdir(path):
        if name.endswith(".json"):
            rows += [json.loads(x) for x in open(os.path.join(path, name)).read().splitlines()]
    return rows


def test_command_line_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    csv_folder(raw)
    at = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.main(list(argv), spark)
    run("load", "--raw", str(raw), "--out", at("bars"), "--min-days", "100")
    loaded = source.read_bars(spark, at("bars"))
    assert {x.symbol: x.n_rows for x in source.summary(loaded).collect()} == {"AA.NS": 460, "BB.NS": 460}
    run("preprocess", "--bars", at("bars"), "--out", at("clean"))
    run("features", "--bars", at("clean"), "--out", at("features"))
    run("train", "--features", at("features"), "--out", at("model"), "--rounds", "3")
    run("evaluate", "--features", at("features"), "--model", at("model"), "--out", at("judged"))
    (one,) = figures(at("judged/metrics"))
    assert one["n"] > 20 and 0 <= one["accuracy"] <= 1
    assert len(figures(at("judged/importances"))) == 20 and [x["place"] for x in figures(at("judged/attributions"))][:1] == [1]
    run("predict", "--bars", at("clean"), "--model", at("model"), "--out", at("predicted"))
    assert {x["symbol"] for x in figures(at("predicted"))} == {"AA.NS", "BB.NS"}
    run("signals", "--bars", at("clean"), "--model", at("model"), "--out", at("found"))
    found = spark.read.parquet(at("found/signals"))
    assert found.where("pattern_direction is null or signal is null").count() == 0
    run("backtest", "--bars", at("clean"), "--signals", at("found/signals"), "--out", at("trades"))
    done = spark.read.parquet(at("trades"))
    assert done.count() == spark.read.option("header", True).csv(at("trades_csv")).count()
    assert sum(x["total_trades"] for x in figures(at("trades_summary"))) == done.count()
    pages = [r.value for r in spark.read.text(at("found/text")).collect()]
    assert any(x.startswith("Signals of 20") for x in pages)
    back = checked.read_reports(spark, at("found/report"), ["symbol", "bar_date", "rank", "confidence_value", "signal"])
    report = signals.daily_report(found)
    pick = lambda df: sorted((r.symbol, r.bar_date, r.rank, round(r.confidence_value, 6), r.signal) for r in df.collect())
    assert pick(back) == pick(report)


def test_one_command_runs_all_and_keeps_what_is_there(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    csv_folder(raw)
    (raw / "DD.csv").write_text("Date,Open\n2024-01-01,1\n")
    argv = ["run", "--raw", str(raw), "--out", str(tmp_path / "work"), "--min-days", "100", "--rounds", "2", "--most-open", "1"]
    cli.main(argv, spark)
    assert [x["reason"] for x in figures(tmp_path / "work/bars_bad")] == ["no column high, low, close, volume"]
    done = spark.read.parquet(str(tmp_path / "work/trades")).collect()
    spans = sorted((x.entry_date, x.exit_date) for x in done)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_what_the_chain_keeps(spark, tmp_path, monkeypatch):
    called = []
    for verb in ("load", "preprocess", "features", "train", "evaluate", "signals", "backtest"):
        monkeypatch.setattr(cli.Job, verb, lambda self, *paths, v=verb: called.append(v) or os.makedirs(paths[-1], exist_ok=True))
    every = ["load", "preprocess", "features", "train", "evaluate", "signals", "backtest"]
    argv = ["run", "--raw", "raw", "--out", str(tmp_path / "work")]
    for more, left_out in (["--skip-fetch"], []), ([], ["train"]), (["--skip-fetch"], ["load", "train"]), (["--skip-fetch", "--retrain"], ["load"]):
        called.clear()
        cli.main([*argv, *more], spark)
        assert called == [v for v in every if v not in left_out], more


def test_direction_falls_back_to_the_number(spark):
    rows = spark.createDataFrame([("bullish", -1), (None, -1), ("", 1), ("neutral", 1), ("neutral", 0), (None, None)], "pattern_direction string, pattern_direction_num int")
    assert [x.pattern_direction for x in signals.direction(rows).collect()] == ["bullish", "bearish", "bullish", "bullish", "neutral", "neutral"]
    assert [x.pattern_direction for x in signals.direction(rows.drop("pattern_direction_num")).collect()] == ["bullish", "neutral", "neutral", "neutral", "neutral", "neutral"]


def test_defaults_only_where_a_column_is_missing(spark):
    rows = spark.createDataFrame([("A", 100.0, "HIGH")], "symbol string, entry_price double, confidence_score string")
    (x,) = backtest.with_defaults(rows).collect()
    assert (x.stoploss, x.confidence_score, x.confidence_value, x.pattern_detected, x.pattern_strength) == (98.0, "HIGH", 0.0, "none", 0.0)


def test_report_averages_and_grid(spark):
    scored = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (-1, 1)], "target_label int, prediction int")
    found = {x.average: x for x in model.report_averages(model.class_report(scored)).collect()}
    assert found["macro"].precision == pytest.approx((0 + 1 / 2 + 2 / 3) / 3) and found["macro"].support == 5
    assert found["weighted"].recall == pytest.approx(3 / 5)
    grid = {(x.target_label, x.prediction): (x.n, x.share) for x in model.confusion_grid(scored).collect()}
    assert len(grid) == 9 and grid[1, 1] == (2, pytest.approx(2 / 3)) and grid[-1, 0] == (0, 0.0)


def test_loads_counts_and_sinks(spark, tmp_path):
    asked = spark.createDataFrame([("A",), ("B",), ("B",)], "symbol string")
    bar = "symbol string, open double, high double, low double, close double"
    have = spark.createDataFrame([("A", 1.0, float("inf"), 1.0, None), ("A", 1.0, 1.0, 1.0, 1.0)], bar)
    assert [x.symbol for x in source.pending(asked, have).collect()] == ["B"]
    assert {x.status: x.n for x in source.load_status(asked, have).collect()} == {"ok": 1, "failed": 1}
    raw = have.unionByName(spark.createDataFrame([("B", 1.0, 1.0, 1.0, 1.0)], bar))
    assert {x.symbol: (x.n_raw, x.n_clean, x.n_infinite) for x in clean.clean_counts(raw, have).collect()} == {"A": (2, 2, 1), "B": (1, 0, 0)}
    source.write_metrics({"b": 1.5, "a": "x"}, spark, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["b", "a"] and back.first().asDict() == {"b": "1.5", "a": "x"}
    symbols = spark.createDataFrame([("A.NS",), ("M&M/X",)], "symbol string")
    assert [x[0] for x in symbols.select(source.file_name(symbols.symbol)).collect()] == ["A_NS.csv", "M&M-X.csv"]


def test_equity_starts_at_the_capital_for_each_run(spark):
    curve = spark.createDataFrame([(0, 1, dt.date(2025, 1, 1), 900_000.0), (0, 2, dt.date(2025, 1, 2), 1_200_000.0), (1, 1, dt.date(2025, 1, 1), 5.0)], "run int, seq int, signal_date date, portfolio_after double")
    found = sorted((x.run, x.seq, x.above) for x in backtest.equity_points(curve).collect())
    assert found == [(0, 0, True), (0, 1, False), (0, 2, True), (1, 0, True), (1, 1, False)]


def test_sql_is_text_for_registered_queries():
    assert all(isinstance(v, str) for v in registry.ORACLES.values()) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"model_predict", "model_evaluate", "model_classes", "model_named", "model_signals", "model_attributions", "model_importances"}
