"""Files of differing headers and doubtful content, reports read back, and a load that breaks off and goes on."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewick.operators import signals
from tidewick.sources import bars as source
from tidewick.sources import checked, load


def test_csv_files_of_differing_headers(spark, tmp_path):
    (tmp_path / "AA_NS.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\n\n2024-01-02,1,2,0.5,x,11\n2024-01-03,,2,0.5,1,12\n")
    (tmp_path / "BB.csv").write_text('﻿ volume ,"Adj Close",CLOSE,low,HIGH,open,date,other\n20,1.4,1.5,0.5,2,1,2024-02-01,"a, b"\n21,1.4,1.5,0.5,2,1,1st of May,\n')
    (tmp_path / "CC.csv").write_text("Date,Open,High,Low,Close\n2024-01-01,1,2,0.5,1.5\n")
    (tmp_path / "DD.csv").write_text("")
    (tmp_path / "EE.csv").write_text("Date,Open,High,Low,Close,Volume\n")
    good, bad = checked.read_csv_bars(spark, str(tmp_path))
    assert {tuple(r) for r in good.collect()} == {("AA.NS", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, None, 10), ("BB", dt.date(2024, 2, 1), 1.0, 2.0, 0.5, 1.5, 1.4, 20)}
    got = {(os.path.basename(r.file), (r.line or "")[:10], r.reason) for r in bad.collect()}
    assert got == {
        ("AA_NS.csv", "2024-01-02", "close isn't a double"), ("AA_NS.csv", "2024-01-03", "open is missing"), ("BB.csv", "21,1.4,1.5", "date isn't a date"),
        ("CC.csv", "", "no column volume"), ("DD.csv", "", "empty file"),
    }


def test_bad_parquet_files_are_set_aside(spark, tmp_path):
    schema = spark.createDataFrame([], "symbol string, bar_date date, close double, volume bigint").schema
    path = tmp_path / "bars"
    path.mkdir()
    for k in range(3):
        pd.DataFrame({"symbol": [f"S{k}"] * 50, "bar_date": [dt.date(2024, 1, 1)] * 50, "close": [1.0 * k] * 50, "volume": range(50)}).to_parquet(path / f"good{k}.parquet")
    whole = (path / "good0.parquet").read_bytes()
    (path / "truncated.parquet").write_bytes(whole[: len(whole) // 2])
    (path / "broken.parquet").write_bytes(whole[:40] + bytes(60) + whole[100:])
    (path / "empty.parquet").write_bytes(b"")
    pd.DataFrame({"symbol": ["X"], "bar_date": [dt.date(2024, 1, 1)], "close": ["1.0"], "volume": [1]}).to_parquet(path / "typed.parquet")
    pd.DataFrame({"symbol": ["X"], "bar_date": [dt.date(2024, 1, 1)], "volume": [1]}).to_parquet(path / "lacking.parquet")
    good, bad = checked.read_parquet(spark, str(path), schema)
    reasons = {os.path.basename(r.file): r.reason for r in bad.collect()}
    assert set(reasons) == {"truncated.parquet", "broken.parquet", "empty.parquet", "typed.parquet", "lacking.parquet"}
    assert reasons["empty.parquet"] == "empty file" and reasons["typed.parquet"] == "other type: close" and reasons["lacking.parquet"] == "no column close" and reasons["truncated.parquet"].startswith("unreadable")
    assert {r.symbol: r.n for r in good.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"S0": 50, "S1": 50, "S2": 50}


def test_reports_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, k), 0.1 * k, "BUY", k) for k in (1, 2)], "symbol string, bar_date date, confidence_value double, signal string, rank int")
    source.write_report(rows, str(tmp_path / "one"))
    source.write_report(rows.select("signal", "symbol", F.lit("doji").alias("pattern_detected"), "bar_date"), str(tmp_path / "two"))
    back = checked.read_reports(spark, [str(tmp_path / "one"), str(tmp_path / "two")], ["symbol", "bar_date", "confidence_value", "signal", "rank", "pattern_detected"])
    got = sorted(map(tuple, back.collect()), key=str)
    want = [("A", dt.date(2024, 1, k), pytest.approx(0.1 * k), "BUY", k, None) for k in (1, 2)] + [("A", dt.date(2024, 1, k), None, "BUY", None, "doji") for k in (1, 2)]
    assert all(any(g == w for w in want) for g in got) and len(got) == 4


def one(symbol, where):
    """A source that fails for some symbols, always or at first; how often it was asked is kept in files."""
    with open(os.path.join(where, symbol), "a") as f:
        f.write("x")
    asked = os.path.getsize(os.path.join(where, symbol))
    if symbol == "never" or symbol == "twice" and asked < 3 or symbol == "later" and not os.path.exists(os.path.join(where, "now")):
        raise OSError(f"no answer to {symbol}")
    n = 1 if symbol == "short" else 5
    return pd.DataFrame({"bar_date": [dt.date(2024, 1, 1 + k) for k in range(n)], "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "adj_close": 1.5, "volume": 10})


def test_a_load_breaks_off_and_goes_on(spark, tmp_path, monkeypatch):
    asked, folder = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()
    symbols = [f"S{k}" for k in range(12)] + ["never", "twice", "later", "short", "S3"]
    listing = spark.createDataFrame([(s, str(asked)) for s in symbols], "symbol string, where string")
    assert load.loaded(spark, folder).collect() == [] and load.status(spark, folder).collect() == []

    # the driver dies after a batch's bars are written, before its statuses are
    writes = {"n": 0}
    plain = load.F.count

    def breaks(*a):
        writes["n"] += 1
        if writes["n"] == 3:
            raise KeyboardInterrupt
        return plain(*a)

    monkeypatch.setattr(load.F, "count", breaks)
    with pytest.raises(KeyboardInterrupt):
        load.load(listing, one, folder, together=4, least=2)
    monkeypatch.setattr(load.F, "count", plain)
    before = {r.symbol: r for r in load.status(spark, folder).collect()}
    done = {s for s, r in before.items() if r.status == "ok"}
    assert 0 < len(before) < 16 and {r.symbol for r in load.loaded(spark, folder).collect()} == done
    counts = {s: os.path.getsize(asked / s) for s in done}

    after = {r.symbol: r for r in load.load(listing, one, folder, together=4, least=2).collect()}
    assert {s for s, r in after.items() if r.status == "ok"} == {f"S{k}" for k in range(12)} | {"twice"}
    assert {s: os.path.getsize(asked / s) for s in done} == counts  # what was ok isn't asked for again
    assert after["never"].attempts == 3 and "no answer" in after["never"].error and after["short"].error.endswith("1 bars, 2 needed") and after["S0"].n_rows == 5
    assert {r.symbol for r in load.pending(listing, folder).collect()} == {"never", "later", "short"}
    (asked / "now").write_text("")
    last = {r.symbol: r.status for r in load.load(listing, one, folder, together=4, least=2).collect()}
    assert last["later"] == "ok" and last["never"] == "failed"
    bars = load.loaded(spark, folder).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in bars} == {s: 5 for s in {*(f"S{k}" for k in range(12)), "twice", "later"}}


def test_report_text_of_a_day(spark):
    row = dict(symbol="A", bar_date=dt.date(2024, 1, 2), rank=1, pattern_detected="doji", pattern_direction=None, p_bull=0.5, p_bear=0.25, confidence_value=0.6, confidence_score="MEDIUM", signal="BUY", signal_strength="MODERATE", entry_price=10.0, stoploss=9.0, risk_pct=10.0)
    kinds = "symbol string, bar_date date, rank int, pattern_detected string, pattern_direction string, p_bull double, p_bear double, confidence_value double, confidence_score string, signal string, signal_strength string, entry_price double, stoploss double, risk_pct double"
    report = spark.createDataFrame([tuple(row.values())], kinds)
    lines = [r.line for r in signals.report_page(report).orderBy("bar_date", "rank").collect()]
    assert lines[0] == "Signals of 2024-01-02" and lines[1].split()[:2] == ["symbol", "pattern"] and lines[-1].startswith("A ") and len(lines) == 3
