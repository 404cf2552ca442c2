"""One series for each pattern, with strengths worked out by hand; look-ahead and isolation of symbols."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewick.operators import features, patterns

DOWN, UP = [110.0 - i for i in range(10)], [90.0 + i for i in range(10)]
CASES = {
    "bullish_marubozu": (UP, [(100, 102, 100, 102)], 0.9), "bearish_marubozu": (UP, [(102, 102, 100, 100)], 0.9), "doji": (UP, [(100, 101, 99, 100.05)], 0.12),
    "spinning_top": (UP, [(100, 101.2, 99, 100.4)], 0.2455), "hammer": (DOWN, [(100, 100.5, 98, 100.4)], 0.228), "hanging_man": (UP, [(100, 100.5, 98, 100.4)], 0.228),
    "shooting_star": (UP, [(100, 102.4, 99.9, 100.4)], 0.228), "none": (DOWN, [(100, 102.4, 99.9, 100.4)], None),
    "bullish_engulfing": (DOWN, [(101, 101.2, 99.8, 100), (99.5, 101.8, 99.3, 101.5)], 0.64), "bearish_engulfing": (UP, [(100, 101.2, 99.8, 101), (101.5, 101.7, 99.2, 99.5)], 0.64),
    "piercing_pattern": (DOWN, [(102, 102.2, 99.8, 100), (99.5, 101.7, 99.3, 101.5)], 0.6667), "dark_cloud_cover": (UP, [(100, 102.2, 99.8, 102), (102.5, 102.7, 100.3, 100.5)], 0.6667),
    "bullish_harami": (UP, [(102, 102.2, 99.8, 100), (100.5, 101.6, 100.1, 101.2)], 0.3733), "bearish_harami": (UP, [(100, 102.2, 99.8, 102), (101.5, 101.9, 100.4, 100.8)], 0.3733),
    "morning_star": (DOWN, [(102, 102.2, 99.8, 100), (99.2, 99.9, 98.7, 99.4), (99.6, 101.8, 99.3, 101.6)], 0.84),
    "evening_star": (UP, [(100, 102.2, 99.8, 102), (102.6, 103.3, 102.1, 102.8), (102.4, 102.7, 100.2, 100.4)], 0.84),
}


def series(spark):
    rows = []
    for name, (prefix, after, _) in CASES.items():
        candles = [(c, c + 0.2, c - 0.2, c) for c in prefix] + after
        for i, (o, h, l, c) in enumerate(candles):
            volume = 2000 if name.endswith("ing_star") and name != "shooting_star" and i == len(candles) - 1 else 1000
            rows.append((name, datetime.date(2024, 1, 1) + datetime.timedelta(i), float(o), float(h), float(l), float(c), volume))
    return spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume long")


def test_each_pattern(spark):
    last = {r.symbol: r for r in patterns.tag(series(spark)).groupBy("symbol").agg(F.max_by(F.struct("pattern_name", "pattern_strength"), "bar_date").alias("x")).collect()}
    for name, (_, _, strength) in CASES.items():
        x = last[name].x
        assert (x.pattern_name or "none") == name
        if strength is not None:
            assert x.pattern_strength == pytest.approx(strength, abs=1e-4)


def test_one_pattern_a_bar_and_no_look_ahead(spark):
    bars = series(spark).where("symbol in ('morning_star', 'hammer')").cache()
    flags = patterns.flags(patterns.tag(bars))
    assert flags.select(F.max(sum(F.col(f"pat_{n}") for n in patterns.NAMES))).first()[0] <= 1
    whole = {(r.symbol, r.bar_date): r for r in features.wide(bars).drop("forward_return_5d", "target_label").collect()}
    part = features.wide(bars.where("symbol = 'hammer' and bar_date < date '2024-01-09'")).drop("forward_return_5d", "target_label").collect()
    for r in part:
        for name, value in r.asDict().items():
            other = whole[r.symbol, r.bar_date][name]
            assert value == other or value == pytest.approx(other, rel=1e-9)
