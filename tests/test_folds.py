"""Running sums, ranks and folds in segments against plain Python; position limits against a plain sweep."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewick.config import DEFAULT
from tidewick.functions.prefix import ranked, running
from tidewick.operators import backtest, model
from tidewick.sources import bars as source


def test_running_sums_of_hot_and_null_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(2_000)]), k, r.randint(-5, 9)) for k in range(1_500)]
    df = spark.createDataFrame(rows, "g string, x int, id int, v int").repartition(7)
    got = {x.id: (x.total, x.place) for x in ranked(running(df, ["g"], ["x", "id"], F.col("v"), "total"), ["g"], ["x", "id"], "place").collect()}
    first = lambda v: (v is not None, v if v is not None else 0)
    want, sums = {}, {}
    for g, x, i, v in sorted(rows, key=lambda t: (first(t[1]), t[2])):
        total, place = sums.get(g, (0, 0))
        sums[g] = want[i] = total + v, place + 1
    assert got == want
    whole = {x.id: x.n for x in ranked(df, [], ["x", "id"], "n").collect()}
    assert whole == {t[2]: k + 1 for k, t in enumerate(sorted(rows, key=lambda t: (first(t[1]), t[2])))}
    assert ranked(df.where("false"), ["g"], ["x"], "n").collect() == []


def test_no_window_over_all_rows(spark):
    df = spark.range(1_000).selectExpr("id % 3 as g", "id as x")
    plan = ranked(df, [], ["x"], "n")._jdf.queryExecution().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # over rows: by partition; over partitions: the sums alone
    assert windows and all("_part" in line for line in windows)


def trades(n, runs=1, seed=1):
    r, day = random.Random(seed), dt.date(2025, 1, 1)
    out = []
    for k in range(n):
        entered = day + dt.timedelta(k // 11)
        out.append((k % runs, entered - dt.timedelta(1), f"S{r.randint(0, 30):03d}", 50 + 50 * r.random(), 45 + 50 * r.random(), round(4 * r.random() - 1.95, 3), entered, entered + dt.timedelta(r.randint(0, 6)), round(100 * r.random(), 2)))
    return out


KINDS = "run int, signal_date date, symbol string, entry_open double, stoploss double, net_return_pct double, entry_date date, exit_date date, entry_price double"


def plain_curve(rows):
    value, peak, out = DEFAULT.capital, DEFAULT.capital, []
    for x in sorted(rows, key=lambda x: x[1:6]):
        entry, stop, pct = x[3:6]
        shares = max(1, math.floor(DEFAULT.risk * value / abs(entry - stop)))
        if shares * entry > DEFAULT.max_notional * value:
            shares = max(1, math.floor(DEFAULT.max_notional * value / entry))
        value += shares * entry * (pct / 100)
        peak = max(peak, value)
        out.append((shares, value, peak))
    return out


@pytest.mark.parametrize("segment", [1, 37, 1_000])
def test_curves_of_runs_in_segments(spark, segment):
    rows = trades(300 if segment > 1 else 12, runs=3)
    df = spark.createDataFrame(rows, KINDS)
    curve = backtest.portfolio(df, segment=segment)
    falls = {(x.run, x.seq): (x.peak, x.drawdown) for x in backtest.drawdown(curve, segment=segment).collect()}
    for run in range(3):
        got = [x for x in curve.orderBy("run", "seq").collect() if x.run == run]
        want = plain_curve([x for x in rows if x[0] == run])
        assert [(x.seq, x.shares, round(x.portfolio_after, 6)) for x in got] == [(k + 1, s, round(v, 6)) for k, (s, v, _) in enumerate(want)]
        assert all(falls[run, k + 1] == pytest.approx((p, (v - p) / p)) for k, (_, v, p) in enumerate(want))


def test_a_long_run_in_segments(spark):
    rows = trades(200_000, seed=2)
    df = spark.createDataFrame(rows, KINDS).drop("run")
    want = plain_curve(rows)
    curve = backtest.portfolio(df, segment=40_000)
    last = curve.orderBy(F.desc("seq")).first()
    assert (last.seq, last.shares) == (200_000, want[-1][0]) and last.portfolio_after == pytest.approx(want[-1][1], rel=1e-12)
    assert curve.agg(F.sum("shares")).first()[0] == sum(s for s, _, _ in want)


def plain_limits(rows, most):
    held, out = {}, {}
    for x in sorted(rows, key=lambda x: (x[6], x[1], x[2], x[7], x[8], x[5])):
        held = {s: d for s, d in held.items() if d >= x[6]}
        out[x] = len(held) < most and x[2] not in held
        if out[x]:
            held[x[2]] = x[7]
    return out


@pytest.mark.parametrize("segment", [5, 10_000])
def test_position_limits(spark, segment):
    rows = trades(120, runs=2, seed=3)
    df = spark.createDataFrame([(None if x[0] else 0, *x[1:], "kept") for x in rows], KINDS + ", seq string")
    for most in (1, 3, 100):
        found = backtest.position_limits(df, most, segment)
        assert found.columns == [*df.columns, "taken"]
        got = {tuple(x)[1:9]: x.taken for x in found.collect()}
        want = {x[1:]: v for run in range(2) for x, v in plain_limits([x for x in rows if x[0] == run], most).items()}
        assert got == want and 0 < sum(got.values()) < len(got)
    assert backtest.position_limits(df.where("false"), 3).collect() == []


def test_areas_under_curves_against_pairs(spark):
    r = random.Random(6)
    rows = [(r.choice((-1, 0, 1)), *(round(r.random(), 1) for _ in range(3))) for _ in range(200)]
    got = {x.label: x.auc for x in model.auc_ovr(spark.createDataFrame(rows, "target_label int, p_bear double, p_neutral double, p_bull double")).collect()}
    for k, c in enumerate((-1, 0, 1)):
        hits, others = [x[k + 1] for x in rows if x[0] == c], [x[k + 1] for x in rows if x[0] != c]
        assert got[c] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in hits for b in others) / len(hits) / len(others))


def test_places_of_first_occurrences(spark):
    rows = [("b", 3), ("a", 1), ("c", 2), ("a", 9), ("b", 0), (None, 5)]
    found = source.ordered_distinct(spark.createDataFrame(rows, "s string, at int"), "s", "at").collect()
    assert [x.s for x in sorted(found, key=lambda x: x.place)] == ["b", "a", "c", None] and sorted(x.place for x in found) == [1, 2, 3, 4]
