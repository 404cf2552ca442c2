"""Fifteen candlestick patterns as column expressions over the last three bars of a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.windows import by_symbol, lag, last_rows

#: Pattern names.
SINGLE = ["bullish_marubozu", "bearish_marubozu", "spinning_top", "doji", "hammer", "hanging_man", "shooting_star"]
DOUBLE = ["bullish_engulfing", "bearish_engulfing", "piercing_pattern", "dark_cloud_cover", "bullish_harami", "bearish_harami"]
TRIPLE = ["morning_star", "evening_star"]
NAMES = SINGLE + DOUBLE + TRIPLE

#: The names of each class in the order in which the first that fits wins, and their directions.
ORDER = {3: TRIPLE, 2: DOUBLE, 1: ["bullish_marubozu", "bearish_marubozu", "doji", "spinning_top", "hammer", "hanging_man", "shooting_star"]}
BULLISH = ["bullish_marubozu", "hammer", "bullish_engulfing", "piercing_pattern", "bullish_harami", "morning_star"]
NEUTRAL = ["doji", "spinning_top"]


def direction(name: Column) -> Column:
    return F.when(name.isin(BULLISH), "bullish").when(name.isin(NEUTRAL), "neutral").when(name.isNotNull(), "bearish")


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _trend(until: int, cfg: Config) -> Column:
    """Direction of the least-squares line through the closes of the bars before the pattern."""
    frame = last_rows(cfg.trend_window, until)
    slope = F.regr_slope("close", "_i").over(frame) / F.nullif(F.avg("close").over(frame), F.lit(0.0))
    return F.when(F.count("close").over(frame) < 2, "neutral").when(slope > cfg.flat_slope, "up").when(slope < -cfg.flat_slope, "down").otherwise("neutral")


def _candles(bars: DataFrame, cfg: Config) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = bars.withColumns({
        "_i": F.row_number().over(by_symbol()).cast("double"), "_b": F.abs(c - o), "_us": h - F.greatest(o, c), "_ls": F.least(o, c) - l, "_tr": h - l,
        "_bull": c >= o, "_mid": (o + c) / 2, "_vavg": F.avg("volume").over(last_rows(cfg.volume_window)),
    })
    share = F.col("_tr") / F.nullif(c, F.lit(0.0))
    out = out.withColumns({
        "_btr": F.when(F.col("_tr") <= 0, 0.0).otherwise(F.col("_b") / F.nullif("_tr", F.lit(0.0))),
        "_ok": F.coalesce((c > 0) & (share >= cfg.pattern_min_range) & (share <= cfg.pattern_max_range), F.lit(False)),
        "_vr": F.col("volume") / F.when(F.col("_vavg") > 0, F.col("_vavg")).otherwise(1.0),
    })
    names = ["open", "high", "low", "close", "volume", "_b", "_tr", "_btr", "_bull", "_mid", "_ok"]
    return out.withColumns({f"{n}{k}": lag(n, k) for k in (1, 2) for n in names} | {f"_t{k}": _trend(-k, cfg) for k in (1, 2, 3)} | {"_d1": lag("bar_date", 1), "_d2": lag("bar_date", 2)})


def _rules(cfg: Config) -> dict[str, Column]:
    x = F.col
    o, h, l, c, b, tr, us, ls, btr, bull = (x(n) for n in ("open", "high", "low", "close", "_b", "_tr", "_us", "_ls", "_btr", "_bull"))
    ok, up = x("_ok"), x("_t1") == "up"
    hammer = _all(ok, ls >= 2 * b, us <= 0.1 * tr, b > 0, F.least(o, c) >= l + 0.7 * tr)
    full = _all(ok, btr >= 0.95, ls <= 0.05 * b, us <= 0.05 * b)
    rules = {
        "bullish_marubozu": full & bull, "bearish_marubozu": full & ~bull,
        "doji": _all(ok, b <= 0.05 * tr, us > 0, ls > 0), "spinning_top": _all(ok, btr <= 0.35, us >= 0.25 * tr, ls >= 0.25 * tr),
        "hanging_man": hammer & up, "hammer": hammer & ~up, "shooting_star": _all(ok, us >= 2 * b, ls <= 0.1 * tr, b > 0, F.greatest(o, c) <= l + 0.3 * tr, up),
    }
    # the bar before is 1, this bar 2
    two, bull1, o1, h1, l1, c1, b1, mid1 = ok & x("_ok1"), x("_bull1"), x("open1"), x("high1"), x("low1"), x("close1"), x("_b1"), x("_mid1")
    up2, down2, small = x("_t2") == "up", x("_t2") == "down", (b1 > 0) & (b > 0) & (b < 0.5 * b1)
    rules |= {
        "bullish_engulfing": _all(two, ~bull1, bull, o < c1, c > o1, down2), "bearish_engulfing": _all(two, bull1, ~bull, o > c1, c < o1, up2),
        "piercing_pattern": _all(two, ~bull1, bull, o < l1, c > mid1, c < o1, down2), "dark_cloud_cover": _all(two, bull1, ~bull, o > h1, c < mid1, c > o1, up2),
        "bullish_harami": _all(two, ~bull1, bull, small, o > c1, c < o1), "bearish_harami": _all(two, bull1, ~bull, small, o < c1, c > o1),
    }
    # two bars before is 1, the bar before 2, this bar 3
    three, long1, short2 = ok & x("_ok2"), x("_b2") > 0.5 * x("_tr2"), x("_btr1") <= 0.35
    more, up3, down3, first_mid = x("volume") > x("volume2"), x("_t3") == "up", x("_t3") == "down", x("_mid2")
    body_top, body_low = F.greatest(x("open1"), x("close1")), F.least(x("open1"), x("close1"))
    rules |= {
        "morning_star": _all(three, ~x("_bull2"), bull, long1, short2, body_top < x("close2"), c > first_mid, more, down3),
        "evening_star": _all(three, x("_bull2"), ~bull, long1, short2, body_low > x("close2"), c < first_mid, more, up3),
    }
    return rules


def tag(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Bars with their pattern: name, direction, type, candles, strength, confirmation, trend before it, first day.

    A pattern of three bars wins over one of two, and that over a single one; bars without any have nulls. All frames
    share one order of each symbol's bars.
    """
    rules = _rules(cfg)
    flat = _candles(bars, cfg)
    name = F.coalesce(*[F.when(F.coalesce(rules[n], F.lit(False)), n) for k in (3, 2, 1) for n in ORDER[k]])
    flat = flat.withColumn("pattern_name", name)
    candles = F.when(F.col("pattern_name").isin(TRIPLE), 3).when(F.col("pattern_name").isin(DOUBLE), 2).when(F.col("pattern_name").isNotNull(), 1)
    flat = flat.withColumn("num_candles", candles)
    of = lambda one, two, three: F.when(F.col("num_candles") == 1, one).when(F.col("num_candles") == 2, two).when(F.col("num_candles") == 3, three)
    confirmed = F.col("_vr") >= cfg.volume_confirm
    flat = flat.withColumn("volume_confirm", of(confirmed, confirmed, F.col("volume") > F.col("volume2")))
    score = F.when(F.col("_vr") > 0, F.least(F.col("_vr") / 2, F.lit(1.0))).otherwise(0.5)
    single = F.least(0.5 * F.col("_btr") + 0.3 * (1 - (F.col("_us") + F.col("_ls")) / (F.col("_tr") + 1e-9)) + 0.2 * score, F.lit(1.0))
    multi = F.least(0.8 * F.col("_btr") + F.when(F.col("volume_confirm"), 0.2).otherwise(0.0), F.lit(1.0))
    flat = flat.withColumns({
        "pattern_direction": direction(F.col("pattern_name")), "pattern_type": F.when(F.col("num_candles") == 1, "single").when(F.col("num_candles") > 1, "multi"),
        "pattern_strength": F.round(of(single, multi, multi), 4), "prior_trend": of(F.col("_t1"), F.col("_t2"), F.col("_t3")), "pattern_start": of(F.col("bar_date"), F.col("_d1"), F.col("_d2")),
        "volume_vs_average": F.col("_vr"), "body_share": F.col("_btr"),
    })
    return flat.select(*bars.columns, "pattern_name", "pattern_direction", "pattern_type", "num_candles", "pattern_strength", "volume_confirm", "prior_trend", "pattern_start", "volume_vs_average", "body_share")


def events(tagged: DataFrame) -> DataFrame:
    found = tagged.where(F.col("pattern_name").isNotNull())
    return found.select("symbol", "pattern_name", "pattern_type", F.col("pattern_direction").alias("direction"), "pattern_start", F.col("bar_date").alias("pattern_end"), "num_candles", "pattern_strength", "volume_confirm", "prior_trend")


def flags(tagged: DataFrame) -> DataFrame:
    """Bars with one 0/1 column for each pattern; texts are empty and strengths 0 where there is none."""
    out = tagged.withColumns({f"pat_{n}": F.coalesce(F.col("pattern_name") == n, F.lit(False)).cast("int") for n in NAMES})
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("pattern_name", "pattern_direction", "pattern_type", "prior_trend")} | {"pattern_strength": F.coalesce("pattern_strength", F.lit(0.0))})


def counts(tagged: DataFrame) -> DataFrame:
    return tagged.where("pattern_name is not null").groupBy("symbol", "pattern_name").agg(F.count("*").alias("n"))


def _names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in NAMES], "pattern_name string")


def summary(tagged: DataFrame) -> DataFrame:
    """All names with the number of their events and mean body share and volume against the average."""
    found = tagged.where("pattern_name is not null").groupBy("pattern_name").agg(F.count("*").alias("n"), F.avg("body_share").alias("avg_body_share"), F.avg("volume_vs_average").alias("avg_volume_ratio"))
    return F.broadcast(_names(tagged)).join(found, "pattern_name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rare(tagged: DataFrame, least: int = 50) -> DataFrame:
    found = tagged.where("pattern_name is not null").groupBy("pattern_name").agg(F.count("*").alias("n"))
    return _names(tagged).join(found, "pattern_name", "left").select("pattern_name", F.coalesce("n", F.lit(0).cast("long")).alias("n")).withColumn("kept", F.col("n") >= least)
