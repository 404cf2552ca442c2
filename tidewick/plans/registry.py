"""All queries by name, and the SQL that each is compared with.

Every query reads the given tables; bars come from order lines as ticks. Doubles are rounded to four places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, boosting, clean, features, indicators, model, patterns, signals
from ..sources import bars as source
from ..sources import checked
from ..sources.shared import folder, stored
from ..streaming import bars as live
from .oracle import clipped, r, recent, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = ["symbol", "bar_date"]
BAR = [*KEY, "open", "high", "low", "close", "volume"]
BAR_SQL = f"symbol, bar_date, {r('open', 'high', 'low', 'close')}, volume"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 4) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.tick_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an adjusted close: symbols that begin with R are split in two."""
    return bars(spark, sf_dir).withColumn("adj_close", F.when(F.col("symbol").startswith("R"), F.col("close") * 0.5).otherwise(F.col("close")))


def wild_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of large moves: the largest price per unit of each day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.add_months(F.to_date("l_shipdate"), 336).alias("bar_date")).agg(
        F.max(F.col("l_extendedprice") / F.col("l_quantity") / 7.389056).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    return days.select(*KEY, (F.col("close") * 0.995).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", "volume")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.tag(bars(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(bars(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.momentum_scorer(features.scoring_rows(bars(spark, sf_dir)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("target_label is not null")


def found_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signals(scored(spark, sf_dir))


def done_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trades(found_signals(spark, sf_dir), bars(spark, sf_dir))


# bars and cleaning

query("bars_daily", sql("b", f"SELECT {BAR_SQL} FROM b"))(bars)
query("load_min_history", sql("b", f"SELECT {BAR_SQL} FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY symbol HAVING count(*) >= 2450)"))(lambda s, d: source.with_history(bars(s, d), 2_450))
query("load_summary", sql("b", "SELECT symbol, count(*) AS n_rows, min(bar_date) AS first_date, max(bar_date) AS last_date FROM b GROUP BY symbol"))(lambda s, d: source.summary(bars(s, d)))
query("clean_adjust", sql("clean", f"SELECT {BAR_SQL}, {r('adj_close')} FROM aj"))(lambda s, d: clean.adjust(raw_bars(s, d)))
query("calendar_spine", sql("clean", "SELECT symbol, bar_date FROM sn"))(lambda s, d: clean.spine(bars(s, d)))
query("missing_days", sql("clean", "SELECT symbol, bar_date FROM ms"))(lambda s, d: clean.missing_days(bars(s, d)))
query("gap_runs", sql("clean", "SELECT symbol, run, min(bar_date) AS first_missing, max(bar_date) AS last_missing, count(*) AS n_days FROM mr GROUP BY symbol, run"))(lambda s, d: clean.gap_runs(bars(s, d)))
query("gap_fill", sql("clean", f"SELECT {BAR_SQL}, {r('adj_close')} FROM gf"))(lambda s, d: clean.fill_gaps(clean.adjust(raw_bars(s, d))))
_WILD = """WITH w AS (SELECT symbol, bar_date, close * 0.995::DOUBLE AS open, close * 1.01::DOUBLE AS high, close * 0.99::DOUBLE AS low, close, volume FROM (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS bar_date, max(l_extendedprice / l_quantity / 7.389056::DOUBLE) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL))
"""
query("clip_outliers", _WILD + f"SELECT {BAR_SQL} FROM ({clipped('w')})")(lambda s, d: clean.clip_outliers(wild_bars(s, d)))
_VALID = "WHERE NOT (coalesce(high < low, false) OR coalesce(close <= 0, false) OR coalesce(volume = 0, false) OR coalesce(abs(high - low) < 1e-4 * abs(close), false))"
query("valid_candles", sql("b", f"SELECT {BAR_SQL} FROM b {_VALID}"))(lambda s, d: clean.valid_candles(bars(s, d)))
query("enforce_types", sql("b", f"SELECT {BAR_SQL.replace('volume', 'CASE WHEN volume % 7 = 0 THEN 0 ELSE volume END AS volume')} FROM b WHERE volume % 11 <> 0"))(
    lambda s, d: clean.enforce_types(bars(s, d).withColumns({"volume": F.when(F.col("volume") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string")), "close": F.when(F.col("volume") % 11 == 0, "-").otherwise(F.col("close").cast("string"))})))
query("preprocess", sql("clean", f"SELECT {BAR_SQL}, {r('adj_close')} FROM (SELECT *, close AS adj_close FROM ({clipped('gf')}) {_VALID} QUALIFY count(*) OVER (PARTITION BY symbol) >= 60)"))(lambda s, d: clean.preprocess(raw_bars(s, d)))
query("quality_audit", sql("n", """SELECT symbol, count(*) AS n_rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS n_null,
  count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS n_not_positive, count(*) FILTER (date_diff('day', bar_date1, bar_date) > 5) AS n_gaps FROM n GROUP BY symbol"""))(lambda s, d: clean.quality_audit(bars(s, d)))

# patterns

_EVENT = f"symbol, name AS pattern_name, ptype AS pattern_type, direction, pstart AS pattern_start, bar_date AS pattern_end, num_candles, {r('strength')[:-len(' AS strength')]} AS pattern_strength, confirm AS volume_confirm, ptrend AS prior_trend"
query("pattern_events", sql("pat", f"SELECT {_EVENT} FROM p WHERE name IS NOT NULL"))(lambda s, d: patterns.events(tagged(s, d)))
query("pattern_counts", sql("pat", "SELECT symbol, name AS pattern_name, count(*) AS n FROM p WHERE name IS NOT NULL GROUP BY symbol, name"))(lambda s, d: patterns.counts(tagged(s, d)))
_NAMES = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in patterns.NAMES) + "]) AS pattern_name)"
query("pattern_summary", sql("pat", f"""SELECT pattern_name, count(name) AS n, round(avg(btr), 4) + 0.0 AS avg_body_share, round(avg(vr), 4) + 0.0 AS avg_volume_ratio
  FROM {_NAMES} LEFT JOIN p ON p.name = pattern_name GROUP BY pattern_name"""))(lambda s, d: patterns.summary(tagged(s, d)))
query("rare_patterns", sql("pat", f"SELECT pattern_name, count(name) AS n, count(name) >= 50 AS kept FROM {_NAMES} LEFT JOIN p ON p.name = pattern_name GROUP BY pattern_name"))(lambda s, d: patterns.rare(tagged(s, d)))
query("tag_bars", sql("pat", f"""SELECT {BAR_SQL}, coalesce(name, '') AS pattern_name, coalesce(direction, '') AS pattern_direction, coalesce(ptype, '') AS pattern_type, coalesce(ptrend, '') AS prior_trend,
  round(coalesce(strength, 0), 4) + 0.0 AS pattern_strength, {', '.join(f"CAST(coalesce(name = '{n}', false) AS INT) AS pat_{n}" for n in patterns.NAMES)} FROM p"""))(
    lambda s, d: patterns.flags(tagged(s, d)).drop("num_candles", "volume_confirm", "pattern_start", "volume_vs_average", "body_share"))
for _name in patterns.NAMES:
    query(f"pat_{_name}", sql("pat", f"SELECT symbol, bar_date, round(strength, 4) + 0.0 AS pattern_strength, ptrend AS prior_trend FROM p WHERE name = '{_name}'"))(
        lambda s, d, n=_name: tagged(s, d).where(F.col("pattern_name") == n).select(*KEY, "pattern_strength", "prior_trend"))

# indicators and features

query("ema", sql("feat", f"SELECT symbol, bar_date, {r('ema_20', 'ema_50', 'ema_200')} FROM g"))(lambda s, d: indicators.ema(indicators.ema(indicators.ema(bars(s, d), 20), 50), 200).select(*KEY, "ema_20", "ema_50", "ema_200"))
query("rsi", sql("feat", f"SELECT symbol, bar_date, {r('rsi_14')} FROM g"))(lambda s, d: indicators.rsi(bars(s, d)).select(*KEY, "rsi_14"))
query("atr", sql("feat", f"SELECT symbol, bar_date, {r('atr_14')} FROM g"))(lambda s, d: indicators.atr(bars(s, d)).select(*KEY, "atr_14"))
query("macd", sql("feat", f"SELECT symbol, bar_date, {r('macd_line', 'macd_signal', 'macd_hist')} FROM h"))(lambda s, d: indicators.macd(bars(s, d)).select(*KEY, "macd_line", "macd_signal", "macd_hist"))
query("bollinger", sql("feat", f"SELECT symbol, bar_date, round(m20, 4) + 0.0 AS bbands_mid, {r('bbands_upper', 'bbands_lower')} FROM h"))(lambda s, d: indicators.bollinger(bars(s, d)).select(*KEY, "bbands_mid", "bbands_upper", "bbands_lower"))


def _columns(names: list[str]) -> str:
    return ", ".join(f"CAST({n} AS INT) AS {n}" if n in features.INTEGERS else r(n) for n in names)


for _name, _step, _cols in (("price", features.price, features.PRICE), ("trend", features.trend, features.TREND), ("volatility", features.volatility, features.VOLATILITY), ("gap", features.gap, features.GAP), ("volume", features.volume, features.VOLUME), ("momentum", features.momentum, features.MOMENTUM), ("sr", features.levels, features.LEVELS)):
    query(f"feat_{_name}", sql("feat", f"SELECT symbol, bar_date, {_columns(_cols)} FROM ft"))(lambda s, d, f=_step, c=_cols: f(bars(s, d)).select(*KEY, *c))
query("feat_pattern", sql("feat", f"SELECT symbol, bar_date, {_columns(features.PATTERN)} FROM ft"))(lambda s, d: features.wide(bars(s, d)).select(*KEY, *features.PATTERN))
query("target_label", sql("feat", f"SELECT symbol, bar_date, {r('forward_return_5d')}, target_label FROM ft"))(lambda s, d: features.target(features.volatility(bars(s, d))).select(*KEY, "forward_return_5d", "target_label"))
query("target_distribution", sql("scored", "SELECT target_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) + 0.0 AS share FROM fr GROUP BY target_label"))(lambda s, d: features.label_shares(feature_rows(s, d)))
query("features", sql("scored", f"SELECT {BAR_SQL}, name AS pattern_name, direction AS pattern_direction, {_columns(features.COLUMNS)}, {r('forward_return_5d')}, target_label FROM fr"))(feature_rows)

# models

_SPLIT = """(SELECT *, CASE WHEN bar_date <= (SELECT CAST(max(bar_date) - to_months(CASE WHEN date_diff('day', min(bar_date), max(bar_date)) // 30 < 24 THEN CAST(greatest(1, floor(date_diff('day', min(bar_date), max(bar_date)) // 30 * 0.25)) AS INT) ELSE 6 END) AS DATE) FROM fr)
  THEN 'train' ELSE 'test' END AS part FROM fr)"""
query("time_split", sql("scored", f"SELECT symbol, bar_date, part FROM {_SPLIT}"))(lambda s, d: model.time_split(feature_rows(s, d)).select(*KEY, "part"))
_SCALED = ["body_size", "atr_14", "rsi_14", "volume_ratio"]
query("standardize", sql("scored", "SELECT symbol, bar_date, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}" for c in _SCALED) + " FROM fr"))(lambda s, d: model.standardize(feature_rows(s, d).select(*KEY, *_SCALED), _SCALED))
query("class_weights", sql("scored", "SELECT target_label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 4) + 0.0 AS weight FROM fr GROUP BY target_label"))(lambda s, d: model.class_weights(feature_rows(s, d)))
query("ensemble_argmax", sql("scored", f"SELECT symbol, bar_date, {r('p_bear', 'p_neutral', 'p_bull')}, prediction FROM sp"))(lambda s, d: scored(s, d).select(*KEY, "p_bear", "p_neutral", "p_bull", "prediction"))
_RSI = "list_value((1 - rsi_14 / 100) / 2, 0.5, rsi_14 / 200)"
_MEANS = ", ".join(f"(p_{c} + x[{k}]) / 2 AS m{k}" for k, c in enumerate(("bear", "neutral", "bull"), 1))
query("ensemble_two", sql("scored", f"""SELECT symbol, bar_date, round(m1, 4) + 0.0 AS p_bear, round(m2, 4) + 0.0 AS p_neutral, round(m3, 4) + 0.0 AS p_bull, CASE WHEN m1 >= m2 AND m1 >= m3 THEN -1 WHEN m2 >= m3 THEN 0 ELSE 1 END AS prediction
  FROM (SELECT *, {_MEANS} FROM (SELECT *, {_RSI} AS x FROM sp))"""))(lambda s, d: model.ensemble(
    scored(s, d).withColumns({"_a": F.array("p_bear", "p_neutral", "p_bull"), "_b": F.array((1 - F.col("rsi_14") / 100) / 2, F.lit(0.5), F.col("rsi_14") / 200)}), "_a", "_b").select(*KEY, "p_bear", "p_neutral", "p_bull", "prediction"))
query("confusion_matrix", sql("scored", "SELECT target_label, prediction, count(*) AS n FROM st GROUP BY ALL"))(lambda s, d: model.confusion_matrix(judged(s, d)))
query("class_report", sql("scored", """SELECT label, round(p, 4) + 0.0 AS precision, round(q, 4) + 0.0 AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 4) + 0.0 AS f1, support, round(a, 4) + 0.0 AS accuracy FROM (
  SELECT label, coalesce(count(*) FILTER (target_label = label AND prediction = label) / nullif(count(*) FILTER (prediction = label), 0), 0)::DOUBLE AS p, coalesce(count(*) FILTER (target_label = label AND prediction = label) / nullif(count(*) FILTER (target_label = label), 0), 0)::DOUBLE AS q,
    count(*) FILTER (target_label = label) AS support, count(*) FILTER (target_label = prediction) / count(*) AS a FROM st, (SELECT unnest([-1, 0, 1]) AS label) GROUP BY label)"""))(lambda s, d: model.class_report(judged(s, d)))
query("auc_ovr", sql("scored", """SELECT label, round((sum(rk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)), 4) + 0.0 AS auc FROM (
  SELECT label, hit, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2 AS rk FROM (
    SELECT -1 AS label, round(p_bear, 9) AS score, target_label = -1 AS hit FROM st UNION ALL SELECT 0, round(p_neutral, 9), target_label = 0 FROM st UNION ALL SELECT 1, round(p_bull, 9), target_label = 1 FROM st)) GROUP BY label"""))(lambda s, d: model.auc_ovr(judged(s, d)))
query("pattern_accuracy", sql("scored", "SELECT name AS pattern_name, count(*) AS n, round(avg(CAST(target_label = prediction AS INT)), 4) + 0.0 AS accuracy FROM st WHERE name IS NOT NULL GROUP BY name HAVING count(*) >= 5"))(lambda s, d: model.pattern_accuracy(judged(s, d)))
query("tier_accuracy", sql("scored", "SELECT CASE WHEN greatest(p_bear, p_neutral, p_bull) >= 0.7 THEN 'HIGH' WHEN greatest(p_bear, p_neutral, p_bull) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS tier, CAST(pattern_strength > 0 AS INT) AS has_pattern, count(*) AS n, round(avg(CAST(target_label = prediction AS INT)), 4) + 0.0 AS accuracy FROM st GROUP BY 1, 2"))(lambda s, d: model.tier_accuracy(judged(s, d)))
query("predict_point", sql("scored", """SELECT symbol, bar_date, prediction AS predicted_label, CASE prediction WHEN -1 THEN 'bearish' WHEN 1 THEN 'bullish' ELSE 'neutral' END AS predicted_class, round(p_bear, 4) + 0.0 AS prob_bearish,
  round(p_neutral, 4) + 0.0 AS prob_neutral, round(p_bull, 4) + 0.0 AS prob_bullish, round(greatest(p_bear, p_neutral, p_bull), 4) + 0.0 AS confidence FROM sp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1"""))(
    lambda s, d: model.named(signals.latest_rows(scored(s, d))))
query("evaluate_model", sql("scored", """SELECT (SELECT count(*) FROM st) AS n, round((SELECT avg(CAST(target_label = prediction AS INT)) FROM st), 4) + 0.0 AS accuracy, round(avg(auc), 4) + 0.0 AS roc_auc_macro FROM (
  SELECT label, (sum(rk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc FROM (
  SELECT label, hit, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2 AS rk FROM (
    SELECT -1 AS label, round(p_bear, 9) AS score, target_label = -1 AS hit FROM st UNION ALL SELECT 0, round(p_neutral, 9), target_label = 0 FROM st UNION ALL SELECT 1, round(p_bull, 9), target_label = 1 FROM st)) GROUP BY label)"""))(lambda s, d: model.evaluate(judged(s, d)))
_FOLD = "SELECT *, sum(n) OVER (ORDER BY bar_date) > sum(n) OVER () - sum(n) OVER () // 6 AS late FROM (SELECT bar_date, count(*) AS n FROM fr GROUP BY bar_date)"
query("last_fold", sql("scored", f"SELECT symbol, bar_date, CASE WHEN late THEN 'validate' ELSE 'fit' END AS fold FROM fr JOIN ({_FOLD}) USING (bar_date)"))(lambda s, d: model.last_fold(feature_rows(s, d)).select(*KEY, "fold"))
query("signals_from_output", sql("sig", f"SELECT symbol, bar_date, {r('p_bear', 'p_neutral', 'p_bull')} FROM si"))(
    lambda s, d: signals.with_probabilities(features.scoring_rows(bars(s, d)), scored(s, d)).select(*KEY, "p_bear", "p_neutral", "p_bull"))


#: Fitted models by session and tables; each is a few trees.
_FITTED: dict[tuple[str, str], PipelineModel] = {}


def fitted(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """Both boosters, with few rounds, on the rows before the test months; fitted once for a session's tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FITTED:
        few = tuple(replace(b, rounds=8, depth=4, step=0.3) for b in (boosting.FIRST, boosting.SECOND))
        _FITTED[key] = model.train_model(stored(feature_rows(spark, sf_dir)), boosters=few)
    return _FITTED[key]


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test months' rows with the fitted model's output."""
    return model.predict(fitted(spark, sf_dir), model.time_split(feature_rows(spark, sf_dir)).where("part = 'test'"))


query("model_predict")(lambda s, d: tested(s, d).select(*KEY, "target_label", "p_bear", "p_neutral", "p_bull", "prediction", "first_label", "second_label"))
query("model_evaluate")(lambda s, d: model.evaluate(tested(s, d)))
query("model_classes")(lambda s, d: model.class_report(tested(s, d)))
query("model_named")(lambda s, d: model.named(model.predict(fitted(s, d), signals.latest_rows(features.scoring_rows(bars(s, d))))))
query("model_signals")(lambda s, d: signals.signals(tested(s, d)).select(*KEY, "signal", "signal_strength", "confidence_score", "confidence_value", "entry_price", "stoploss", "reject_signal"))


@query("model_attributions")
def model_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty inputs that move the first booster's margins most, over the first rows of the test months."""
    rows = model.time_split(feature_rows(spark, sf_dir)).where("part = 'test'")
    return boosting.top_features(model.explain(fitted(spark, sf_dir), rows, folder(spark, "trees")), model.INPUTS)


# signals

_CONTEXT = ["trend_context", "rsi_zone", "volume_confirmation", "volatility_state", "near_support", "near_resistance", "gap_present", "ema_alignment"]
_FLAGS = ["high_volume", "strong_trend", "momentum_confirmation", "level_reaction", "sideways_market", "candle_too_small", "candle_too_large"]
_SIGNAL = ["signal", "signal_strength", "confidence_score", "pattern_detected", "stoploss_method", "reject_signal", "reject_reason"]
_SIGNAL_R = ["p_bull", "p_bear", "p_neutral", "continuation_probability", "reversal_probability", "confidence_value", "entry_price", "stoploss", "risk_pct", "pattern_strength"]
for _name, _plain, _num in (("signal_context", _CONTEXT, []), ("signal_flags", _FLAGS, []), ("derived_probs", [], ["continuation_probability", "reversal_probability"]), ("confidence", ["confidence_score"], ["confidence_value"]), ("classify", ["signal", "signal_strength"], []), ("stoploss", ["signal", "stoploss_method"], ["entry_price", "stoploss", "risk_pct"]), ("rejection", ["reject_signal", "reject_reason"], []), ("signals", [*_SIGNAL, *_CONTEXT, *_FLAGS], _SIGNAL_R)):
    query(_name, sql("sig", "SELECT " + ", ".join(["symbol", "bar_date", *_plain, *([r(*_num)] if _num else [])]) + " FROM si"))(lambda s, d, c=(*_plain, *_num): found_signals(s, d).select(*KEY, *c))
_REPORT = ["signal", "signal_strength", "confidence_score", "pattern_detected"]
query("daily_report", sql("sig", f"SELECT symbol, bar_date, CAST(place AS INT) AS rank, {', '.join(_REPORT)}, {r('confidence_value', 'entry_price', 'stoploss', 'risk_pct')} FROM rp"))(
    lambda s, d: signals.daily_report(found_signals(s, d)).select(*KEY, "rank", *_REPORT, "confidence_value", "entry_price", "stoploss", "risk_pct"))
query("report_text", sql("sig", """SELECT bar_date, CAST(place AS INT) AS rank, concat_ws(' ', rpad(symbol, 14, ' '), rpad(pattern_detected, 22, ' '), rpad(coalesce(direction, 'neutral'), 9, ' '), lpad(format('{:.1f}', p_bull * 100), 5, ' ') || '%', lpad(format('{:.1f}', p_bear * 100), 5, ' ') || '%',
  lpad(format('{:.1f}', confidence_value * 100), 5, ' ') || '%', lpad(confidence_score, 6, ' '), rpad(signal, 6, ' '), rpad(signal_strength, 9, ' '), lpad(format('{:.2f}', entry_price), 9, ' '), lpad(format('{:.2f}', stoploss), 9, ' '), lpad(format('{:.2f}', risk_pct), 5, ' ') || '%') AS line FROM rp"""))(
    lambda s, d: signals.report_text(signals.daily_report(found_signals(s, d))))
query("eod_summary", sql("sig", """SELECT bar_date, count(*) AS signals_generated, count(*) FILTER (reject_signal) AS signals_rejected, count(*) FILTER (NOT reject_signal AND place <= 20) AS valid_signals,
  count(*) FILTER (NOT reject_signal AND signal = 'BUY') AS buy_signals, count(*) FILTER (NOT reject_signal AND signal = 'SELL') AS sell_signals, count(*) FILTER (NOT reject_signal AND signal = 'HOLD') AS hold_signals,
  count(*) FILTER (NOT reject_signal AND place <= 20 AND confidence_score = 'HIGH') AS high_confidence, count(*) FILTER (NOT reject_signal AND place <= 20 AND confidence_score = 'MEDIUM') AS medium_confidence,
  count(*) FILTER (NOT reject_signal AND place <= 20 AND confidence_score = 'LOW') AS low_confidence FROM rk GROUP BY bar_date"""))(lambda s, d: signals.eod_summary(found_signals(s, d)))
query("latest_row", sql("feat", f"SELECT {BAR_SQL}, {r('ema_20', 'rsi_14')} FROM ft QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1"))(lambda s, d: signals.latest_rows(features.wide(bars(s, d))).select(*BAR, "ema_20", "rsi_14"))

# backtest

_TRADE = ["entry_price", "exit_price", "stoploss", "target", "raw_return_pct", "net_return_pct", "confidence_value", "pattern_strength", "entry_open"]
_TRADE_SQL = f"symbol, signal_date, entry_date, exit_date, direction, exit_reason, win, pattern_detected, confidence_score, {r(*_TRADE)}"
query("next_trading_day", sql("trades", "SELECT symbol, bar_date, (SELECT min(d) FROM td WHERE d > bar_date) AS next_day FROM b"))(lambda s, d: backtest.next_trading_days(bars(s, d).select(*KEY)))
query("circuit", sql("trades", "SELECT symbol, bar_date, circuit FROM ci"))(lambda s, d: backtest.circuits(bars(s, d)).select(*KEY, "circuit"))
query("trade_sim", sql("trades", f"SELECT {_TRADE_SQL} FROM tr"))(done_trades)
query("portfolio_curve", sql("curve", f"SELECT CAST(seq AS INT) AS seq, signal_date, symbol, shares, {r('notional', 'pnl')}, round(value, 4) + 0.0 AS portfolio_after FROM cu"))(lambda s, d: backtest.portfolio(done_trades(s, d)))
query("drawdown", sql("curve", f"SELECT CAST(seq AS INT) AS seq, {r('portfolio_after', 'peak', 'drawdown')} FROM dr"))(lambda s, d: backtest.drawdown(backtest.portfolio(done_trades(s, d))))


@query("bt_metrics", sql("curve", """SELECT count(*) AS total_trades, count(*) FILTER (x > 0) AS wins, count(*) FILTER (x <= 0) AS losses, round(round(count(*) FILTER (x > 0) / count(*) * 100, 2), 4) + 0.0 AS win_rate_pct,
  round(coalesce(avg(x) FILTER (x > 0), 0) * 100, 3) + 0.0 AS avg_win_pct, round(coalesce(avg(x) FILTER (x <= 0), 0) * 100, 3) + 0.0 AS avg_loss_pct, round(sum(x) FILTER (x > 0) / abs(sum(x) FILTER (x <= 0)), 3) + 0.0 AS profit_factor,
  round((SELECT least(min(drawdown), 0) FROM dr) * 100, 2) + 0.0 AS max_drawdown_pct, round(avg(x) / (stddev_pop(x) + 1e-9) * sqrt(252), 3) + 0.0 AS sharpe_ratio,
  round((pow((SELECT max_by(value, seq) FROM cu) / 1000000, 252 / (count(*) + 1)) - 1) * 100, 2) + 0.0 AS cagr_pct, round((SELECT max_by(value, seq) FROM cu), 2) + 0.0 AS final_equity,
  round(((SELECT max_by(value, seq) FROM cu) / 1000000 - 1) * 100, 2) + 0.0 AS total_return_pct FROM (SELECT net_return_pct / 100 AS x FROM tr)"""))
def bt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = done_trades(spark, sf_dir)
    return backtest.metrics(done)


for _name, _by, _least in (("pattern_winrates", "pattern_detected", 2), ("confidence_winrates", "confidence_score", 1)):
    query(_name, sql("trades", f"SELECT {_by}, count(*) AS n, round(avg(CAST(win AS INT)) * 100, 1) + 0.0 AS win_rate_pct FROM tr GROUP BY {_by} HAVING count(*) >= {_least}"))(lambda s, d, b=_by, n=_least: backtest.win_rates(done_trades(s, d), b, n))
query("position_limits", sql("trades", """SELECT symbol, signal_date, entry_date, exit_date, taken FROM (WITH RECURSIVE
o AS (SELECT symbol, signal_date, entry_date, exit_date, year(signal_date) AS run, row_number() OVER (PARTITION BY year(signal_date) ORDER BY entry_date, signal_date, symbol, exit_date, entry_price, net_return_pct) AS seq FROM tr),
f AS (SELECT DISTINCT run, 0::BIGINT AS seq, NULL::VARCHAR AS symbol, NULL::DATE AS signal_date, NULL::DATE AS entry_date, NULL::DATE AS exit_date, false AS taken, []::STRUCT(s VARCHAR, d DATE)[] AS held FROM o
  UNION ALL SELECT run, seq, symbol, signal_date, entry_date, exit_date, ok, CASE WHEN ok THEN list_append(live, {'s': symbol, 'd': exit_date}) ELSE live END FROM (
    SELECT *, len(live) < 3 AND len(list_filter(live, lambda x: x.s = symbol)) = 0 AS ok FROM (SELECT o.*, list_filter(f.held, lambda x: x.d >= o.entry_date) AS live FROM f JOIN o ON o.run = f.run AND o.seq = f.seq + 1)))
SELECT * FROM f WHERE seq > 0)"""))(lambda s, d: backtest.position_limits(done_trades(s, d).withColumn("run", F.year("signal_date")), 3).select("symbol", "signal_date", "entry_date", "exit_date", "taken"))
query("cum_return", sql("n", "SELECT symbol, bar_date, round(exp(sum(ln(1 + (close / close1 - 1))) OVER (PARTITION BY symbol ORDER BY bar_date)), 4) + 0.0 AS cumulative FROM n"))(
    lambda s, d: backtest.cumulative_return(bars(s, d).withColumn("ret", F.col("close") / F.lag("close").over(indicators.by_symbol()) - 1), "ret").select(*KEY, "cumulative"))
query("prob_hist", sql("scored", "SELECT CAST(least(floor(p_bull * 50), 49) AS INT) AS bin, count(*) AS n FROM sp GROUP BY 1"))(lambda s, d: backtest.histogram(scored(s, d), "p_bull"))
query("hourly_event_bars", """SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_time, round(min(value), 4) + 0.0 AS low, round(max(value), 4) + 0.0 AS high, round(arg_min(value, (ts, event_id)), 4) + 0.0 AS open, round(arg_max(value, (ts, event_id)), 4) + 0.0 AS close, count(*) AS volume FROM events GROUP BY 1, 2""")(
    lambda s, d: live.hourly_bars(s.read.parquet(f"{d}/events.parquet")))

# what joins, falls back or counts beside the main path

query("load_pending", sql("b", "SELECT symbol FROM b GROUP BY symbol HAVING count(*) < 2450"))(lambda s, d: source.pending(bars(s, d), source.with_history(bars(s, d), 2_450)))
query("load_status", sql("b", "SELECT CASE WHEN n >= 2450 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM (SELECT symbol, count(*) AS n FROM b GROUP BY symbol) GROUP BY 1"))(lambda s, d: source.load_status(bars(s, d), source.with_history(bars(s, d), 2_450)))
query("ordered_symbols", "SELECT symbol, CAST(row_number() OVER (ORDER BY first_at, symbol) AS INT) AS place FROM (SELECT l_returnflag || l_linestatus AS symbol, min((l_orderkey, l_linenumber)) AS first_at FROM lineitem GROUP BY 1)")(
    lambda s, d: source.ordered_distinct(s.read.parquet(f"{d}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), "l_orderkey", "l_linenumber"), "symbol", "l_orderkey", "l_linenumber"))
query("clean_counts", sql("clean", f"""SELECT symbol, n_raw, coalesce(n_clean, 0) AS n_clean, coalesce(n_infinite, 0) AS n_infinite FROM (SELECT symbol, count(*) AS n_raw FROM rb GROUP BY symbol) LEFT JOIN (
  SELECT symbol, count(*) AS n_clean, count(*) FILTER (isinf(open)) + count(*) FILTER (isinf(high)) + count(*) FILTER (isinf(low)) + count(*) FILTER (isinf(close)) AS n_infinite FROM (
    SELECT * FROM ({clipped('gf')}) {_VALID} QUALIFY count(*) OVER (PARTITION BY symbol) >= 60) GROUP BY symbol) USING (symbol)"""))(lambda s, d: clean.clean_counts(raw_bars(s, d), clean.preprocess(raw_bars(s, d))))
query("recent_patterns", recent(5, "SELECT symbol, name AS pattern_name, bar_date AS pattern_end, ptrend AS prior_trend FROM p WHERE name IS NOT NULL"))(
    lambda s, d: patterns.events(patterns.tag(signals.latest_rows(bars(s, d), 5))).select("symbol", "pattern_name", "pattern_end", "prior_trend"))
query("small_features", sql("scored", "SELECT symbol, bar_date, " + ", ".join(f"round({c} * 10000, 4) + 0.0 AS {c}_e4" for c in ("gap_pct", "atr_ratio", "forward_return_5d", "ema20_slope")) + " FROM fr"))(
    lambda s, d: feature_rows(s, d).select(*KEY, *[(F.col(c) * 10_000).alias(f"{c}_e4") for c in ("gap_pct", "atr_ratio", "forward_return_5d", "ema20_slope")]))
query("class_averages", sql("scored", """, cl AS (SELECT label, count(*) FILTER (target_label = label AND prediction = label) AS hits, count(*) FILTER (prediction = label) AS said, count(*) FILTER (target_label = label) AS support
  FROM st, (SELECT unnest([-1, 0, 1]) AS label) GROUP BY label),
cf AS (SELECT coalesce(hits / nullif(said, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS q, coalesce(2 * hits / nullif(said + support, 0), 0) AS f, support FROM cl)
SELECT 'macro' AS average, round(avg(p), 4) + 0.0 AS precision, round(avg(q), 4) + 0.0 AS recall, round(avg(f), 4) + 0.0 AS f1, CAST(sum(support) AS BIGINT) AS support FROM cf
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 4) + 0.0, round(sum(q * support) / sum(support), 4) + 0.0, round(sum(f * support) / sum(support), 4) + 0.0, CAST(sum(support) AS BIGINT) FROM cf"""))(lambda s, d: model.report_averages(model.class_report(judged(s, d))))
query("confusion_grid", sql("scored", """SELECT y AS target_label, p AS prediction, n, round(n / nullif(sum(n) OVER (PARTITION BY y), 0), 4) + 0.0 AS share FROM (
  SELECT y, p, count(*) FILTER (target_label = y AND prediction = p) AS n FROM (SELECT unnest([-1, 0, 1]) AS y), (SELECT unnest([-1, 0, 1]) AS p), st GROUP BY y, p)"""))(lambda s, d: model.confusion_grid(judged(s, d)))
query("signal_direction", sql("sig", "SELECT symbol, bar_date, coalesce(direction, 'neutral') AS pattern_direction FROM si"))(
    lambda s, d: signals.direction(scored(s, d).withColumn("pattern_direction", F.when(F.col("volume") % 2 == 0, F.col("pattern_direction")).when(F.col("volume") % 3 == 0, "neutral"))).select(*KEY, "pattern_direction"))
query("features_last_bar", sql("scored", f"""SELECT f.symbol, f.bar_date, round(f.rsi_14, 4) + 0.0 AS rsi_14, {', '.join(f'round(n.{c}, 4) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close'))}, n.volume
  FROM (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1) f JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) = 1) n ON n.symbol = f.symbol"""))(
    lambda s, d: signals.with_last_bar(signals.latest_rows(feature_rows(s, d)), bars(s, d)).select(*KEY, "rsi_14", *BAR[2:]))
query("signal_defaults", sql("sig", "SELECT symbol, bar_date, signal, round(entry_price * 0.98::DOUBLE, 4) + 0.0 AS stoploss, 'LOW' AS confidence_score, 0.0::DOUBLE AS confidence_value, 'none' AS pattern_detected, 0.0::DOUBLE AS pattern_strength FROM si"))(
    lambda s, d: backtest.with_defaults(found_signals(s, d).select(*KEY, "signal", "entry_price")).drop("entry_price"))
query("equity_points", sql("curve", "SELECT CAST(seq AS INT) AS seq, signal_date, round(value, 4) + 0.0 AS portfolio_after, value >= 1000000 AS above FROM cv"))(lambda s, d: backtest.equity_points(backtest.portfolio(done_trades(s, d))))


# files written and read again


@query("report_round_trip", sql("sig", f"SELECT symbol, bar_date, CAST(place AS INT) AS rank, {', '.join(_REPORT)}, {r('confidence_value', 'entry_price', 'stoploss', 'risk_pct')} FROM rp"))
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily report as it is read back from the CSV files that it was written to."""
    columns = [*KEY, "rank", *_REPORT, "confidence_value", "entry_price", "stoploss", "risk_pct"]
    path = folder(spark, "report") + "/files"
    source.write_report(signals.daily_report(found_signals(spark, sf_dir)).select(*columns), path)
    return checked.read_reports(spark, path, columns)


def mixed_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All bars as CSV files of two kinds of header, some values unreadable or missing: what is read, and what is set aside."""
    path, rows = folder(spark, "mixed"), stored(bars(spark, sf_dir))
    text = rows.select("symbol", "bar_date", *[F.col(c).cast("string").alias(c) for c in BAR[2:]])
    odd = text.withColumns({"close": F.when(F.col("volume").cast("long") % 11 == 0, "n/a").otherwise(F.col("close")), "open": F.when(F.col("volume").cast("long") % 7 == 0, "").otherwise(F.col("open"))})
    one = odd.where("symbol < 'N'").select(F.col("symbol").alias("Symbol"), F.col("bar_date").alias("Date"), *[F.col(c).alias(c.title()) for c in BAR[2:]])
    two = odd.where("symbol >= 'N'").select(F.col("volume").alias(" VOLUME "), *[F.col(c).alias(c.upper()) for c in ("close", "low", "high", "open")], F.lit("a, b").alias("Note"), "symbol", F.col("bar_date").alias("date"))
    for name, part in (("one", one), ("two", two)):
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
    return checked.read_csv(spark, [f"{path}/one", f"{path}/two"], checked.BAR_COLUMNS | {"symbol": "string"}, [*checked.BAR_NEEDS, "symbol"])


query("mixed_csv", sql("b", f"SELECT {BAR_SQL} FROM b WHERE volume % 11 <> 0 AND volume % 7 <> 0"))(lambda s, d: mixed_files(s, d)[0].select("symbol", F.col("date").alias("bar_date"), *BAR[2:]))
query("csv_set_aside", sql("b", """SELECT concat_ws('; ', CASE WHEN volume % 11 = 0 THEN 'close isn''t a double' END, CASE WHEN volume % 7 = 0 THEN 'open is missing' END) AS reason, count(*) AS n
  FROM b WHERE volume % 11 = 0 OR volume % 7 = 0 GROUP BY 1"""))(lambda s, d: mixed_files(s, d)[1].groupBy("reason").agg(F.count("*").alias("n")))
query("model_importances")(lambda s, d: s.createDataFrame(model.importances(fitted(s, d), 20), "feature string, weight double"))
