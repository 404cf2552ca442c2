"""The queries in SQL, derived from the rules on their own: recursive means, lags by name, joins by row number."""

from __future__ import annotations

from ..config import DATED_HOLIDAYS, YEARLY_HOLIDAYS
from ..operators import features as f
from ..operators import patterns

TICKS = """
t AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS bar_date,
        100.0::DOUBLE + 8.0::DOUBLE * l_extendedprice / 105000.0::DOUBLE AS px, l_quantity,
        row_number() OVER (PARTITION BY l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
b AS (SELECT symbol, bar_date, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM t GROUP BY symbol, bar_date)"""

_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in ("open", "high", "low", "close", "volume", "bar_date") for k in (1, 2))
NUMBERED = f"""
n AS (SELECT *, row_number() OVER w AS i, {_LAGS}, lag(close, 10) OVER w AS close10, avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vavg FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))"""

MEANS = """
x AS (SELECT symbol, i, close, greatest(high - low, abs(high - close1), abs(low - close1)) AS tr, greatest(close - close1, 0) AS up, greatest(close1 - close, 0) AS down FROM n),
e AS (
  SELECT symbol, i, close AS e20, close AS e50, close AS e200, close AS e12, close AS e26, 0.0::DOUBLE AS sig, tr AS atr, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss FROM x WHERE i = 1
  UNION ALL
  SELECT x.symbol, x.i, e.e20 + (x.close - e.e20) * 2 / 21, e.e50 + (x.close - e.e50) * 2 / 51, e.e200 + (x.close - e.e200) * 2 / 201, e.e12 + (x.close - e.e12) * 2 / 13, e.e26 + (x.close - e.e26) * 2 / 27,
         e.sig + ((e.e12 + (x.close - e.e12) * 2 / 13) - (e.e26 + (x.close - e.e26) * 2 / 27) - e.sig) * 0.2::DOUBLE, e.atr + (x.tr - e.atr) * 2 / 15,
         CASE WHEN x.i = 2 THEN x.up ELSE e.gain + (x.up - e.gain) / 14 END, CASE WHEN x.i = 2 THEN x.down ELSE e.loss + (x.down - e.loss) / 14 END
  FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)"""


def _shape(k: str, name: str = "") -> str:
    o, h, l, c = (f"{x}{k}" for x in ("open", "high", "low", "close"))
    return (
        f"abs({c} - {o}) AS b{k}, {h} - {l} AS tr{k}, CASE WHEN {h} - {l} <= 0 THEN 0 ELSE abs({c} - {o}) / ({h} - {l}) END AS btr{k}, {c} >= {o} AS bull{k}, ({o} + {c}) / 2 AS mid{k}, "
        f"{c} > 0 AND ({h} - {l}) / {c} >= 0.01::DOUBLE AND ({h} - {l}) / {c} <= 0.1::DOUBLE AS ok{k}"
    )


def _trend(k: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {9 + k} PRECEDING AND {k} PRECEDING)"
    slope = f"regr_slope(close, i) {frame} / avg(close) {frame}"
    return f"CASE WHEN count(close) {frame} < 2 THEN 'neutral' WHEN {slope} > 0.00001::DOUBLE THEN 'up' WHEN {slope} < -0.00001::DOUBLE THEN 'down' ELSE 'neutral' END AS t{k}"


_CANDLE_BULL = ", ".join(f"'{n}'" for n in patterns.BULLISH)
PATTERNS = f"""
q AS (SELECT *, high - greatest(open, close) AS us, least(open, close) - low AS ls, volume / CASE WHEN vavg > 0 THEN vavg ELSE 1 END AS vr, {_shape('')}, {_shape('1')}, {_shape('2')}, {_trend(1)}, {_trend(2)}, {_trend(3)} FROM n),
p0 AS (SELECT *, CASE
    WHEN ok AND ok2 AND NOT bull2 AND bull AND b2 > 0.5 * tr2 AND btr1 <= 0.35 AND greatest(open1, close1) < close2 AND close > mid2 AND volume > volume2 AND t3 = 'down' THEN 'morning_star'
    WHEN ok AND ok2 AND bull2 AND NOT bull AND b2 > 0.5 * tr2 AND btr1 <= 0.35 AND least(open1, close1) > close2 AND close < mid2 AND volume > volume2 AND t3 = 'up' THEN 'evening_star'
    WHEN ok AND ok1 AND NOT bull1 AND bull AND open < close1 AND close > open1 AND t2 = 'down' THEN 'bullish_engulfing'
    WHEN ok AND ok1 AND bull1 AND NOT bull AND open > close1 AND close < open1 AND t2 = 'up' THEN 'bearish_engulfing'
    WHEN ok AND ok1 AND NOT bull1 AND bull AND open < low1 AND close > mid1 AND close < open1 AND t2 = 'down' THEN 'piercing_pattern'
    WHEN ok AND ok1 AND bull1 AND NOT bull AND open > high1 AND close < mid1 AND close > open1 AND t2 = 'up' THEN 'dark_cloud_cover'
    WHEN ok AND ok1 AND NOT bull1 AND bull AND b1 > 0 AND b > 0 AND open > close1 AND close < open1 AND b < 0.5 * b1 THEN 'bullish_harami'
    WHEN ok AND ok1 AND bull1 AND NOT bull AND b1 > 0 AND b > 0 AND open < close1 AND close > open1 AND b < 0.5 * b1 THEN 'bearish_harami'
    WHEN ok AND bull AND btr >= 0.95 AND ls <= 0.05 * b AND us <= 0.05 * b THEN 'bullish_marubozu'
    WHEN ok AND NOT bull AND btr >= 0.95 AND ls <= 0.05 * b AND us <= 0.05 * b THEN 'bearish_marubozu'
    WHEN ok AND b <= 0.05 * tr AND us > 0 AND ls > 0 THEN 'doji'
    WHEN ok AND btr <= 0.35 AND us >= 0.25 * tr AND ls >= 0.25 * tr THEN 'spinning_top'
    WHEN ok AND ls >= 2 * b AND us <= 0.1 * tr AND b > 0 AND least(open, close) >= low + 0.7 * tr THEN CASE WHEN t1 = 'up' THEN 'hanging_man' ELSE 'hammer' END
    WHEN ok AND us >= 2 * b AND ls <= 0.1 * tr AND b > 0 AND greatest(open, close) <= low + 0.3 * tr AND t1 = 'up' THEN 'shooting_star' END AS name FROM q),
p1 AS (SELECT *, CASE WHEN name LIKE '%_star' AND name <> 'shooting_star' THEN 3 WHEN name LIKE '%engulfing' OR name LIKE '%harami' OR name IN ('piercing_pattern', 'dark_cloud_cover') THEN 2 WHEN name IS NOT NULL THEN 1 END AS num_candles FROM p0),
p AS (SELECT *, CASE WHEN name IN ({_CANDLE_BULL}) THEN 'bullish' WHEN name IN ('doji', 'spinning_top') THEN 'neutral' WHEN name IS NOT NULL THEN 'bearish' END AS direction,
    CASE WHEN num_candles = 1 THEN 'single' WHEN num_candles > 1 THEN 'multi' END AS ptype, CASE num_candles WHEN 1 THEN vr >= 1.2 WHEN 2 THEN vr >= 1.2 WHEN 3 THEN volume > volume2 END AS confirm,
    CASE num_candles WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 END AS ptrend, CASE num_candles WHEN 1 THEN bar_date WHEN 2 THEN bar_date1 WHEN 3 THEN bar_date2 END AS pstart,
    round(CASE WHEN num_candles = 1 THEN least(0.5 * btr + 0.3 * (1 - (us + ls) / (tr + 1e-9)) + 0.2 * CASE WHEN vr > 0 THEN least(vr / 2, 1) ELSE 0.5 END, 1)
               WHEN num_candles > 1 THEN least(0.8 * btr + CASE WHEN (num_candles = 2 AND vr >= 1.2) OR (num_candles = 3 AND volume > volume2) THEN 0.2 ELSE 0 END, 1) END, 4) AS strength FROM p1)"""

FEATURES = f"""
g AS (SELECT p.*, e.e20 AS ema_20, e.e50 AS ema_50, e.e200 AS ema_200, e.atr AS atr_14, e.e12 - e.e26 AS macd_line, e.sig AS macd_signal, 100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi_14,
    CASE WHEN p.i >= 20 THEN avg(close) OVER w20 END AS m20, CASE WHEN p.i >= 20 THEN stddev_samp(close) OVER w20 END AS s20, CASE WHEN p.i >= 20 THEN avg(volume) OVER w20 END AS volume_sma20,
    CASE WHEN p.i >= 5 THEN avg(volume) OVER w5 END AS v5, CASE WHEN p.i >= 20 THEN max(high) OVER w20 END AS rolling_high_20, CASE WHEN p.i >= 20 THEN min(low) OVER w20 END AS rolling_low_20,
    lag(e.e20, 5) OVER w AS e20b, lag(e.e50, 5) OVER w AS e50b, lag(e.atr, 5) OVER w AS atrb, lag(e.e12 - e.e26 > e.sig) OVER w AS above1, lead(close, 5) OVER w AS later
  FROM p JOIN e ON e.symbol = p.symbol AND e.i = p.i
  WINDOW w AS (PARTITION BY p.symbol ORDER BY p.i), w20 AS (PARTITION BY p.symbol ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY p.symbol ORDER BY p.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, lag(rolling_high_20) OVER (PARTITION BY symbol ORDER BY i) AS rh1, abs(close - open) AS body_size, us AS upper_wick, ls AS lower_wick, high - low AS total_range,
    (CAST(ema_20 > ema_50 AS INT) + CAST(ema_50 > ema_200 AS INT) + CAST(ema_20 > ema_200 AS INT) - CAST(ema_20 < ema_50 AS INT) - CAST(ema_50 < ema_200 AS INT) - CAST(ema_20 < ema_200 AS INT)) / 3.0::DOUBLE AS trend_strength,
    m20 + 2 * s20 AS bbands_upper, m20 - 2 * s20 AS bbands_lower, open - close1 AS gap, (open - close1) / nullif(close1, 0) AS gap_pct, volume / nullif(volume_sma20, 0) AS volume_ratio,
    macd_line - macd_signal AS macd_hist, close / nullif(close10, 0) - 1 AS roc_10, (rolling_high_20 - close) / close AS distance_from_resistance, (close - rolling_low_20) / close AS distance_from_support,
    (later - close) / close AS forward_return_5d, atr_14 / close AS atr_ratio FROM g),
k AS (SELECT *, CAST(coalesce(volume_ratio > 2, false) AS INT) AS volume_spike, CAST(coalesce(close > rh1, false) AS INT) AS breakout_strength, CAST(coalesce(rsi_14 < 35, false) AS INT) AS rsi_oversold,
    CAST(coalesce(rsi_14 > 65, false) AS INT) AS rsi_overbought, coalesce(strength, 0) AS pattern_strength, CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS pattern_direction_num,
    CAST(coalesce(gap_pct > 0.005, false) AS INT) AS gap_up, CAST(coalesce(gap_pct < -0.005, false) AS INT) AS gap_down, {', '.join(f"CAST(coalesce(name = '{n}', false) AS INT) AS pat_{n}" for n in patterns.NAMES)} FROM h),
ft AS (SELECT *, body_size / nullif(total_range, 0) AS body_to_range_ratio, (upper_wick + lower_wick) / (body_size + 1e-9) AS wick_to_body_ratio, CASE WHEN close > open THEN 1 ELSE -1 END AS candle_direction,
    (close - ema_20) / nullif(ema_20, 0) AS price_vs_ema20, (close - ema_50) / nullif(ema_50, 0) AS price_vs_ema50, (ema_20 - e20b) / 5 AS ema20_slope, (ema_50 - e50b) / 5 AS ema50_slope,
    CAST(coalesce(high > high1 AND high1 > high2, false) AS INT) AS higher_highs, CAST(coalesce(low < low1 AND low1 < low2, false) AS INT) AS lower_lows,
    CAST(coalesce(atr_14 > 1.2 * atrb, false) AS INT) AS volatility_expansion, CAST(coalesce(atr_14 < 0.8 * atrb, false) AS INT) AS volatility_contraction,
    (bbands_upper - bbands_lower) / close AS bb_width, (close - bbands_lower) / nullif(bbands_upper - bbands_lower, 0) AS bb_position,
    coalesce(CASE WHEN gap_up = 1 THEN least(greatest((open - low) / abs(gap), 0), 1) WHEN gap_down = 1 THEN least(greatest((high - open) / abs(gap), 0), 1) END, 0)::DOUBLE AS gap_fill_pct,
    volume / nullif(v5, 0) AS relative_volume, CAST(coalesce(volume > volume1 AND volume1 > volume2, false) AS INT) AS volume_trend,
    CASE WHEN NOT coalesce(above1, false) AND macd_line > macd_signal THEN 1 WHEN coalesce(above1, false) AND NOT macd_line > macd_signal THEN -1 ELSE 0 END AS macd_crossover,
    ((rsi_14 - 50) / 50 + sign(macd_hist) + sign(roc_10)) / 3.0::DOUBLE AS momentum_score, CASE ptype WHEN 'single' THEN 1 WHEN 'multi' THEN 2 ELSE 0 END AS pattern_candle_count,
    pattern_strength * pattern_direction_num AS pattern_signed_strength, CAST(pat_hammer = 1 AND trend_strength < -0.33::DOUBLE AS INT) AS hammer_in_downtrend, CAST(pat_shooting_star = 1 AND trend_strength > 0.33::DOUBLE AS INT) AS shooting_star_in_uptrend,
    pat_bullish_engulfing * volume_spike AS engulfing_high_volume, pat_bearish_engulfing * volume_spike AS bearish_engulfing_vol,
    CAST(coalesce(pat_doji = 1 AND distance_from_resistance < 0.02, false) AS INT) AS doji_near_resistance, CAST(coalesce(pat_doji = 1 AND distance_from_support < 0.02, false) AS INT) AS doji_near_support,
    pat_bullish_marubozu * breakout_strength AS marubozu_with_breakout, CAST((pat_morning_star = 1 OR pat_evening_star = 1) AND (rsi_oversold = 1 OR rsi_overbought = 1) AS INT) AS star_rsi_extreme,
    CAST((pat_bullish_harami = 1 OR pat_bearish_harami = 1) AND volume_spike = 0 AS INT) AS harami_low_volume, pattern_strength * greatest(0, pattern_direction_num) AS pattern_bullish_score, pattern_strength * greatest(0, -pattern_direction_num) AS pattern_bearish_score,
    CASE WHEN forward_return_5d / (atr_ratio + 1e-9) > 0.5 THEN 1 WHEN forward_return_5d / (atr_ratio + 1e-9) < -0.5 THEN -1 WHEN forward_return_5d IS NOT NULL THEN 0 END AS target_label FROM k)"""
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in f.COLUMNS)
SCORED = f"""
z AS (SELECT * FROM ft WHERE {_COMPLETE}), fr0 AS (SELECT * FROM z WHERE target_label IS NOT NULL), fr AS (SELECT * FROM fr0 QUALIFY count(*) OVER (PARTITION BY symbol) >= 50),
sc AS (SELECT *, exp(-momentum_score) / (exp(momentum_score) + 1 + exp(-momentum_score)) AS p_bear, 1.0::DOUBLE / (exp(momentum_score) + 1 + exp(-momentum_score)) AS p_neutral, exp(momentum_score) / (exp(momentum_score) + 1 + exp(-momentum_score)) AS p_bull FROM z),
sp AS (SELECT *, CASE WHEN p_bear >= p_neutral AND p_bear >= p_bull THEN -1 WHEN p_neutral >= p_bull THEN 0 ELSE 1 END AS prediction FROM sc),
st AS (SELECT * FROM sp WHERE target_label IS NOT NULL)"""
SIGNALS = """
c0 AS (SELECT *, CASE WHEN trend_strength >= 0.33::DOUBLE THEN 'UPTREND' WHEN trend_strength <= -0.33::DOUBLE THEN 'DOWNTREND' ELSE 'SIDEWAYS' END AS trend_context,
    CASE WHEN rsi_14 <= 35 THEN 'OVERSOLD' WHEN rsi_14 >= 65 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS rsi_zone, volume_ratio >= 1.5 AS volume_confirmation,
    CASE WHEN volatility_expansion = 1 THEN 'EXPANDING' WHEN volatility_contraction = 1 THEN 'CONTRACTING' ELSE 'NEUTRAL' END AS volatility_state, abs(distance_from_support) <= 0.02::DOUBLE AS near_support,
    abs(distance_from_resistance) <= 0.02::DOUBLE AS near_resistance, gap_up = 1 OR gap_down = 1 AS gap_present,
    CASE WHEN ema_20 > ema_50 AND ema_50 > ema_200 THEN 'BULLISH' WHEN NOT ema_20 > ema_50 AND NOT ema_50 > ema_200 THEN 'BEARISH' ELSE 'MIXED' END AS ema_alignment FROM sp),
c1 AS (SELECT *, volume_ratio >= 1.5 AS high_volume, abs(trend_strength) >= 0.67::DOUBLE AS strong_trend, abs(momentum_score) >= 0.33::DOUBLE OR macd_crossover <> 0 AS momentum_confirmation, near_support OR near_resistance AS level_reaction,
    trend_context = 'SIDEWAYS' AS sideways_market, total_range / close < 0.01::DOUBLE AS candle_too_small, total_range / close > 0.1::DOUBLE AS candle_too_large,
    round(least(abs(trend_strength) * (abs(momentum_score) + 0.5), 1), 4) AS continuation_probability, round(least(abs(rsi_14 - 50) / 50 * pattern_strength * (1 + volume_spike * 0.5), 1), 4) AS reversal_probability FROM c0),
c2 AS (SELECT *, round(least(greatest(greatest(p_bull, p_bear) + 0.05::DOUBLE * CAST(high_volume AS INT) + 0.05::DOUBLE * CAST(strong_trend AS INT) + 0.05::DOUBLE * CAST(momentum_confirmation AS INT) + 0.05::DOUBLE * CAST(level_reaction AS INT)
    - 0.1::DOUBLE * CAST(sideways_market AS INT) - 0.15::DOUBLE * CAST(candle_too_small OR candle_too_large AS INT), 0), 1), 4) AS confidence_value FROM c1),
c3 AS (SELECT *, CASE WHEN confidence_value >= 0.7 THEN 'HIGH' WHEN confidence_value >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_score, CASE WHEN confidence_value >= 0.7 THEN 'STRONG' WHEN confidence_value >= 0.55 THEN 'MODERATE' ELSE 'WEAK' END AS signal_strength,
    CASE WHEN p_bull >= 0.45 AND (p_bull - p_bear > 0.05 OR direction = 'bullish') THEN 'BUY' WHEN p_bear >= 0.45 AND (p_bull - p_bear < -0.05 OR direction = 'bearish') THEN 'SELL' ELSE 'HOLD' END AS signal FROM c2),
c4 AS (SELECT *, CASE WHEN signal = 'BUY' THEN close - lower_wick - 0.1::DOUBLE * atr_14 ELSE close + upper_wick + 0.1::DOUBLE * atr_14 END AS by_wick, CASE WHEN signal = 'BUY' THEN close - 1.5 * atr_14 ELSE close + 1.5 * atr_14 END AS by_atr FROM c3),
c5 AS (SELECT *, pattern_candle_count < 2 AND by_wick > 0 AND abs(close - by_wick) < 2 * atr_14 AS wicked FROM c4),
sg AS (SELECT *, round(close, 2) AS entry_price, CASE WHEN signal = 'HOLD' THEN round(close, 2) WHEN wicked THEN round(by_wick, 2) ELSE round(by_atr, 2) END AS stoploss,
    CASE WHEN signal = 'HOLD' THEN 0 WHEN wicked THEN round(abs(close - by_wick) / close * 100, 3) ELSE round(abs(close - by_atr) / close * 100, 3) END AS risk_pct,
    CASE WHEN signal = 'HOLD' THEN 'none' WHEN wicked THEN 'pattern' ELSE 'atr_fallback' END AS stoploss_method, coalesce(name, 'none') AS pattern_detected,
    concat_ws('; ', CASE WHEN candle_too_small THEN 'candle range < 1% of close (too small)' END, CASE WHEN candle_too_large THEN 'candle range > 10% of close (likely news / circuit)' END,
      CASE WHEN confidence_value < 0.5 THEN format('confidence {:.2f} < minimum 0.5', confidence_value) END, CASE WHEN sideways_market AND NOT high_volume THEN 'pattern in sideways market without volume confirmation' END) AS reject_reason FROM c5),
si AS (SELECT *, reject_reason <> '' AS reject_signal FROM sg),
rk AS (SELECT *, row_number() OVER (PARTITION BY bar_date ORDER BY reject_signal, confidence_value DESC, symbol) AS place FROM si), rp AS (SELECT * FROM rk WHERE place <= 20 AND NOT reject_signal)"""

_DATED = ", ".join(f"DATE '{d}'" for d in sorted(set(DATED_HOLIDAYS)))
TRADES = f"""
cal AS (SELECT CAST(d AS DATE) AS d FROM generate_series((SELECT min(bar_date) FROM b), (SELECT max(bar_date) FROM b) + INTERVAL 30 DAY, INTERVAL 1 DAY) AS s(d)),
td AS (SELECT d FROM cal WHERE isodow(d) < 6 AND d NOT IN ({_DATED})),
ci AS (SELECT *, coalesce(greatest((high - close1) / close1, (close1 - low) / close1) >= 0.1::DOUBLE, false) AS circuit FROM n),
tb AS (SELECT symbol, bar_date, open, high, low, close, circuit, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS j FROM ci WHERE bar_date IN (SELECT d FROM td)),
en0 AS (SELECT s.*, (SELECT min(d) FROM td WHERE d > s.bar_date) AS entry_date FROM (SELECT symbol, bar_date, signal, stoploss AS stop, pattern_detected, confidence_score, confidence_value, pattern_strength FROM si WHERE signal <> 'HOLD') s),
en AS (SELECT en0.*, tb.open AS entry, tb.j, CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS way, tb.open + 2 * abs(tb.open - stop) * CASE WHEN signal = 'BUY' THEN 1 ELSE -1 END AS goal
  FROM en0 JOIN tb ON tb.symbol = en0.symbol AND tb.bar_date = en0.entry_date WHERE NOT tb.circuit AND tb.open > 0 AND abs(tb.open - stop) >= 0.01::DOUBLE),
wk AS (SELECT en.symbol, en.bar_date, tb.bar_date AS d, tb.j - en.j AS step, tb.close, CASE WHEN way = 1 THEN tb.low <= stop ELSE tb.high >= stop END AS stopped, CASE WHEN way = 1 THEN tb.high >= goal ELSE tb.low <= goal END AS reached
  FROM en JOIN tb ON tb.symbol = en.symbol AND tb.j BETWEEN en.j + 1 AND en.j + 5),
wa AS (SELECT symbol, bar_date, min(step) FILTER (stopped OR reached) AS hit, max(step) AS last FROM wk GROUP BY symbol, bar_date),
ex AS (SELECT en.*, wk.d, wk.close AS c, coalesce(wk.stopped, false) AS stopped, coalesce(wk.reached, false) AS reached FROM en LEFT JOIN wa USING (symbol, bar_date) LEFT JOIN wk ON wk.symbol = en.symbol AND wk.bar_date = en.bar_date AND wk.step = coalesce(wa.hit, wa.last)),
ey AS (SELECT *, CASE WHEN stopped THEN stop WHEN reached THEN goal ELSE coalesce(c, entry) END AS leave FROM ex),
tr0 AS (SELECT *, (leave - entry) * way / entry AS raw FROM ey),
tr AS (SELECT symbol, bar_date AS signal_date, entry_date, coalesce(d, entry_date) AS exit_date, signal AS direction, round(entry, 2) AS entry_price, round(leave, 2) AS exit_price, round(stop, 2) AS stoploss, round(goal, 2) AS target,
  CASE WHEN stopped THEN 'STOPLOSS' WHEN reached THEN 'TARGET' ELSE 'HOLD_EXPIRED' END AS exit_reason, round(raw * 100, 3) AS raw_return_pct, round((raw - 0.00436::DOUBLE) * 100, 3) AS net_return_pct, raw - 0.00436::DOUBLE > 0 AS win,
  pattern_detected, confidence_score, confidence_value, pattern_strength, entry AS entry_open FROM tr0)"""
CURVE = """
od AS (SELECT *, row_number() OVER (ORDER BY signal_date, symbol) AS seq FROM tr),
cv AS (SELECT 0::BIGINT AS seq, NULL::DATE AS signal_date, NULL::VARCHAR AS symbol, 0::BIGINT AS shares, 0.0::DOUBLE AS notional, 0.0::DOUBLE AS pnl, 1000000.0::DOUBLE AS value
  UNION ALL
  SELECT seq, signal_date, symbol, held, held * e, held * e * r, value + held * e * r FROM (
    SELECT *, CASE WHEN shares0 * e > 0.3::DOUBLE * value THEN greatest(1, CAST(floor(0.3::DOUBLE * value / e) AS BIGINT)) ELSE shares0 END AS held FROM (
      SELECT od.seq, od.signal_date, od.symbol, od.entry_open AS e, od.net_return_pct / 100 AS r, cv.value, greatest(1, CAST(floor(0.01::DOUBLE * cv.value / abs(od.entry_open - od.stoploss)) AS BIGINT)) AS shares0 FROM cv JOIN od ON od.seq = cv.seq + 1))),
cu AS (SELECT * FROM cv WHERE seq > 0),
dd AS (SELECT seq, value AS portfolio_after, greatest(max(value) OVER (ORDER BY seq), 1000000) AS peak FROM cu), dr AS (SELECT *, (portfolio_after - peak) / peak AS drawdown FROM dd)"""

_MD = ", ".join(f"({m}, {d})" for m, d in YEARLY_HOLIDAYS)
CLEANING = f"""
rb AS (SELECT *, CASE WHEN symbol LIKE 'R%' THEN close * 0.5 ELSE close END AS adj_close FROM b),
aj AS (SELECT symbol, bar_date, CASE WHEN s THEN open * ratio ELSE open END AS open, CASE WHEN s THEN high * ratio ELSE high END AS high, CASE WHEN s THEN low * ratio ELSE low END AS low, adj_close AS close, volume, adj_close
  FROM (SELECT *, adj_close / nullif(close, 0) AS ratio, bool_or(abs(adj_close / nullif(close, 0) - 1) > 0.01::DOUBLE) OVER (PARTITION BY symbol) AS s FROM rb)),
sp0 AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS bar_date FROM (SELECT symbol, min(bar_date) AS lo, max(bar_date) AS hi FROM aj GROUP BY symbol)),
sn AS (SELECT * FROM sp0 WHERE isodow(bar_date) < 6 AND (month(bar_date), day(bar_date)) NOT IN ({_MD})),
ms AS (SELECT sn.* FROM sn ANTI JOIN aj USING (symbol, bar_date)),
mr AS (SELECT *, sum(CASE WHEN gap_ IS NULL OR gap_ > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_date)::BIGINT AS run FROM (SELECT *, date_diff('day', lag(bar_date) OVER (PARTITION BY symbol ORDER BY bar_date), bar_date) AS gap_ FROM ms)),
mg AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS size FROM mr),
jo AS (SELECT sn.symbol, sn.bar_date, aj.* EXCLUDE (symbol, bar_date), mg.size FROM sn LEFT JOIN aj USING (symbol, bar_date) LEFT JOIN mg USING (symbol, bar_date)),
fi AS (SELECT symbol, bar_date, size, {', '.join(f'coalesce({c}, lag({c}, 1) OVER w, lag({c}, 2) OVER w) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'adj_close'))} FROM jo WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
gf AS (SELECT symbol, bar_date, open, high, low, close, volume, adj_close FROM fi WHERE close IS NOT NULL AND coalesce(size, 0) <= 2 AND symbol IN (SELECT symbol FROM ms)
  UNION ALL SELECT symbol, bar_date, open, high, low, close, volume, adj_close FROM aj WHERE symbol NOT IN (SELECT symbol FROM ms))"""


def clipped(source: str) -> str:
    return f"""SELECT symbol, bar_date, CASE WHEN hit THEN open * (new / close) ELSE open END AS open,
  CASE WHEN hit AND hits THEN greatest(high * (new / close), low * (new / close)) WHEN hits THEN greatest(high, low) ELSE high END AS high, CASE WHEN hit THEN low * (new / close) ELSE low END AS low, new AS close, volume
  FROM (SELECT *, CASE WHEN hit THEN before * (1 + CASE WHEN move > 0 THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END) ELSE close END AS new, bool_or(hit) OVER (PARTITION BY symbol) AS hits
    FROM (SELECT *, coalesce(abs(move) > 0.2::DOUBLE, false) AS hit FROM (SELECT *, close / before - 1 AS move FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) AS before FROM {source}))))"""


BASE = [TICKS]
STEPS = {"n": [NUMBERED], "pat": [NUMBERED, PATTERNS], "feat": [NUMBERED, MEANS, PATTERNS, FEATURES], "scored": [NUMBERED, MEANS, PATTERNS, FEATURES, SCORED], "sig": [NUMBERED, MEANS, PATTERNS, FEATURES, SCORED, SIGNALS]}
STEPS |= {"trades": [*STEPS["sig"], TRADES], "curve": [*STEPS["sig"], TRADES, CURVE], "clean": [CLEANING], "b": []}


def sql(level: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(BASE + STEPS[level]) + "\n" + body



def recent(n: int, body: str) -> str:
    """As `sql` at level `pat`, over the newest `n` bars of each symbol alone."""
    few = f"b AS (SELECT * FROM b_all QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) <= {n})"
    return "WITH RECURSIVE " + ",".join([TICKS.replace("b AS (", "b_all AS ("), "\n" + few, *STEPS["pat"]]) + "\n" + body


def r(*names: str) -> str:
    """Columns rounded as the queries round them."""
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)
