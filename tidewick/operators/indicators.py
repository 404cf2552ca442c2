"""Smoothing and oscillators as window expressions, for series of any length."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, full, lag

#: What an exponential weight may have shrunk to where older rows are left out: below the precision of doubles.
NEGLIGIBLE = 1e-17
#: How far powers of a decay may grow inside a block, as a decimal exponent.
ROOM = 250


@dataclass(frozen=True)
class Smoothing:
    """The exponential mean e[s] = x[s], e[t] = (1 - alpha) e[t - 1] + alpha x[t] of `value`, from row `seed` = s on."""

    value: Column
    alpha: float
    out: str
    seed: int = 0

    @property
    def length(self) -> int:
        """Rows after which a weight is negligible."""
        return max(2, math.ceil(math.log(NEGLIGIBLE) / math.log(1 - self.alpha)))


def _grouped(asked: Iterable[Smoothing]) -> list[tuple[int, list[Smoothing]]]:
    """Block sizes and the means whose powers fit into such blocks."""
    groups: list[tuple[int, list[Smoothing]]] = []
    for s in sorted(asked, key=lambda s: -s.length):
        near = next((own for size, own in groups if _fits(s, size)), None)
        if near is None:
            groups.append((s.length, [s]))
        else:
            near.append(s)
    return groups


def _fits(s: Smoothing, size: int) -> bool:
    return s.length <= size and -math.log10(1 - s.alpha) * size <= ROOM


def _placed(df: DataFrame, asked: Iterable[Smoothing]) -> DataFrame:
    """Adds each row's place in its symbol and the values to be smoothed."""
    return df.select("*", (F.row_number().over(by_symbol()) - 1).alias("_k"), *[s.value.alias(f"_x_{s.out}") for s in asked])


def _means(rows: DataFrame, size: int, own: list[Smoothing]) -> DataFrame:
    """Adds means in blocks of `size` rows to placed rows. All its windows share one order, by block and date."""
    block = f"_block{size}"
    if block not in rows.columns:
        rows = rows.select("*", F.expr(f"_k div {size}").alias(block))
    inside = Window.partitionBy("symbol", block).orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol").orderBy(block, "bar_date").rowsBetween(Window.unboundedPreceding, -1)
    at, sums, means = F.col("_k") % size, [], []
    for s in own:
        share = F.when(F.col("_k") == s.seed, 1.0).otherwise(s.alpha)
        weighed = F.when(F.col("_k") >= s.seed, share * F.col(f"_x_{s.out}") * F.pow(F.lit(1 - s.alpha), -at))
        sums.append((F.sum(weighed).over(inside) * F.pow(F.lit(1 - s.alpha), at)).alias(f"_sum_{s.out}"))
        before = F.last(F.when(at == size - 1, F.col(f"_sum_{s.out}")), ignorenulls=True).over(earlier)
        mean = F.col(f"_sum_{s.out}") + F.pow(F.lit(1 - s.alpha), at + 1) * F.coalesce(before, F.lit(0.0))
        means.append(F.when(F.col("_k") >= s.seed, mean).alias(s.out))
    rows = rows.select("*", *sums)
    return rows.select(*[c for c in rows.columns if c not in {s.out for s in own}], *means)


def smoothed(df: DataFrame, *asked: Smoothing) -> DataFrame:
    """Adds the means of each symbol's rows; rows before a seed are null.

    Rows fall into blocks, as long as the weight of a block's first row needs to vanish at its end. Inside a block a mean
    is a running sum with powers of the decay, which stay in range; of earlier rows, only the block before still counts,
    with what its last row holds. Means whose powers fit into the same block share it, and with it a sort.
    """
    rows = _placed(df, asked)
    for size, own in _grouped(asked):
        rows = _means(rows, size, own)
    names = [s.out for s in asked]
    return rows.select(*[c for c in df.columns if c not in names], *names)


def smooth(df: DataFrame, value: str, alpha: float, out: str, seed: int = 0) -> DataFrame:
    """Adds one exponential mean of a column."""
    return smoothed(df, Smoothing(F.col(value), alpha, out, seed))


def span(n: int, out: str | None = None, value: str = "close") -> Smoothing:
    """The mean of `n` rows' centre of mass, as ema takes it."""
    return Smoothing(F.col(value), 2 / (n + 1), out or f"ema_{n}")


def ema(df: DataFrame, n: int, value: str = "close", out: str | None = None) -> DataFrame:
    return smoothed(df, span(n, out, value))


def moves(period: int = 14) -> tuple[Smoothing, Smoothing]:
    """Means of gains and losses from the second bar on."""
    move = F.col("close") - lag("close")
    up, down = (F.when(lag("close").isNotNull(), F.greatest(m, F.lit(0.0))) for m in (move, -move))
    return Smoothing(up, 1 / period, "_gain", 1), Smoothing(down, 1 / period, "_loss", 1)


def strength() -> Column:
    return 100 - 100 / (1 + F.col("_gain") / F.nullif("_loss", F.lit(0.0)))


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's relative strength; its means begin with the second bar, and it is null while there is no loss."""
    return smoothed(df, *moves(period)).withColumn(f"rsi_{period}", strength()).drop("_gain", "_loss")


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    return smoothed(df, Smoothing(true_range(), 2 / (n + 1), f"atr_{n}"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    rows = smoothed(df, span(fast, "_fast"), span(slow, "_slow")).withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    rows = smoothed(rows, span(signal, "macd_signal", "macd_line"))
    return rows.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("_fast", "_slow")


def every(df: DataFrame) -> DataFrame:
    """All means of the catalogue with their usual lengths: ema of 20, 50 and 200, atr_14, rsi_14 and the macd columns.

    The signal, a mean of means, takes the blocks of the last group, so it needs no sort of its own.
    """
    asked = [*[span(n) for n in (20, 50, 200)], Smoothing(true_range(), 2 / 15, "atr_14"), *moves(), span(12, "_fast"), span(26, "_slow")]
    rows = _placed(df, asked)
    for size, own in _grouped(asked):
        rows = _means(rows, size, own)
    line = F.col("_fast") - F.col("_slow")
    rows = rows.select("*", strength().alias("rsi_14"), line.alias("macd_line"), line.alias("_x_macd_signal"))
    signal = span(9, "macd_signal", "macd_line")
    rows = _means(rows, size if _fits(signal, size) else signal.length, [signal])
    names = ["ema_20", "ema_50", "ema_200", "atr_14", "rsi_14", "macd_line", "macd_signal"]
    return rows.select(*[c for c in df.columns if c not in names], *names, (F.col("macd_line") - F.col("macd_signal")).alias("macd_hist"))


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mean, spread = full(F.avg("close"), "close", n), full(F.stddev_samp("close"), "close", n)
    return df.withColumns({"bbands_mid": mean, "bbands_upper": mean + width * spread, "bbands_lower": mean - width * spread})
