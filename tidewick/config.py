"""Defaults of every operator, in one place."""

from __future__ import annotations

from dataclasses import dataclass

#: Days without trading in every year, as (month, day).
YEARLY_HOLIDAYS = [(1, 26), (3, 25), (4, 14), (5, 1), (8, 15), (10, 2), (10, 24), (11, 1), (11, 15), (12, 25)]

#: Dated days without trading, for the backtest.
DATED_HOLIDAYS = [
    "2023-01-26", "2023-03-07", "2023-03-30", "2023-04-04", "2023-04-07", "2023-04-14", "2023-05-01", "2023-06-28", "2023-08-15", "2023-09-19",
    "2023-10-02", "2023-10-24", "2023-11-14", "2023-11-27", "2023-12-25",
    "2024-01-22", "2024-01-26", "2024-03-25", "2024-03-29", "2024-04-11", "2024-04-14", "2024-04-17", "2024-04-21", "2024-05-01", "2024-05-23",
    "2024-06-17", "2024-07-17", "2024-08-15", "2024-10-02", "2024-10-12", "2024-11-01", "2024-11-15", "2024-12-25",
    "2025-02-26", "2025-03-14", "2025-03-31", "2025-04-10", "2025-04-14", "2025-04-18", "2025-05-01", "2025-08-15", "2025-08-27", "2025-10-02",
    "2025-10-21", "2025-10-22", "2025-11-05", "2025-12-25",
    "2026-01-26", "2026-03-03", "2026-03-20", "2026-04-02", "2026-04-06", "2026-04-14", "2026-05-01", "2026-08-15", "2026-10-02", "2026-11-11", "2026-12-25",
]


@dataclass(frozen=True)
class Config:
    min_trading_days: int = 400
    split_tolerance: float = 0.01
    max_gap_fill: int = 2
    gap_join_days: int = 3
    max_return: float = 0.20
    min_range: float = 1e-4
    min_clean_rows: int = 60
    min_feature_rows: int = 50
    pattern_min_range: float = 0.01
    pattern_max_range: float = 0.10
    trend_window: int = 10
    flat_slope: float = 1e-5
    volume_window: int = 20
    volume_confirm: float = 1.2
    horizon: int = 5
    label_edge: float = 0.5
    test_months: int = 6
    stop_atr: float = 1.5
    buffer_atr: float = 0.1
    hold_days: int = 5
    capital: float = 1_000_000.0
    risk: float = 0.01
    max_notional: float = 0.30
    circuit: float = 0.10
    #: Two legs of brokerage and transaction tax, and the tax on brokerage.
    cost: float = 0.002 + 0.002 + 0.00036
    top_n: int = 20


DEFAULT = Config()
