"""Operators on bars: cleaning, patterns, indicators, features, models, signals, backtest."""
