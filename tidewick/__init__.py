"""Tidewick: daily price-bar analytics written as Spark DataFrame transformations."""
