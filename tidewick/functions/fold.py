"""Folds over ordered rows whose every step depends on the one before, in segments of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder, stored, written
from .prefix import ranked

#: Rows of a group that one task folds at a time.
SEGMENT = 100_000


def folded(rows: DataFrame, group: str, order: list[str], step: Callable[[pd.DataFrame, tuple | None], pd.DataFrame], added: str, state: list[str], segment: int = SEGMENT) -> DataFrame:
    """Each row with `_seq`, its number from 1 within its group in `order`, and the columns `added` by the fold.

    `step` gets a segment of a group as a frame, in order, and what the segment before it has left (None at first): the
    values of the columns `state` in its last row. It returns the frame with the columns `added`. Segments of all groups
    are folded side by side, those of one group one after the other, each in a task of its own that holds at most
    `segment` rows. So the number of rounds is that of the largest group's segments, and what a round makes is stored
    before the next one begins. Rows equal in `order` are interchangeable. An empty table gives no rows.
    """
    spark, names = rows.sparkSession, [f.split()[0] for f in added.split(", ")]
    numbered = ranked(rows, [group], order, "_seq").withColumn("_segment", F.expr(f"(_seq - 1) div {segment}"))
    numbered = stored(numbered)
    rounds = numbered.agg(F.coalesce(F.max("_segment") + 1, F.lit(0))).first()[0]
    kinds = dict(rows.dtypes)
    columns = [*rows.columns, "_seq"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rows.columns], "_seq long", added])
    path = folder(spark, "fold")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_seq", kind="stable")
        first = part["_state"].iloc[0] if "_state" in part else None
        left = None if first is None else tuple(first[c] if isinstance(first, dict) else getattr(first, c) for c in state)
        out = step(part[columns].reset_index(drop=True), left)
        return out[[*columns, *names]]

    done = None
    for k in range(rounds):
        part = numbered.where(F.col("_segment") == k)
        if done is not None:
            after = done.groupBy(F.col(group).alias("_group")).agg(F.max_by(F.struct(*state), "_seq").alias("_state"))
            part = part.join(after, F.col(group).eqNullSafe(F.col("_group")))
        done = written(part.groupBy(group).applyInPandas(fold, schema), f"{path}/segment={k}")
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(empty.schema).parquet(*[f"{path}/segment={k}" for k in range(rounds)]) if rounds else empty
