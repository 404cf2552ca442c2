"""Connected components of a graph by joins and aggregations alone; links and labels stay in Spark's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled


def components(links: DataFrame) -> DataFrame:
    """Rows node, comp for links (a, b): comp is the smallest node that can be reached. Only linked nodes have a row.

    Each round, a node takes the smallest label around it and then the label of that label (pointer jumping), so long
    chains halve; star-shaped links need two rounds. Every round is settled in reliable storage. Links may repeat and
    point either way; links with a null end count as none; an empty table gives no rows.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a != b")
    both = settled(links.union(links.select("b", "a")).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("near"))
        of = labels.select(F.col("node").alias("near"), F.col("comp").alias("jump"))
        new = settled(near.join(of, "near", "left").select("node", "old", F.least("near", F.coalesce("jump", "near")).alias("comp")))
        moved = not new.where("comp != old").isEmpty()
        labels = new.select("node", "comp")
        if not moved:
            return labels
