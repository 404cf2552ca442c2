"""Gradient-boosted trees for three classes, one class against the rest, and the attribution of what they say.

A booster is a binary ensemble for each class. Training stops by a validation fold: a round that doesn't lower the error
there ends it, and the rounds up to the best one are kept. Attributions are the Shapley values of the trees' expected
margins, where a feature that isn't known follows both branches by the shares of the training rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


@dataclass(frozen=True)
class Booster:
    """Settings of a booster; `least_gain` is the relative fall of the validation error without which a round is the last."""

    name: str
    rounds: int = 500
    depth: int = 6
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    least_gain: float = 1e-4
    bins: int = 32
    seed: int = 42


#: Two boosters of the same budget: deep trees on coarse bins, and shallower ones that learn faster on fine bins.
FIRST, SECOND = Booster("first"), Booster("second", depth=4, step=0.1, bins=64, seed=43)


def fit(data: DataFrame, boosters: tuple[Booster, ...] = (FIRST, SECOND), together: int = 3) -> list[GBTClassificationModel]:
    """A model for each booster and class, classes first, for `data` (inputs, target_label, weight, validates).

    `together` models are fitted at a time, as their many small jobs leave executors idle. `data` is kept while that
    lasts.
    """
    marked = data.select("inputs", "weight", "validates", *[(F.col("target_label") == c).cast("double").alias(f"is_{k}") for k, c in enumerate(CLASSES)]).persist()

    def one(b: Booster, k: int) -> GBTClassificationModel:
        out = f"{b.name}_{k}"
        trees = GBTClassifier(
            featuresCol="inputs", labelCol=f"is_{k}", weightCol="weight", validationIndicatorCol="validates", maxIter=b.rounds, maxDepth=b.depth, stepSize=b.step, subsamplingRate=b.rows,
            featureSubsetStrategy=str(b.columns), validationTol=b.least_gain, maxBins=b.bins, seed=b.seed + k, maxMemoryInMB=512, predictionCol=f"y_{out}",
        )
        return trees.setProbabilityCol(f"p_{out}").setRawPredictionCol(f"r_{out}").fit(marked)

    try:
        with ThreadPoolExecutor(together) as pool:
            jobs = [pool.submit(inheritable_thread_target(data.sparkSession)(one), b, k) for b in boosters for k in range(len(CLASSES))]
            return [job.result() for job in jobs]
    finally:
        marked.unpersist()


def probabilities(name: str) -> F.Column:
    """The classes' probabilities by one booster: those of its binary models over their sum."""
    each = [F.get(vector_to_array(f"p_{name}_{k}"), F.lit(1)) for k in range(len(CLASSES))]
    total = each[0] + each[1] + each[2]
    return F.array(*[p / total for p in each])


@dataclass
class Leaf:
    """A leaf's value, and for each feature on the way to it the range of values that leads there and the rows' share."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves(nodes: list[dict], weight: float) -> Iterator[Leaf]:
    """The leaves of one tree, `nodes` by id: prediction, cover, left, right (-1 at leaves), feature, threshold."""
    by = {n["id"]: n for n in nodes}
    stack: list[tuple[dict, dict]] = [(by[0], {})]
    while stack:
        n, way = stack.pop()
        if n["left"] < 0:
            steps = sorted(way.items())
            yield Leaf(weight * n["prediction"], [f for f, _ in steps], [s[0] for _, s in steps], [s[1] for _, s in steps], [s[2] for _, s in steps])
            continue
        low, high, share = way.get(n["feature"], (-math.inf, math.inf, 1.0))
        for child, bounds in ((by[n["left"]], (low, min(high, n["threshold"]))), (by[n["right"]], (max(low, n["threshold"]), high))):
            part = child["cover"] / n["cover"] if n["cover"] else 0.5
            stack.append((child, way | {n["feature"]: (*bounds, share * part)}))


def shapley(leaf: Leaf, inputs: np.ndarray) -> np.ndarray:
    """What each feature of a leaf adds to the margin of each row of `inputs`: rows by the leaf's features.

    A known feature lets a row through if it is in the range, an unknown one by its share. Products over all sets of the
    other features are summed by size, as the coefficients of a polynomial.
    """
    m = len(leaf.features)
    x = inputs[:, leaf.features]
    known = ((x > np.array(leaf.low)) & (x <= np.array(leaf.high))).astype(float)
    share = np.array(leaf.share)
    sizes = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    out = np.zeros((len(inputs), m))
    for j in range(m):
        sums = np.zeros((len(inputs), m))
        sums[:, 0] = 1.0
        for i in range(m):
            if i != j:
                with_i = sums[:, :-1] * known[:, i : i + 1]
                sums *= share[i]
                sums[:, 1:] += with_i
        out[:, j] = leaf.value * (known[:, j] - share[j]) * (sums @ sizes)
    return out


def nodes_of(spark: SparkSession, model: GBTClassificationModel, folder: str) -> DataFrame:
    """The nodes of a model's trees as a table: tree, id, prediction, cover, left, right, feature, threshold.

    The model is written below `folder`, and what was written is read.
    """
    path = f"{folder.rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    split = F.col("split")
    return n.select(
        F.col("treeID").alias("tree"), "id", "prediction", F.get("impurityStats", F.lit(0)).alias("cover"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


#: Rows that are explained at most.
EXPLAINED = 300


def attributions(models: list[GBTClassificationModel], rows: DataFrame, key: list[str], folder: str) -> DataFrame:
    """Rows key, class, feature, value: what each feature adds to the margin of each class in each of `rows`.

    `rows` has `key` and a vector `inputs`; of more than EXPLAINED rows the first by `key` are taken, which bounds what is
    broadcast. A model has at most rounds * 2 ** depth leaves; they are dealt out over the tasks, each explains all rows
    by its leaves, and a sum brings them together. Features that no tree uses have no row.
    """
    spark = rows.sparkSession
    some = rows.select(*key, vector_to_array("inputs").alias("inputs")).orderBy(*key).limit(EXPLAINED).toPandas()
    if some.empty:
        return rows.select(*key).where("false").selectExpr("*", "0 as class", "0 as feature", "0D as value")
    found = []
    for k, m in enumerate(models):
        trees: dict[int, list[dict]] = {}
        for r in nodes_of(spark, m, folder).collect():  # rounds * 2 ** (depth + 1) rows at most
            trees.setdefault(r["tree"], []).append(r.asDict())
        for t, weight in enumerate(m.treeWeights):
            found += [(CLASSES[k % len(CLASSES)], x.value, x.features, x.low, x.high, x.share) for x in leaves(trees[t], weight) if x.features]
    parts = max(1, min(len(found) // 200 + 1, spark.sparkContext.defaultParallelism * 4))
    table = spark.createDataFrame(found, "class int, value double, features array<int>, low array<double>, high array<double>, share array<double>").repartition(parts)
    inputs = spark.sparkContext.broadcast(np.array(some["inputs"].tolist(), float))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: dict[tuple[int, int], np.ndarray] = {}
            for r in batch.itertuples(index=False):
                leaf = Leaf(r.value, list(map(int, r.features)), list(r.low), list(r.high), list(r.share))
                for f, values in zip(leaf.features, shapley(leaf, inputs.value).T, strict=True):
                    total[r[0], f] = total.get((r[0], f), 0.0) + values
            for (c, f), values in total.items():
                yield pd.DataFrame({"row": np.arange(len(values)), "class": c, "feature": f, "value": values})

    summed = table.mapInPandas(explain, "row long, class int, feature int, value double").groupBy("row", "class", "feature").agg(F.sum("value").alias("value"))
    keys = spark.createDataFrame(some[key].assign(row=range(len(some))), rows.select(*key, F.lit(0).cast("long").alias("row")).schema)
    return summed.join(F.broadcast(keys), "row").select(*key, "class", "feature", "value")  # EXPLAINED rows


def top_features(found: DataFrame, names: list[str], n: int = 20) -> DataFrame:
    """Rows place, feature, mean_abs: the `n` features whose mean absolute attribution over rows and classes is largest."""
    total = found.agg(F.count_distinct(*[c for c in found.columns if c not in ("class", "feature", "value")])).first()[0]
    sums = found.groupBy("feature").agg((F.sum(F.abs("value")) / max(1, total * len(CLASSES))).alias("mean_abs"))
    # one row for each feature
    named = sums.collect()
    rows = sorted(((names[r["feature"]], r["mean_abs"]) for r in named), key=lambda x: (-x[1], x[0]))[:n]
    return found.sparkSession.createDataFrame([(k + 1, f, v) for k, (f, v) in enumerate(rows)], "place int, feature string, mean_abs double")
