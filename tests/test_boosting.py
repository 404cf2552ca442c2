"""Boosters, their validation fold and their attributions, on rows with known answers and against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidewick.config import Config
from tidewick.operators import boosting, model, signals
from tidewick.operators.features import BINARY, COLUMNS

SMALL = (boosting.Booster("first", rounds=6, depth=3, step=0.4, columns=1.0), boosting.Booster("second", rounds=6, depth=2, step=0.4, columns=1.0, seed=7))


def rows(spark, n=900, noise=0.0, seed=3):
    """Bars whose class follows from two inputs; with `noise`, some labels are drawn."""
    r, day, out = random.Random(seed), dt.date(2020, 1, 1), []
    for k in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        label = 1 if a > 0.4 else -1 if b > 0.2 else 0
        if r.random() < noise:
            label = r.choice((-1, 0, 1))
        out.append((f"S{k % 3}", day + dt.timedelta(k // 3 * 3), a, b, int(r.random() < 0.5), label))
    df = spark.createDataFrame(out, "symbol string, bar_date date, rsi_14 double, gap_pct double, gap_up int, target_label int")
    return df.withColumns({c: F.lit(0.0) for c in COLUMNS if c not in df.columns})


@pytest.fixture(scope="module")
def fitted(spark):
    return model.train_model(rows(spark), boosters=SMALL)


def test_known_answer_on_the_test_months(spark, fitted):
    test = model.time_split(rows(spark)).where("part = 'test'")
    scored = model.predict(fitted, test)
    one = model.evaluate(scored).first()
    assert one.n > 100 and one.accuracy > 0.95 and one.roc_auc_macro > 0.97
    assert set(test.columns) | {"p_bear", "p_neutral", "p_bull", "prediction", "first_label", "second_label"} == set(scored.columns)
    got = scored.selectExpr("abs(p_bear + p_neutral + p_bull - 1) < 1e-9 as sums", "first_label in (-1, 0, 1) as label", "prediction = first_label or prediction = second_label or true as any").collect()
    assert all(x.sums and x.label for x in got)
    first = scored.first()
    named = model.predict_single(scored, first.symbol, str(first.bar_date))
    assert named["predicted_label"] == first.prediction and named["first_label"] == first.first_label and named["second_label"] == first.second_label
    clashing = test.selectExpr("symbol", "bar_date", "rsi_14", "gap_pct", "1 as inputs", "2 as raw_inputs", "3 as _a", "4 as weight")  # inputs of the pipeline by name, most features missing
    assert sorted(model.predict(fitted, clashing).columns) == sorted([*clashing.columns, "p_bear", "p_neutral", "p_bull", "prediction", "first_label", "second_label"])


def test_importances_find_the_two_inputs(fitted):
    top = model.importances(fitted, 2)
    assert {f for f, _ in top} == {"rsi_14", "gap_pct"} and len(model.importances(fitted)) == len(COLUMNS)
    assert sum(v for _, v in model.importances(fitted)) == pytest.approx(1)


def test_signals_of_the_fitted_model(spark, fitted):
    scored = model.predict(fitted, rows(spark).where("bar_date > '2022-01-01'").withColumns({"close": F.lit(100.0), "pattern_name": F.lit(None).cast("string"), "pattern_direction": F.lit(None).cast("string")}))
    found = signals.signals(scored).groupBy("target_label", "signal").count().collect()
    said = {x.target_label: {y.signal: y["count"] for y in found if y.target_label == x.target_label} for x in found}
    assert said[1].get("BUY", 0) > 0.9 * sum(said[1].values()) and said[-1].get("SELL", 0) > 0.8 * sum(said[-1].values())


def test_scaling_is_by_the_population(spark, fitted):
    train = model.time_split(rows(spark)).where("part = 'train'")
    scaled = PipelineModel(fitted.stages[:4]).transform(train)
    values = np.array([x[0].toArray() for x in scaled.select("inputs").collect()])
    smooth = [c for c in COLUMNS if c not in BINARY]
    at = smooth.index("rsi_14")
    assert abs(values[:, at].mean()) < 1e-9 and abs(values[:, at].std() - 1) < 1e-9
    assert set(values[:, len(smooth) + BINARY.index("gap_up")]) == {0.0, 1.0}


def test_training_stops_by_the_validation_fold(spark):
    many = (boosting.Booster("first", rounds=40, depth=4, step=0.5, columns=1.0),)
    stopped = model.train(rows(spark, noise=0.6), many)
    taken = [m.getNumTrees for m in model.boosters_of(stopped)["first"]]
    assert max(taken) < 40
    # one round more wouldn't have helped: the error on the validation rows is lowest at the end
    data = PipelineModel(stopped.stages[:4]).transform(model.last_fold(rows(spark, noise=0.6)).where("fold = 'validate'"))
    for k, m in enumerate(model.boosters_of(stopped)["first"]):
        errors = m.evaluateEachIteration(data.withColumn("weight", F.lit(1.0)).withColumn(f"is_{k}", (F.col("target_label") == boosting.CLASSES[k]).cast("double")))
        assert errors[-1] == min(errors)


def test_saved_and_loaded(spark, fitted, tmp_path):
    fitted.write().save(str(tmp_path / "model"))
    test = rows(spark).limit(50)
    pick = lambda m: sorted(map(tuple, model.predict(m, test).select("symbol", "bar_date", F.round("p_bull", 9), "prediction").collect()))
    assert pick(PipelineModel.load(str(tmp_path / "model"))) == pick(fitted)


def expected(nodes, x, known, at=0):
    """The tree's value where only the features in `known` are known."""
    n = nodes[at]
    if n["left"] < 0:
        return n["prediction"]
    low, high = (expected(nodes, x, known, n[c]) for c in ("left", "right"))
    if n["feature"] in known:
        return low if x[n["feature"]] <= n["threshold"] else high
    return (nodes[n["left"]]["cover"] * low + nodes[n["right"]]["cover"] * high) / n["cover"]


def plain_shapley(nodes, x, features):
    out = {}
    for j in features:
        others = [f for f in features if f != j]
        out[j] = 0.0
        for size in range(len(others) + 1):
            weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(features))
            for some in itertools.combinations(others, size):
                out[j] += weight * (expected(nodes, x, {*some, j}) - expected(nodes, x, set(some)))
    return out


def random_tree(r, depth, features, cover=64.0):
    nodes = []

    def grow(level, rows):
        at = len(nodes)
        nodes.append({"id": at, "prediction": r.gauss(0, 1), "cover": rows, "left": -1, "right": -1, "feature": -1, "threshold": None})
        if level < depth and (level == 0 or r.random() < 0.8):
            part = rows * r.uniform(0.1, 0.9)
            nodes[at] |= {"feature": r.choice(features), "threshold": r.gauss(0, 1), "left": grow(level + 1, part), "right": grow(level + 1, rows - part)}
        return at

    grow(0, cover)
    return nodes


def test_shapley_values_against_all_subsets():
    r = random.Random(2)
    for depth in (1, 2, 3, 5):
        for _ in range(6):
            features = list(range(5))
            nodes = random_tree(r, depth, features)
            x = np.array([[r.gauss(0, 1) for _ in features] for _ in range(7)])
            got = np.zeros(x.shape)
            for leaf in boosting.leaves(nodes, 1.0):
                if leaf.features:
                    got[:, leaf.features] += boosting.shapley(leaf, x)
            for i in range(len(x)):
                want = plain_shapley({n["id"]: n for n in nodes}, x[i], features)
                assert np.allclose(got[i], [want[f] for f in features])


def test_attributions_of_fitted_trees(spark, tmp_path):
    r = random.Random(4)
    data = []
    for k in range(400):
        x = [r.gauss(0, 1) for _ in range(4)]
        data.append((k, Vectors.dense(x), 1 if x[0] + x[1] > 0.5 else -1 if x[2] > 0.5 else 0, 1.0, k % 5 == 0))
    df = spark.createDataFrame(data, ["id", "inputs", "target_label", "weight", "validates"])
    models = boosting.fit(df, (boosting.Booster("first", rounds=4, depth=3, step=0.5, columns=1.0),))
    found = boosting.attributions(models, df, ["id"], str(tmp_path))
    got = {}
    for x in found.collect():
        got.setdefault((x.id, x["class"]), {})[x.feature] = x.value
    assert {i for i, _ in got} == set(range(boosting.EXPLAINED))
    for k, m in enumerate(models):
        trees = {}
        for n in boosting.nodes_of(spark, m, str(tmp_path)).collect():
            trees.setdefault(n["tree"], {})[n["id"]] = n.asDict()
        margins = {x.id: x[f"r_first_{k}"][1] for x in m.transform(df.where("id < 20")).collect()}
        for i in range(0, 20, 4):
            x, want, base = data[i][1].toArray(), dict.fromkeys(range(4), 0.0), 0.0
            for t, weight in enumerate(m.treeWeights):
                used = sorted({n["feature"] for n in trees[t].values() if n["left"] >= 0})
                base += weight * expected(trees[t], x, set())
                for f, v in plain_shapley(trees[t], x, used).items():
                    want[f] += weight * v
            mine = got.get((i, boosting.CLASSES[k]), {})
            assert all(abs(mine.get(f, 0.0) - want[f]) < 1e-9 for f in want)
            assert abs(base + sum(mine.values()) - margins[i]) < 1e-9
    top = boosting.top_features(found, ["a", "b", "c", "d"], 3).collect()
    means = {f: sum(abs(v.get(k, 0.0)) for v in got.values()) / (3 * boosting.EXPLAINED) for k, f in enumerate("abcd")}
    assert [x.feature for x in top] == sorted(means, key=lambda f: -means[f])[:3] and [x.place for x in top] == [1, 2, 3]
    assert all(abs(x.mean_abs - means[x.feature]) < 1e-9 for x in top)
    assert boosting.attributions(models, df.where("false"), ["id"], str(tmp_path)).collect() == []


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="too few rows"):
        model.train_model(rows(spark, 60), Config())
