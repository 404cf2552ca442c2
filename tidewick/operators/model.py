"""Splits, weights, the ensemble of two boosters and its metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.prefix import running
from . import boosting
from .boosting import CLASSES
from .features import BINARY, COLUMNS

#: The model's inputs in their order: scaled ones, then those of few values.
INPUTS = [c for c in COLUMNS if c not in BINARY] + BINARY


def time_split(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds `part`: test for the last months, train before; a short history tests its last quarter. One row is broadcast."""
    span = rows.agg(F.min("bar_date").alias("first"), F.max("bar_date").alias("last")).withColumn("months", F.floor(F.datediff("last", "first") / 30))
    test = F.when(F.col("months") < 24, F.greatest(F.lit(1), F.floor(F.col("months") * 0.25))).otherwise(cfg.test_months).cast("int")
    cut = span.select(F.add_months("last", -test).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col("bar_date") <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def standardize(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean over its population deviation (1 where that is 0)."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    joined = rows.crossJoin(F.broadcast(stats)).withColumns(scaled)
    return joined.select(*rows.columns)


def class_weights(rows: DataFrame, label: str = "target_label") -> DataFrame:
    """Rows label, n, weight: all rows over the number of classes times the rows of the class."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row for each class
    return n.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def last_fold(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Adds `fold`: in order of date, the last of `folds` + 1 equal parts validates, all before fit; one day isn't split.

    Dates are few, so they are ranked by their counts; one row for each.
    """
    days = rows.groupBy("bar_date").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(every.orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(every)
    marked = days.select("bar_date", F.when(upto > total - F.floor(total / (folds + 1)), "validate").otherwise("fit").alias("fold"))
    return rows.join(marked, "bar_date")


#: Rows without which nothing is trained, and without which nothing is tested.
LEAST_TRAIN, LEAST_TEST = 100, 20


def train_model(rows: DataFrame, cfg: Config = DEFAULT, boosters: tuple[boosting.Booster, ...] = (boosting.FIRST, boosting.SECOND)) -> PipelineModel:
    """`train` on the part before the test months; raises ValueError if either part has too few rows."""
    split = time_split(rows, cfg)
    n = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if n.get("train", 0) < LEAST_TRAIN or n.get("test", 0) < LEAST_TEST:
        raise ValueError(f"too few rows: {n.get('train', 0)} to train on ({LEAST_TRAIN} needed), {n.get('test', 0)} to test on ({LEAST_TEST} needed)")
    return train(split.where("part = 'train'"), boosters)


def train(rows: DataFrame, boosters: tuple[boosting.Booster, ...] = (boosting.FIRST, boosting.SECOND)) -> PipelineModel:
    """Scaling and two boosters of three binary ensembles each, as one pipeline.

    Inputs of many values are centred and divided by their population deviation over all `rows`. The last fold by date
    validates and stops the boosters; the rows before it are fitted, weighted by class.
    """
    kept = rows.select("bar_date", "target_label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS]).persist()
    try:
        folds = last_fold(kept)
        weights = F.broadcast(class_weights(folds.where("fold = 'fit'")).select("target_label", "weight"))  # a row for each class
        weight = F.when(F.col("fold") == "validate", 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
        data = folds.join(weights, "target_label", "left").withColumns({"weight": weight, "validates": F.col("fold") == "validate"})
        smooth = [c for c in COLUMNS if c not in BINARY]
        n = kept.count()
        steps = [
            VectorAssembler(inputCols=smooth, outputCol="raw_inputs"), StandardScaler(inputCol="raw_inputs", outputCol="sample_inputs", withMean=True),
            # from the sample deviation to that of the population
            ElementwiseProduct(scalingVec=Vectors.dense([(n / max(1, n - 1)) ** 0.5] * len(smooth)), inputCol="sample_inputs", outputCol="scaled_inputs"),
            VectorAssembler(inputCols=["scaled_inputs", *BINARY], outputCol="inputs"),
        ]
        scaling = Pipeline(stages=steps).fit(data)
        return PipelineModel([*scaling.stages, *boosting.fit(scaling.transform(data), boosters)])
    finally:
        kept.unpersist()


def boosters_of(model: PipelineModel) -> dict[str, list[GBTClassificationModel]]:
    """The binary models of each booster, classes in order."""
    out: dict[str, list[GBTClassificationModel]] = {}
    for stage in model.stages:
        if isinstance(stage, GBTClassificationModel):
            out.setdefault(stage.getPredictionCol()[2:].rpartition("_")[0], []).append(stage)
    return out


def ensemble(scored: DataFrame, first: str, second: str) -> DataFrame:
    """Adds p_bear, p_neutral, p_bull, the means of two probability arrays, and the first class with the largest mean."""
    mean = F.zip_with(first, second, lambda a, b: (a + b) / 2)
    out = scored.withColumn("_p", mean)
    best = (F.array_position("_p", F.array_max("_p")) - 2).cast("int")
    return out.withColumns({"p_bear": F.get("_p", F.lit(0)), "p_neutral": F.get("_p", F.lit(1)), "p_bull": F.get("_p", F.lit(2)), "prediction": best}).drop("_p")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds the probabilities and the class by both boosters together, and the class by each; missing inputs count as 0."""
    arrays = [boosting.probabilities(name) for name in boosters_of(model)]
    # the rows as they came stay aside, whatever the pipeline makes of its inputs
    aside = rows.select(F.struct(*rows.columns).alias("_row"))
    filled = aside.select("_row", *[F.coalesce(F.col("_row")[c].cast("double"), F.lit(0.0)).alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in COLUMNS])
    scored = model.transform(filled).select("_row", arrays[0].alias("_a"), arrays[-1].alias("_b"))
    mean = F.zip_with("_a", "_b", lambda a, b: (a + b) / 2)
    label = lambda c: (F.array_position(c, F.array_max(c)) - 2).cast("int")
    said = [F.get(mean, F.lit(k)).alias(name) for k, name in enumerate(("p_bear", "p_neutral", "p_bull"))]
    names = [c for c in rows.columns if c not in ("p_bear", "p_neutral", "p_bull", "prediction", "first_label", "second_label")]
    return scored.select(*[F.col("_row")[c].alias(c) for c in names], *said, label(mean).alias("prediction"), label(F.col("_a")).alias("first_label"), label(F.col("_b")).alias("second_label"))


def momentum_scorer(rows: DataFrame) -> DataFrame:
    """Probabilities without a fit: the softmax of the momentum score, 0 and its negative."""
    up, down = F.exp("momentum_score"), F.exp(-F.col("momentum_score"))
    total = up + 1.0 + down
    out = rows.withColumn("_p", F.array(down / total, 1.0 / total, up / total))
    return ensemble(out, "_p", "_p").drop("_p")


def importances(model: PipelineModel, top_n: int | None = None) -> list[tuple[str, float]]:
    """Features and their mean weight in the trees of all boosters and classes, the `top_n` largest or all."""
    every = [m.featureImportances.toArray() for models in boosters_of(model).values() for m in models]
    mean = sum(every) / len(every)
    return sorted(zip(INPUTS, mean.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top_n]


def explain(model: PipelineModel, rows: DataFrame, folder: str) -> DataFrame:
    """Rows symbol, bar_date, class, feature, value: Shapley values of the first booster; `feature` is a place in INPUTS.

    As boosting.attributions has it: of many rows the first ones by symbol and date are explained; trees are written
    below `folder` and read again.
    """
    first = next(iter(boosters_of(model).values()))
    filled = rows.select("symbol", "bar_date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS])
    scaled = PipelineModel([s for s in model.stages if not isinstance(s, GBTClassificationModel)]).transform(filled)
    return boosting.attributions(first, scaled, ["symbol", "bar_date"], folder)


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: n rows, accuracy, and the mean over classes of the area under the curve."""
    right = scored.agg(F.count("*").alias("n"), F.avg((F.col("target_label") == F.col("prediction")).cast("double")).alias("accuracy"))
    area = auc_ovr(scored).agg(F.avg("auc").alias("roc_auc_macro"))
    return right.crossJoin(F.broadcast(area))  # one row each


def named(scored: DataFrame) -> DataFrame:
    """Rows symbol, bar_date, predicted_label, predicted_class, the probabilities and their largest, as a user reads them,
    and the class by each booster where a fitted model has scored."""
    label = F.when(F.col("prediction") < 0, "bearish").when(F.col("prediction") > 0, "bullish").otherwise("neutral")
    probabilities = [F.round(c, 4).alias(name) for c, name in (("p_bear", "prob_bearish"), ("p_neutral", "prob_neutral"), ("p_bull", "prob_bullish"))]
    return scored.select("symbol", "bar_date", F.col("prediction").alias("predicted_label"), label.alias("predicted_class"), *probabilities, F.round(F.greatest("p_bear", "p_neutral", "p_bull"), 4).alias("confidence"), *[c for c in ("first_label", "second_label") if c in scored.columns])


def predict_single(scored: DataFrame, symbol: str, date: str) -> dict:
    """The named prediction of one bar; a dict with `error` if there is none."""
    found = named(scored.where((F.col("symbol") == symbol) & (F.col("bar_date") == F.lit(date).cast("date")))).first()
    return found.asDict() if found else {"symbol": symbol, "date": date, "error": f"no row of {symbol} on {date}"}


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("target_label", "prediction").agg(F.count("*").alias("n"))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, and the accuracy of all."""
    y, p = F.col("target_label"), F.col("prediction")
    rows = scored.select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("label"), y.alias("y"), p.alias("p"))
    count = lambda c: F.sum(c.cast("int"))
    sums = rows.groupBy("label").agg(
        count((F.col("y") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), count(F.col("p") == F.col("label")).alias("said"),
        count(F.col("y") == F.col("label")).alias("support"), count(F.col("y") == F.col("p")).alias("right"), F.count("*").alias("n"),
    )
    precision, recall = F.coalesce(F.col("tp") / F.nullif("said", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    out = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support", (F.col("right") / F.col("n")).alias("accuracy"))


def report_averages(report: DataFrame) -> DataFrame:
    """The macro and the weighted mean of a class report's rows."""
    total = F.sum("support")
    means = []
    for name, mean in (("macro", F.avg), ("weighted", lambda c: F.sum(F.col(c) * F.col("support")) / F.nullif(total, F.lit(0)))):
        means.append(F.struct(F.lit(name).alias("average"), *[mean(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")))
    return report.agg(F.array(*means).alias("_m")).select(F.inline("_m"))


def confusion_grid(scored: DataFrame) -> DataFrame:
    """All pairs of classes with their counts, those that don't occur too, and the share of the true class's rows."""
    cell = lambda y, p: F.struct(F.lit(y).alias("target_label"), F.lit(p).alias("prediction"), F.sum(((F.col("target_label") == y) & (F.col("prediction") == p)).cast("int")).cast("long").alias("n"))
    grid = scored.agg(F.array(*[cell(y, p) for y in CLASSES for p in CLASSES]).alias("_g")).select(F.inline("_g")).na.fill(0, ["n"])
    return grid.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("target_label")), F.lit(0)))


def auc_ovr(scored: DataFrame) -> DataFrame:
    """One class against the rest: rank statistics with mean ranks for ties, from counts of each distinct score.

    Scores are counted before they are ranked; the running count goes over range partitions of all classes' scores.
    """
    scores = F.array(*[F.struct(F.lit(c).alias("label"), F.col(p).alias("score")) for c, p in zip(CLASSES, ("p_bear", "p_neutral", "p_bull"), strict=True)])
    rows = scored.select("target_label", F.explode(scores).alias("x")).select("x.label", F.round("x.score", 9).alias("score"), (F.col("target_label") == F.col("x.label")).cast("long").alias("hit"))
    ties = rows.groupBy("label", "score").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    ranked = running(ties, ["label"], ["score"], F.col("n"), "upto").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("label").agg(F.sum(F.col("rank") * F.col("hits")).alias("r"), F.sum("hits").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return sums.select("label", ((F.col("r") - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))


def pattern_accuracy(scored: DataFrame, least: int = 5) -> DataFrame:
    named = scored.where(F.col("pattern_name").isNotNull())
    return named.groupBy("pattern_name").agg(F.count("*").alias("n"), F.avg((F.col("target_label") == F.col("prediction")).cast("double")).alias("accuracy")).where(F.col("n") >= least)


def tier_accuracy(scored: DataFrame) -> DataFrame:
    best = F.greatest("p_bear", "p_neutral", "p_bull")
    tier = F.when(best >= 0.70, "HIGH").when(best >= 0.55, "MEDIUM").otherwise("LOW")
    return scored.groupBy(tier.alias("tier"), (F.col("pattern_strength") > 0).cast("int").alias("has_pattern")).agg(F.count("*").alias("n"), F.avg((F.col("target_label") == F.col("prediction")).cast("double")).alias("accuracy"))
