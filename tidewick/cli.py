"""Command line: fetch-free verbs over tables of bars, and `run`, which chains them.

    python -m tidewick.cli load --raw csv_folder --out bars.parquet
    python -m tidewick.cli preprocess --bars bars.parquet --out clean.parquet
    python -m tidewick.cli features --bars clean.parquet --out features.parquet
    python -m tidewick.cli train --features features.parquet --out model --rounds 500
    python -m tidewick.cli signals --bars clean.parquet --model model --out reports --date 2024-03-01 --top-n 20
    python -m tidewick.cli backtest --bars clean.parquet --signals signals.parquet --out trades.parquet
    python -m tidewick.cli run --raw csv_folder --out work [--skip-fetch] [--retrain]
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .operators import backtest, boosting, clean, features, model, signals
from .sources import bars as source
from .sources import checked
from .sources.shared import folder

#: Verbs and what each reads.
VERBS = {
    "load": ["raw"], "preprocess": ["bars"], "features": ["bars"], "train": ["features"], "evaluate": ["features", "model"], "predict": ["bars", "model"], "signals": ["bars", "model"],
    "backtest": ["bars", "signals"], "run": ["raw"],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewick")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, needs in VERBS.items():
        p = verbs.add_parser(verb)
        for name in [*needs, "out"]:
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--symbols", nargs="*")
        p.add_argument("--date")
        p.add_argument("--top-n", type=int, default=DEFAULT.top_n)
        p.add_argument("--min-days", type=int, default=DEFAULT.min_trading_days)
        p.add_argument("--capital", type=float, default=DEFAULT.capital)
        p.add_argument("--hold-days", type=int, default=DEFAULT.hold_days)
        p.add_argument("--rounds", type=int, default=boosting.FIRST.rounds)
        p.add_argument("--most-open", type=int, help="take no trade while so many are open; no limit without it")
        p.add_argument("--retrain", action="store_true", help="train anew though a model is there")
        p.add_argument("--skip-fetch", action="store_true", help="take the bars that are there")
    return top


class Job:
    """One call of the command line: its arguments, session and settings."""

    def __init__(self, args: argparse.Namespace, spark: SparkSession):
        self.args, self.spark = args, spark
        self.cfg = Config(capital=args.capital, hold_days=args.hold_days, top_n=args.top_n)

    def read(self, path: str) -> DataFrame:
        df = self.spark.read.parquet(path)
        return df.where(F.col("symbol").isin(self.args.symbols)) if self.args.symbols else df

    def there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, rows: DataFrame, path: str, kind: str = "json") -> None:
        """A small table as one file."""
        rows.coalesce(1).write.mode("overwrite").format(kind).save(path)

    def load(self, raw: str, out: str) -> None:
        """Bars of all symbols with enough rows; what couldn't be read goes beside them, with reasons."""
        bars, bad = checked.read_csv_bars(self.spark, raw)
        source.write_bars(source.with_history(bars, self.args.min_days), out)
        bad.write.mode("overwrite").json(f"{out.rstrip('/')}_bad")

    def preprocess(self, bars: str, out: str) -> None:
        rows = self.read(bars)
        lacks = [] if "adj_close" in rows.columns else [F.col("close").alias("adj_close")]
        whole = rows.select("*", *lacks).withColumn("adj_close", F.coalesce("adj_close", "close"))
        source.write_bars(clean.preprocess(whole, self.cfg), out)

    def features(self, bars: str, out: str) -> None:
        features.features(self.read(bars), self.cfg).write.mode("overwrite").parquet(out)

    def train(self, rows: str, out: str) -> None:
        boosters = tuple(replace(b, rounds=self.args.rounds) for b in (boosting.FIRST, boosting.SECOND))
        model.train_model(self.read(rows), self.cfg, boosters).write().overwrite().save(out)

    def evaluate(self, rows: str, fitted: str, out: str) -> None:
        own = PipelineModel.load(fitted)
        test = model.time_split(self.read(rows), self.cfg).where("part = 'test'")
        scored = model.predict(own, test)
        tables = {"metrics": model.evaluate(scored), "classes": model.class_report(scored), "confusion": model.confusion_matrix(scored), "patterns": model.pattern_accuracy(scored), "tiers": model.tier_accuracy(scored)}
        tables["importances"] = self.spark.createDataFrame(model.importances(own, 20), "feature string, weight double")
        tables["attributions"] = boosting.top_features(model.explain(own, test, folder(self.spark, "trees")), model.INPUTS)
        for name, found in tables.items():
            self.write(found, f"{out}/{name}")

    def predict(self, bars: str, fitted: str, out: str) -> None:
        rows = features.scoring_rows(self.read(bars), self.cfg)
        rows = rows.where(F.col("bar_date") == F.lit(self.args.date).cast("date")) if self.args.date else signals.latest_rows(rows)
        model.named(model.predict(PipelineModel.load(fitted), rows)).write.mode("overwrite").json(out)

    def signals(self, bars: str, fitted: str, out: str) -> None:
        rows = features.scoring_rows(self.read(bars), self.cfg)
        found = signals.signals(model.predict(PipelineModel.load(fitted), rows), self.cfg)
        if self.args.date:
            found = found.where(F.col("bar_date") == F.lit(self.args.date).cast("date"))
        found.write.mode("overwrite").parquet(f"{out}/signals")
        report = signals.daily_report(self.spark.read.parquet(f"{out}/signals"), self.cfg.top_n)
        source.write_report(report, f"{out}/report")
        signals.report_page(report).orderBy("bar_date", "rank").select("line").write.mode("overwrite").text(f"{out}/text")

    def backtest(self, bars: str, asked: str, out: str) -> None:
        done = backtest.trades(self.read(asked), self.read(bars), self.cfg)
        if self.args.most_open:
            done = backtest.position_limits(done, self.args.most_open).where("taken").drop("taken")
        done.write.mode("overwrite").parquet(out)
        done = self.spark.read.parquet(out)
        source.write_report(done, f"{out.rstrip('/')}_csv")
        found = backtest.metrics(done, self.cfg)
        self.write(found, f"{out.rstrip('/')}_summary")  # one row
        found.show(truncate=False)

    def run(self, raw: str, out: str) -> None:
        """All verbs in turn below `out`; bars that are there are kept with --skip-fetch, a model is unless --retrain."""
        at = {name: f"{out}/{name}" for name in ("bars", "clean", "features", "model", "judged", "reports", "trades")}
        if not (self.args.skip_fetch and self.there(at["bars"])):
            self.load(raw, at["bars"])
        self.preprocess(at["bars"], at["clean"])
        self.features(at["clean"], at["features"])
        if self.args.retrain or not self.there(at["model"]):
            self.train(at["features"], at["model"])
        self.evaluate(at["features"], at["model"], at["judged"])
        self.signals(at["clean"], at["model"], at["reports"])
        self.backtest(at["clean"], f"{at['reports']}/signals", at["trades"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidewick").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    # filters over 79 derived columns let inferred constraints outgrow the driver's heap; no plan here gains by them
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    getattr(Job(args, spark), args.verb)(*[getattr(args, name) for name in (*VERBS[args.verb], "out")])


if __name__ == "__main__":
    main()
