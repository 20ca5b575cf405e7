"""Jobs (JOB, SNK6-8, HPO): training, evaluation and prediction as values that a runner executes in turn.

A job reads a frame, never rows on the driver; its results are frames and, where a folder is given,
CSV files of predictions and metrics in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators import models, search
from molquarry.operators.metrics import MetricStack
from molquarry.operators.select import gather
from molquarry.sources import sinks


@dataclass
class Finished:
    """What a job left: any of a model, predictions, and a metric frame with one row a role."""

    name: str
    model: object = None
    predicted: DataFrame | None = None
    measured: DataFrame | None = None


@dataclass
class TrainJob:
    kind: str
    features: str
    label: str
    parameters: dict = field(default_factory=dict)
    name: str = "train"

    def run(self, df: DataFrame) -> Finished:
        """Fit on all rows of df."""
        return Finished(self.name, models.estimator(self.kind, **self.parameters).fit(models.prepared(df, self.features, self.label)))


@dataclass
class TrainEvalJob:
    """Fit on the rows of role train, predict and measure both roles; with a folder, the predictions and
    metrics of each role go to <folder>/Outer_Step_<step>_{Train,Test}prediction and ..._metrics."""

    kind: str
    features: str
    label: str
    metrics: MetricStack
    parameters: dict = field(default_factory=dict)
    folder: str | None = None
    step: int = 0
    name: str = "train_eval"

    def run(self, df: DataFrame) -> Finished:
        model, predicted, measured = models.TrainEval(self.kind, self.features, self.label, self.metrics, self.parameters).run(df)
        if self.folder:
            for role in ("train", "test"):
                base = f"{self.folder}/Outer_Step_{self.step}_{role.title()}"
                sinks.export_predictions(predicted.where(F.col("role") == role), base + "prediction")
                measured.where(F.col("role") == role).drop("role").write.mode("overwrite").option("header", True).csv(base + "metrics")
        return Finished(self.name, model, predicted, measured)


@dataclass
class EvalJob:
    """Predict all rows of a labelled frame with a fitted model and measure them."""

    model: object
    features: str
    label: str
    metrics: MetricStack
    folder: str | None = None
    name: str = "eval"

    def run(self, df: DataFrame) -> Finished:
        predicted = models.predict(self.model, df.where(F.col(self.label).isNotNull()), self.features).withColumn("y", F.col(self.label).cast("double"))
        measured = self.metrics.calculate(predicted)
        if self.folder:
            sinks.export_predictions(predicted, f"{self.folder}/prediction")
            measured.write.mode("overwrite").option("header", True).csv(f"{self.folder}/metrics")
        return Finished(self.name, self.model, predicted, measured)


@dataclass
class PredictJob:
    """Score the rows at the given positions (None: all). table: also write row_id and the prediction as
    a table of its own, from which the caller joins or overwrites by position. An existing column of the
    prediction's name is replaced."""

    model: object
    features: str
    positions: list[int] | DataFrame | None = None
    table: str | None = None
    column: str = "prediction"
    row_id: str = "row_id"
    name: str = "predict"

    def run(self, df: DataFrame) -> Finished:
        rows = (df if self.positions is None else gather(df, self.positions, self.row_id)).drop(self.column)
        predicted = models.predict(self.model, rows, self.features).withColumnRenamed("p", self.column)
        if self.table:
            predicted.select(self.row_id, self.column).write.mode("errorifexists").parquet(self.table)
            written = df.sparkSession.read.parquet(self.table)
            predicted = rows.join(written, self.row_id)
        return Finished(self.name, self.model, predicted)


@dataclass
class CustomJob:
    """Any function from a frame to Finished."""

    function: Callable[[DataFrame], Finished]
    name: str = "custom"

    def run(self, df: DataFrame) -> Finished:
        return self.function(df)


JOBS = {"train": TrainJob, "train_eval": TrainEvalJob, "eval": EvalJob, "predict": PredictJob, "custom": CustomJob}


def create(job: str, /, **settings):
    """A job by its name."""
    if job not in JOBS:
        raise ValueError(f"no job {job}")
    return JOBS[job](**settings)


class Runner:
    """Runs jobs one after the other; each is distributed itself. A job that raises ends the run unless
    errors are kept, in which case its exception stands in `failed`."""

    def __init__(self, keep_errors: bool = False):
        self.keep_errors, self.finished, self.failed = keep_errors, [], []

    def run(self, jobs: list, df: DataFrame) -> list[Finished]:
        out = []
        for job in jobs:
            try:
                out.append(job.run(df))
            except Exception as error:
                if not self.keep_errors:
                    raise
                self.failed.append((job.name, error))
        self.finished += out
        return out


def role(test: Column) -> Column:
    return F.when(test, "test").otherwise("train")


@dataclass
class NestedSearch:
    """A full grid over outer and inner splits. A split is a predicate that says which rows are test rows;
    inner ones divide the training rows of an outer one. For each outer split the configuration of
    best mean over the inner ones is fit anew on all its training rows and measured on its test rows."""

    kind: str
    label: str
    metric: str
    outer: list[Column]
    inner: list[Column]

    def _measure(self, df: DataFrame, test: Column, config: dict) -> float:
        given = dict(config)
        features = given.pop("features")
        job = TrainEvalJob(self.kind, features, self.label, MetricStack((self.metric,)), given)
        measured = job.run(df.withColumn("role", role(test))).measured
        return float(measured.where("role = 'test'").first()[self.metric])

    def run(self, df: DataFrame, configs: dict | list[dict]) -> DataFrame:
        """(outer, config, features, parameters, inner_mean, outer_test, best), one row for each outer split
        and configuration; outer_test is null but for the best. Each configuration names its feature
        column as `features`."""
        one = configs if isinstance(configs, list) else [configs]
        tries = [c for config in one for c in search.grid(config)]
        rows = []
        for o, held in enumerate(self.outer):
            learned = df.where(~held).persist()
            means = [sum(self._measure(learned, test, c) for test in self.inner) / len(self.inner) for c in tries]
            learned.unpersist()
            best = min(range(len(tries)), key=lambda i: search.loss(means[i], self.metric))
            for i, (config, mean) in enumerate(zip(tries, means)):
                told = {k: v for k, v in config.items() if k != "features"}
                rows.append((o, i, config["features"], str(told), mean, self._measure(df, held, config) if i == best else None, i == best))
        return df.sparkSession.createDataFrame(rows, "outer int, config int, features string, parameters string, inner_mean double, outer_test double, best boolean")


def finished_table(spark: SparkSession, algorithm: str, finished: list[tuple[dict, Finished]], path: str | None = None) -> DataFrame:
    """(algorithm, parameters, train, test): one row a finished job with its metrics of both roles as JSON,
    also as a CSV where a path is given. One row a job is on the driver."""
    rows = []
    for parameters, job in finished:
        held = {r["role"]: {k: v for k, v in r.asDict().items() if k != "role"} for r in job.measured.collect()}
        rows.append((algorithm, str(parameters), *(str(held.get(name)) for name in ("train", "test"))))
    out = spark.createDataFrame(rows, "algorithm string, parameters string, train string, test string")
    if path:
        out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return out
