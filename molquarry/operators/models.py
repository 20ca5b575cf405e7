"""Models, jobs and checkpoints on pyspark.ml (MOD, JOB)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators.metrics import MetricStack

RENAMED = {"n_estimators": "numTrees", "iterations": "maxIter", "max_depth": "maxDepth", "depth": "maxDepth", "learning_rate": "stepSize", "random_state": "seed"}


def estimator(kind: str, **parameters):
    """A model by name; the usual parameter names of other libraries are understood."""
    from pyspark.ml import classification, regression

    known = {
        "random_forest_regressor": regression.RandomForestRegressor,
        "random_forest_classifier": classification.RandomForestClassifier,
        "boosted_trees_regressor": regression.GBTRegressor,
        "boosted_trees_classifier": classification.GBTClassifier,
        "linear_regression": regression.LinearRegression,
    }
    if kind not in known:
        raise ValueError(f"no model {kind}")
    given = {RENAMED.get(k, k): v for k, v in parameters.items()}
    return known[kind](featuresCol="_x", labelCol="_y", predictionCol="p", **given)


def prepared(df: DataFrame, features: str, label: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(label).isNotNull()).withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))


@dataclass
class TrainEval:
    """Fit on the training rows, predict and measure both parts."""

    kind: str
    features: str
    label: str
    metrics: MetricStack
    parameters: dict = field(default_factory=dict)
    role: str = "role"

    def run(self, df: DataFrame) -> tuple[object, DataFrame, DataFrame]:
        """(model, predictions with y and p, one metric row for each role)."""
        rows = prepared(df, self.features, self.label)
        model = estimator(self.kind, **self.parameters).fit(rows.where(F.col(self.role) == "train"))
        predicted = with_probability(model.transform(rows).withColumn("y", F.col("_y"))).drop("_x", "_y")
        return model, predicted, self.metrics.calculate(predicted, by=[self.role])


def with_probability(scored: DataFrame) -> DataFrame:
    """Class probabilities as a plain array, where a model gives any."""
    from pyspark.ml.functions import vector_to_array

    out = scored.drop("rawPrediction")
    return out.withColumn("probability", vector_to_array("probability")) if "probability" in scored.columns else out


def predict(model, df: DataFrame, features: str) -> DataFrame:
    """All rows of df with p, and with probability for classifiers."""
    from pyspark.ml.functions import array_to_vector

    return with_probability(model.transform(df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))))).drop("_x")


class Checkpoints:
    """A folder of named results with a manifest; the newest `keep` stay (-1: all), a name that
    exists raises. Tables and manifest lie on the folder's own file system, which all executors share."""

    def __init__(self, folder: str, keep: int = 3):
        self.folder, self.keep = folder.rstrip("/"), keep

    def _files(self):
        """(the folder's file system, a function from a name to its path)."""
        spark = SparkSession.active()
        jvm = spark.sparkContext._jvm
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def entries(self) -> list[dict]:
        files, path = self._files()
        if not files.exists(path("manifest.json")):
            return []
        stream = files.open(path("manifest.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def save(self, name: str, table: DataFrame, **meta) -> None:
        held = self.entries()
        if any(e["name"] == name for e in held):
            raise ValueError(f"the checkpoint {name} exists")
        files, path = self._files()
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}")  # what a broken save left is no entry
        held.append({"name": name, "meta": meta})
        old = [held.pop(0)["name"] for _ in range(max(0, len(held) - self.keep) if self.keep >= 0 else 0)]
        stream = files.create(path("manifest.json"), True)
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        for gone in old:
            files.delete(path(gone), True)

    def newest(self, spark) -> tuple[dict, DataFrame] | None:
        held = self.entries()
        return (held[-1], spark.read.parquet(f"{self.folder}/{held[-1]['name']}")) if held else None


def train_in_batches(step, batches, epochs: int, checkpoints: Checkpoints, state: DataFrame, every: int = 1):
    """A resumable loop: step(state, batch) gives the next state (a frame). After every `every` steps the
    state is saved; a run that finds one goes on at the batch after it. Returns the last state."""
    spark = state.sparkSession
    found = checkpoints.newest(spark)
    at = -1
    if found:
        at, state = found[0]["meta"]["step"], found[1]
    for epoch in range(epochs):
        for number, batch in enumerate(batches):
            place = epoch * len(batches) + number
            if place <= at:
                continue
            state = step(state, batch)
            if (place + 1) % every == 0:
                checkpoints.save(f"step_{place}", state, step=place, epoch=epoch, batch=number)
                state = checkpoints.newest(spark)[1]
    return state


def fitted_pipeline(df: DataFrame, steps: list, train: DataFrame | None = None) -> tuple[DataFrame, list]:
    """Apply steps in order: a function of a frame, or an encoder class with arguments, (cls, args...),
    that is fit on the training rows only. Gives the frame and the fitted steps."""
    train = df if train is None else train
    done = []
    for step in steps:
        if isinstance(step, tuple):
            step = step[0].fit(train, *step[1:])
        apply = step.transform if hasattr(step, "transform") else step
        df, train = apply(df), apply(train)
        done.append(step)
    return df, done
