"""Metrics as aggregate expressions over (y, p), all of one stack in one pass (MET, AGG8, AGG9)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.operators.positions import running_totals

HIGHER, LOWER, ONE, MIXED = "higher", "lower", "one", "mixed"


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def regression(y: str = "y", p: str = "p") -> dict[str, Column]:
    error = _d(y) - _d(p)
    mse = F.avg(error * error)
    return {
        "r2": 1 - mse / F.var_pop(_d(y)),
        "mae": F.avg(F.abs(error)),
        "mse": mse,
        "max_error": F.max(F.abs(error)),
        "explained_variance": 1 - F.var_pop(error) / F.var_pop(_d(y)),
    }


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary(y: str = "y", p: str = "p", positive: object = 1) -> dict[str, Column]:
    cell = lambda a, b: F.sum(((F.col(y) == F.lit(positive)) == F.lit(a)).cast("long") * ((F.col(p) == F.lit(positive)) == F.lit(b)).cast("long")).cast("double")
    tp, fn, fp, tn = cell(True, True), cell(True, False), cell(False, True), cell(False, False)
    right = F.avg((F.col(y) == F.col(p)).cast("double"))
    return {
        "accuracy": right,
        "zero_one_loss": 1 - right,
        "accuracy_count": F.sum((F.col(y) == F.col(p)).cast("long")).cast("double"),
        "hamming_loss": F.avg((F.col(y) != F.col(p)).cast("double")),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "jaccard": _ratio(tp, tp + fp + fn),
        "matthews": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


DIRECTIONS = {
    "r2": ONE, "mae": LOWER, "mse": LOWER, "max_error": LOWER, "explained_variance": HIGHER, "accuracy": HIGHER, "zero_one_loss": LOWER,
    "accuracy_count": HIGHER, "hamming_loss": LOWER, "precision": ONE, "recall": ONE, "f1": HIGHER, "jaccard": HIGHER, "matthews": HIGHER, "balanced_accuracy": HIGHER,
    "specificity": ONE, "specificity_matrix": HIGHER, "recall_matrix": HIGHER, "roc_auc": ONE, "confusion_matrix": MIXED, "roc_curve": MIXED,
}


def _item(metric: str, item: Column | None, value: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), (F.lit(None) if item is None else item).cast("string").alias("item"), value.cast("double").alias("value"))


@dataclass
class MetricStack:
    """Named aggregate expressions, computed together; equal if names and settings are equal."""

    names: tuple[str, ...]
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.names:
            raise ValueError("a stack needs at least one metric")

    def expressions(self, y: str = "y", p: str = "p") -> dict[str, Column]:
        known = regression(y, p) | binary(y, p, self.settings.get("positive", 1))
        if beyond := [n for n in self.names if n not in known]:
            raise ValueError(f"{beyond} are no single aggregates: use calculate_all")
        return {n: known[n] for n in self.names}

    def calculate_all(self, df: DataFrame, y: str = "y", p: str = "p", score: str = "score") -> DataFrame:
        """(metric, item, value) of any metrics. Scalars have no item; matrices have one row a label (or a
        pair of labels), a curve two a threshold. Aggregates share one pass, label metrics the cell
        counts; roc_auc and roc_curve read the score column."""
        positive = self.settings.get("positive", 1)
        single = [n for n in self.names if n in regression(y, p) | binary(y, p, positive)]
        parts = []
        if single:
            row = df.agg(*(e.alias(n) for n, e in MetricStack(tuple(single), self.settings).expressions(y, p).items()))
            parts.append(row.select(F.explode(F.array(*(_item(n, None, F.col(n)) for n in single))).alias("x")).select("x.*"))
        for n in self.names:
            if n == "balanced_accuracy":
                parts.append(balanced_accuracy(df, y, p).select(_item(n, None, F.col(n)).alias("x")).select("x.*"))
            elif n == "specificity":
                parts.append(specificity(df, self.settings.get("average", "macro"), y, p).select(_item(n, None, F.col(n)).alias("x")).select("x.*"))
            elif n in ("recall_matrix", "specificity_matrix"):
                of = recall_matrix if n == "recall_matrix" else specificity_matrix
                parts.append(of(df, y, p).select(_item(n, F.col("label"), F.col(n.removesuffix("_matrix"))).alias("x")).select("x.*"))
            elif n == "confusion_matrix":
                parts.append(cells(df, y, p).select(_item(n, F.concat_ws("/", "y", "p"), F.col("n")).alias("x")).select("x.*"))
            elif n == "roc_auc":
                parts.append(roc_auc(df, y, score, positive).select(_item(n, None, F.col(n)).alias("x")).select("x.*"))
            elif n == "roc_curve":
                at = F.when(F.col("threshold") == float("inf"), "inf").otherwise(F.format_string("%.6f", "threshold"))
                both = F.array(_item(n, F.concat(at, F.lit(":fpr")), F.col("fpr")), _item(n, F.concat(at, F.lit(":tpr")), F.col("tpr")))
                parts.append(roc_curve(df, y, score, positive).select(F.explode(both).alias("x")).select("x.*"))
            elif n not in single:
                raise ValueError(f"no metric {n}")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def calculate(self, df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, nulls: str = "raise") -> DataFrame:
        """One row (one for each group of `by`) with a column for each metric. Null labels or
        predictions raise when the result is computed, unless nulls is 'drop'."""
        if nulls == "drop":
            df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
        else:
            check = F.when(F.col(y).isNull() | F.col(p).isNull(), F.raise_error(F.lit("null label or prediction")).cast("double")).otherwise(_d(y) if df.schema[y].dataType.simpleString() != "string" else F.lit(None).cast("double"))
            if df.schema[y].dataType.simpleString() != "string":
                df = df.withColumn(y, check)
        return df.groupBy(*(by or [])).agg(*(e.alias(n) for n, e in self.expressions(y, p).items()))


def cells(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(y, p, n): the counts that label metrics are made of."""
    return df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))


def label_rates(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(label, tp, fn, fp, tn) of every label of y or p. Works on the cell counts only."""
    c = cells(df, y, p)
    total = c.agg(F.sum("n").alias("total"))
    sides = c.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp")),
    )).alias("s")).select("s.*")
    rates = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    # total is one row
    return rates.join(F.broadcast(total)).withColumn("tn", F.col("total") - F.col("tp") - F.col("fn") - F.col("fp")).drop("total")


def recall_matrix(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(label, recall); a label that never is true has recall 0."""
    return label_rates(df, y, p).select("label", _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"))


def specificity_matrix(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(label, specificity) = tn / (tn + fp); null where the label is the only true one."""
    return label_rates(df, y, p).select("label", F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp")).alias("specificity"))


def specificity(df: DataFrame, average: str = "macro", y: str = "y", p: str = "p") -> DataFrame:
    rates = label_rates(df, y, p)
    if average == "micro":
        return rates.agg((F.sum("tn") / F.sum(F.col("tn") + F.col("fp"))).alias("specificity"))
    return rates.agg(F.avg(F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))).alias("specificity"))


def recall_score(df: DataFrame, average: str = "macro", y: str = "y", p: str = "p") -> DataFrame:
    """(recall): the mean over labels (macro), or over all rows (micro)."""
    rates = label_rates(df, y, p)
    if average == "micro":
        return rates.agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("recall"))
    return rates.agg(F.avg(_ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))).alias("recall"))


def balanced_accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The mean of macro specificity and macro recall."""
    rates = label_rates(df, y, p)
    s = F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    r = _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return rates.agg(((F.avg(s) + F.avg(r)) / 2).alias("balanced_accuracy"))


#: labels of a confusion matrix, which become its columns
MOST_LABELS = 1_000


def confusion_matrix(df: DataFrame, labels: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """One row a label (column y) with a count for each predicted label, zero cells included. Without
    labels they are all that are true or predicted; given ones must hold all of them."""
    held = sorted(r[0] for r in cells(df, y, p).select(F.explode(F.array("y", "p")).alias("label")).where("label IS NOT NULL").distinct().limit(MOST_LABELS + 1).collect())
    if len(held) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if labels is None:
        labels = held
    elif not set(held) <= set(labels):
        raise ValueError(f"labels beyond the given ones: {sorted(set(held) - set(labels))[:5]}")
    grid = df.sparkSession.createDataFrame([(a,) for a in labels], "y string")
    counted = cells(df, y, p).groupBy("y").pivot("p", labels).agg(F.sum("n"))
    out = grid.join(counted, "y", "left")
    return out.select("y", *(F.coalesce(F.col(f"`{a}`"), F.lit(0)).cast("bigint").alias(f"pred_{a}") for a in labels))


def roc_points(df: DataFrame, y: str = "y", score: str = "score", positive: object = 1) -> DataFrame:
    """(score, tp, fp, pos, neg): cumulative counts for each distinct score, descending. Rows are first
    aggregated by score; the running totals need no single task."""
    hit = (F.col(y) == F.lit(positive)).cast("long")
    by_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    summed = running_totals(by_score, [F.desc("score")], ["pos", "neg"])
    return summed.select("score", F.col("cum_pos").cast("bigint").alias("tp"), F.col("cum_neg").cast("bigint").alias("fp"), "pos", "neg")


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", positive: object = 1) -> DataFrame:
    """(roc_auc): the chance that a positive scores above a negative, ties by half."""
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return roc_points(df, y, score, positive).agg((area / (F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", positive: object = 1) -> DataFrame:
    """(threshold, fpr, tpr): every distinct score (collinear points stay), and (infinity, 0, 0)."""
    points = roc_points(df, y, score, positive)
    totals = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    curve = points.join(F.broadcast(totals)).select(F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(curve)


def fold_average(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """The mean of each metric over the folds of each configuration."""
    return folds.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics))


def badness(value: Column, metric: str) -> Column:
    """What is to be minimised for a metric's direction; mixed ones raise."""
    direction = DIRECTIONS[metric]
    if direction == MIXED:
        raise ValueError(f"{metric} has no direction")
    return {HIGHER: -value, LOWER: value, ONE: F.abs(1 - value)}[direction]


def best(folds: DataFrame, metric: str, index: str = "fold") -> DataFrame:
    """The best row for the metric's direction; ties keep the smallest index."""
    return folds.orderBy(badness(F.col(metric), metric), index).limit(1)
