"""Hyper-parameter search (HPO): parameter ranges, full grids and seeded random search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators.metrics import DIRECTIONS, HIGHER, LOWER, MIXED


@dataclass(frozen=True)
class Range:
    """start, start + step, ... below stop (excluded); with count, that many even steps from start to
    stop (included)."""

    start: float
    stop: float
    step: float = 1
    count: int | None = None
    whole: bool = False

    def values(self) -> list:
        if self.count is not None:
            step = (self.stop - self.start) / max(1, self.count - 1)
            found = [self.start + i * step for i in range(self.count)]
        else:
            found = [self.start + i * self.step for i in range(max(0, math.ceil((self.stop - self.start) / self.step)))]
        return [int(v) for v in found] if self.whole else found


@dataclass(frozen=True)
class Choice:
    items: tuple

    def values(self) -> list:
        return list(self.items)


def options(value) -> list:
    return value.values() if isinstance(value, Range | Choice) else [value]


def grid(parameters: dict) -> list[dict]:
    """All combinations; the first parameter changes fastest."""
    names = list(parameters)
    turned = product(*(options(parameters[n]) for n in reversed(names)))
    return [dict(zip(names, reversed(t))) for t in turned]


def grid_frame(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """The same as a frame with the combination's number, for plans that join it."""
    rows = grid({k: Choice(tuple(v)) for k, v in parameters.items()})
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["combination", *parameters])


def loss(value: float, metric: str) -> float:
    direction = DIRECTIONS[metric]
    if direction == MIXED:
        raise ValueError(f"{metric} has no direction")
    return -value if direction == HIGHER else value if direction == LOWER else abs(1 - value)


def search(combinations: list[dict], folds: list[DataFrame], run: Callable[[dict, DataFrame], float], metric: str) -> tuple[dict, list[tuple[dict, float]]]:
    """(best combination, all with their mean over the folds). A fold is a frame with absolute roles;
    ties keep the first."""
    if not combinations or not folds:
        raise ValueError("a search needs combinations and folds")
    tried = [(c, sum(run(c, f) for f in folds) / len(folds)) for c in combinations]
    return min(tried, key=lambda t: loss(t[1], metric))[0], tried


def grid_search(configs: dict | list[dict], folds: list[DataFrame], run: Callable, metric: str):
    one = configs if isinstance(configs, list) else [configs]
    return search([c for config in one for c in grid(config)], folds, run, metric)


def random_search(configs: dict | list[dict], folds: list[DataFrame], run: Callable, metric: str, evaluations: int, seed: int = 42):
    """`evaluations` draws for each config; categories are drawn as values, never as indices."""
    one = configs if isinstance(configs, list) else [configs]
    drawn, chance = [], random.Random(seed)
    for config in one:
        for _ in range(evaluations):
            drawn.append({k: (chance.uniform(v.start, v.stop) if isinstance(v, Range) and not v.whole and v.count is None else chance.choice(options(v))) for k, v in config.items()})
    return search(drawn, folds, run, metric)


def results_frame(spark: SparkSession, tried: list[tuple[dict, float]], algorithm: str, metric: str) -> DataFrame:
    rows = [(algorithm, str(c), metric, float(v)) for c, v in tried]
    return spark.createDataFrame(rows, "algorithm string, parameter string, metric string, value double").orderBy(F.col("value"))
