"""Train/test splits as long frames (row_id, role, ...) (SPL)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import hash32
from molquarry.operators.positions import dense_positions, smallest


def all_train(df: DataFrame) -> DataFrame:
    return df.withColumn("role", F.lit("train"))


def all_test(df: DataFrame) -> DataFrame:
    return df.withColumn("role", F.lit("test"))


def by_range(df: DataFrame, start: int, end: int, row_id: str = "row_id") -> DataFrame:
    """Test rows at the positions [start, end); the end may lie beyond the table."""
    inside = (F.col(row_id) >= start) & (F.col(row_id) < end)
    return df.withColumn("role", F.when(inside, "test").otherwise("train"))


def test_count(n: int, test_size: float | None = None, train_size: float | None = None) -> int:
    """ceil(n * test_size); with a train size the test size is 1 - train_size as a binary double,
    rounding noise included."""
    if test_size is None:
        test_size = 0.1 if train_size is None else 1 - train_size
    return min(n, math.ceil(n * test_size))


def by_shuffle(df: DataFrame, n_splits: int = 1, seed: int = 42, test_size: float | None = None, train_size: float | None = None, row_id: str = "row_id", rows: int | None = None) -> DataFrame:
    """(row_id, split, role): independent splits, each a pure function of (seed, split, row_id)."""
    rows = df.count() if rows is None else rows
    size = test_count(rows, test_size, train_size)
    hashes = [hash32(F.lit(seed), F.lit(k), F.col(row_id)) for k in range(n_splits)]
    cuts = smallest(df, hashes, row_id, size)
    # a split is known by its cut value: no row is sorted or moved
    roles = [F.when(c.inside(h, row_id), "test").otherwise("train") if c else F.lit("train") for c, h in zip(cuts, hashes)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("split"), r.alias("role")) for k, r in enumerate(roles))))
    return df.select(row_id, each.alias("x")).select(row_id, "x.split", "x.role")


def by_fold(df: DataFrame, k: int, rows: int, row_id: str = "row_id") -> DataFrame:
    """df with fold = floor(row_id * k / rows): k contiguous test ranges that cover the table."""
    return df.withColumn("fold", F.floor(F.col(row_id) * k / rows).cast("int"))


def nested(df: DataFrame, outer: tuple[int, int], inner: tuple[int, int], row_id: str = "row_id") -> DataFrame:
    """(row_id, role, inner_role): the inner range counts positions among the outer training rows and
    is given in absolute row ids; inner_role is null for outer test rows."""
    split = by_range(df.select(row_id), *outer, row_id=row_id)
    placed = dense_positions(split.where("role = 'train'").select(row_id), [row_id], "_p")
    within = placed.select(row_id, F.when((F.col("_p") >= inner[0]) & (F.col("_p") < inner[1]), "test").otherwise("train").alias("inner_role"))
    return split.join(within, row_id, "left")


def nested_roles(df: DataFrame, outer: list[Column], inner: list[Column]) -> DataFrame:
    """df with (outer, inner, role): every pair of splitters. A splitter is a predicate that says which rows
    are test rows; role is outer_test, inner_test or train, and inner ones only part the outer training rows."""
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("outer"), F.lit(i).alias("inner"), F.when(a, "outer_test").when(b, "inner_test").otherwise("train").alias("role")) for o, a in enumerate(outer) for i, b in enumerate(inner))))
    return df.withColumn("_x", each).select(*df.columns, "_x.*")


def batches(df: DataFrame, size: int, skip: int = 0, row_id: str = "row_id") -> DataFrame:
    """(row_id, batch_id) of consecutive batches in row order; the first `skip` are left out."""
    if size <= 0:
        raise ValueError("a batch needs at least one row")
    placed = dense_positions(df.select(row_id), [row_id], "_p")
    return placed.select(row_id, F.floor(F.col("_p") / size).cast("bigint").alias("batch_id")).where(F.col("batch_id") >= skip)


def is_ascending(positions: list[int]) -> bool:
    return all(a < b for a, b in zip(positions, positions[1:]))


def split_frames(df: DataFrame, split: DataFrame, row_id: str = "row_id") -> dict[int, dict[str, DataFrame]]:
    """For each split number the training and test rows of df; split is the frame of by_shuffle."""
    numbers = sorted(r[0] for r in split.select("split").distinct().collect())
    part = lambda k, role: df.join(split.where((F.col("split") == k) & (F.col("role") == role)).select(row_id), row_id, "left_semi")
    return {k: {role: part(k, role) for role in ("train", "test")} for k in numbers}
