"""Lexicographic sort, ranks, reorder, shuffle and top-k (SRT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import hash32
from molquarry.operators.positions import dense_positions


def lexsort(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(columns or df.columns))


def lexsort_rank(df: DataFrame, columns: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based dense rank of its rows: distinct keys are numbered and joined back."""
    numbered = dense_positions(df.select(*columns).distinct(), columns, name)
    return df.join(numbered.withColumn(name, F.col(name) + 1), columns)


def sort_by(df: DataFrame, key: Column, *ties: str) -> DataFrame:
    return df.orderBy(key, *ties)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "row_id") -> DataFrame:
    """df with its place in a seeded random order of the key."""
    return dense_positions(df.withColumn("_h", hash32(F.lit(seed), F.col(key))), ["_h", key], name).drop("_h")


def reordered(df: DataFrame, role: str = "role", row_id: str = "row_id", first: str = "train", name: str = "new_id") -> DataFrame:
    """df with new positions: rows of the first role, then the others, each in their old order."""
    return dense_positions(df.withColumn("_r", (F.col(role) != first).cast("int")), ["_r", row_id], name).drop("_r")


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n largest rows; ties by the given columns ascending (a distributed top-k, not a full sort)."""
    return df.orderBy(F.desc(by), *ties).limit(n)
