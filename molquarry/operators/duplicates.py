"""Duplicate statistics of whole rows, by two-level aggregation without a sort (AGG1, AGG2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("size"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(counted_entries, counted_duplicates, entry_most_duplicates) of the rows over the columns."""
    again = F.when(F.col("size") >= 2, F.col("size"))
    return group_sizes(df, columns).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("counted_entries"),
        F.coalesce(F.sum(again), F.lit(0)).alias("counted_duplicates"),
        F.coalesce(F.max(again), F.lit(0)).alias("entry_most_duplicates"),
    )


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(size, groups): how many groups of each size of two or more there are."""
    return group_sizes(df, columns).where("size >= 2").groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def by_last_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """(last column, rows): rows in groups of two or more equal in all columns but the last, counted by
    the last: all rows by the last column, less those whose prefix no other row has. Aggregates alone:
    no group is listed and no prefix is joined back."""
    *prefix, last = columns
    alone = df.groupBy(*prefix).agg(F.count(F.lit(1)).alias("n"), F.min(last).alias(last)).where("n = 1")
    signed = df.select(last, F.lit(1).alias("n")).unionByName(alone.select(last, F.lit(-1).alias("n")))
    return signed.groupBy(last).agg(F.sum("n").alias("rows")).where("rows > 0")


def value_domain(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """The distinct non-null values of several columns jointly."""
    return df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias(name)).where(F.col(name).isNotNull()).distinct()


def relevance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, relevant): whether any row differs from another, all columns in one aggregate."""
    found = df.agg(*((F.min(c) != F.max(c)).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(False)).alias("relevant")) for c in columns))
    return found.select(F.explode(pairs).alias("x")).select("x.*")


def constant_positions(df: DataFrame, vector: str) -> DataFrame:
    """(pos): 0-based positions of a vector column at which all rows agree."""
    cells = df.select(F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low = high").select("pos")


def without_positions(df: DataFrame, vector: str, positions: list[int]) -> DataFrame:
    """df with the entries at the positions taken out of the vector."""
    gone = F.array(*(F.lit(int(p)) for p in positions)).cast("array<int>")
    return df.withColumn(vector, F.filter(vector, lambda x, i: ~F.array_contains(gone, i)))
