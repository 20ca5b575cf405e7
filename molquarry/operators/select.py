"""Projection, positional gather, filters, assembly and positional writes (PRJ, FLT, SNK1-3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import hash32, is_value
from molquarry.operators.positions import dense_positions, smallest
from molquarry.session import cut

#: positions beyond this number are joined instead of broadcast
BROADCAST_POSITIONS = 1_000_000
#: results of a kernel that take more are joined instead of broadcast
BROADCAST_BYTES = 64 << 20


def rows_between(df: DataFrame, start: int, end: int, row_id: str = "row_id") -> DataFrame:
    """Rows at the positions [start, end)."""
    return df.where((F.col(row_id) >= start) & (F.col(row_id) < end))


def gather(df: DataFrame, positions: list[int] | DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows at the given positions, each once."""
    if isinstance(positions, list):
        if len(positions) <= 1000:
            return df.where(F.col(row_id).isin(positions))
        wanted = df.sparkSession.createDataFrame([(p,) for p in positions], f"{row_id} bigint")
        if len(positions) <= BROADCAST_POSITIONS:
            wanted = F.broadcast(wanted)
        return df.join(wanted, row_id, "left_semi")
    return df.join(positions, row_id, "left_semi")


def inverse(df: DataFrame, positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows at all other positions."""
    return df.join(positions.select(row_id), row_id, "left_anti")


def valid_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor one of the strings that stand for a missing value."""
    return df.where(is_value(column))


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of least `order` for each key: a partial aggregate, no sort of a group."""
    rows = df.withColumn("_key", key)
    least = rows.groupBy("_key").agg(F.min(order).alias(order))
    return df.join(least.select(order), order, "left_semi")


def renumbered(df: DataFrame, keep: Column, order: list[str], name: str = "ID") -> DataFrame:
    """Rows that pass the predicate, with a dense new id in their order."""
    return dense_positions(df.where(keep), order, name)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) without replacement: those of the least seeded hash of the (unique, not
    null) key, found by a cut value, so that no task holds the sample."""
    hashed = hash32(F.lit(str(seed)), F.col(key))
    found = smallest(df, [hashed], key, n)[0]
    return df.where(found.inside(hashed, key)) if found else df.limit(0)


def feature_width(df: DataFrame, columns: list[str]) -> DataFrame:
    """(width): the length of the assembled row; a scalar counts 1, a vector its length."""
    kinds = dict(df.dtypes)
    parts = [F.max(F.size(c)) if kinds[c].startswith("array") else F.lit(1) for c in columns]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.agg(total.cast("bigint").alias("width"))


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Scalars and vectors joined in order into one array<double>; text raises."""
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        if "string" in kinds[c]:
            raise ValueError(f"{c} holds text and can't be assembled")
        parts.append(F.col(c).cast("array<double>") if kinds[c].startswith("array") else F.array(F.col(c).cast("double")))
    return df.withColumn(name, F.concat(*parts))


def overwrite_rows(df: DataFrame, updates: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """df with the columns of updates in its rows of the same position; schema and rows stay."""
    new = updates.select(row_id, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = df.join(new, row_id, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out.select(df.columns)


def map_chunks(df: DataFrame, function: Callable, schema=None) -> DataFrame:
    """Arrow-batched map over pandas chunks; with a schema it may change the columns."""

    def run(chunks):
        for chunk in chunks:
            yield function(chunk)

    return df.mapInPandas(run, schema or df.schema)


def encode_distinct(df: DataFrame, column: str, function: Callable, kind: str, name: str) -> DataFrame:
    """df with an expensive kernel's result, computed once for each distinct value."""
    values = cut(df.select(column).where(F.col(column).isNotNull()).distinct())

    def run(chunks):
        for chunk in chunks:
            yield chunk.assign(**{name: [function(v) for v in chunk[column]]})

    coded = cut(values.mapInPandas(run, f"{column} {df.schema[column].dataType.simpleString()}, {name} {kind}"))
    size = F.octet_length(F.col(column).cast("string")) + (F.octet_length(F.col(name)) if kind == "string" else 8 * F.size(name) if kind.startswith("array") else F.lit(8))
    held = coded.agg(F.sum(F.coalesce(size, F.lit(0)) + 32)).first()[0] or 0
    return df.join(F.broadcast(coded) if held <= BROADCAST_BYTES else coded, column, "left")
