"""Scalar expressions: missing values, seeded hashes, text and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the strings that stand for a missing value
SENTINELS = ("NA", "nan", "ValueNotFound")
#: in reaction data an empty value is missing, too
MISSING = ("", *SENTINELS)


def is_value(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*SENTINELS)


def null_sentinels(column: str) -> Column:
    """null for the strings that stand for a missing value."""
    return F.when(is_value(column), F.col(column))


def hash32(*parts: Column) -> Column:
    """A number in [0, 2^32) that depends on the texts of the parts alone (the first eight digits of
    their md5), so other engines can repeat it."""
    text = F.concat_ws("-", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts: Column) -> Column:
    return hash32(*parts) / F.lit(4294967296.0)


def padded(array: Column, length: int, fill: Column) -> Column:
    """The first `length` entries, filled up at the end."""
    return F.slice(F.concat(array, F.array_repeat(fill, length)), 1, length)


def nonzero_indices(vector: Column, offset: int = 0, none: int = -1) -> Column:
    """0-based places of the non-zero entries plus offset, filled up with `none` to the vector's length."""
    places = F.filter(F.transform(vector, lambda x, i: F.when(x != 0, i + offset)), lambda x: x.isNotNull())
    return F.slice(F.concat(places, F.array_repeat(F.lit(none), F.size(vector))), F.lit(1), F.size(vector))


def occurrences(text: Column, pattern: str) -> Column:
    """How often a literal occurs, without overlaps; null texts count 0."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return F.coalesce((gone / len(pattern)).cast("int"), F.lit(0))


def signed_square(x: Column) -> Column:
    return F.signum(x) * x * x


def genome_id(genes: Column) -> Column:
    """md5 of the genes joined in descending order."""
    return F.md5(F.array_join(F.sort_array(genes, asc=False), ""))


def reaction_string(reactants: list[str], reagents: list[str], products: list[str]) -> Column:
    """a.b>c.d>e.f; null parts are left out."""
    return F.concat(F.concat_ws(".", *reactants), F.lit(">"), F.concat_ws(".", *reagents), F.lit(">"), F.concat_ws(".", *products))
