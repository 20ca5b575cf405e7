"""Column encoders (ENC): native expressions, fit on the rows given, applied to any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import hash32, occurrences, unit_hash
from molquarry.operators.duplicates import constant_positions, value_domain, without_positions

#: a joint domain becomes a literal of the plan, so its size is checked
MAX_DOMAIN = 10_000


def domain(df: DataFrame, columns: list[str]) -> list[str]:
    found = sorted(r[0] for r in value_domain(df, columns).limit(MAX_DOMAIN + 1).collect())
    if len(found) > MAX_DOMAIN:
        raise ValueError(f"more than {MAX_DOMAIN} distinct values")
    return found


@dataclass(frozen=True)
class MultiHot:
    """One vector for several columns: 1 where a value of the joint domain stands in any of them."""

    columns: tuple[str, ...]
    values: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> MultiHot:
        return cls(tuple(columns), tuple(domain(df, columns)))

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        held = F.array(*(F.col(c).cast("string") for c in self.columns))
        every = F.array(*(F.lit(v) for v in self.values))
        code = F.transform(every, lambda v: F.coalesce(F.array_contains(held, v), F.lit(False)).cast("tinyint"))
        return df.withColumn(name or "onehot_" + "".join(self.columns), code).drop(*self.columns)


def random_vectors(df: DataFrame, columns: list[str], size: int = 32, low: float = -1.0, high: float = 1.0, seed: int = 42, prefix: str = "vec_") -> DataFrame:
    """Each value's own vector of uniform numbers, a pure function of (seed, value, place): no domain
    has to be gathered and equal values agree everywhere."""

    def vector(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lit(low) + F.lit(high - low) * unit_hash(F.lit(str(seed)), F.col(c), i))

    return df.withColumns({prefix + c: F.when(F.col(c).isNotNull(), vector(c)) for c in columns})


def pattern_counts(df: DataFrame, column: str, patterns: list[str], match: bool = False, name: str = "features") -> DataFrame:
    """How often (or whether) each literal occurs in the text."""
    counts = [occurrences(F.col(column), p) for p in patterns]
    return df.withColumn(name, F.array(*(F.least(c, F.lit(1)) if match else c for c in counts)))


def regex_counts(df: DataFrame, column: str, patterns: list[str], match: bool = False, name: str = "features") -> DataFrame:
    """How often (or whether) each regular expression matches the text; null texts count 0."""
    counts = [F.coalesce(F.regexp_count(F.col(column), F.lit(p)), F.lit(0)) for p in patterns]
    return df.withColumn(name, F.array(*(F.least(c, F.lit(1)) if match else c for c in counts)))


def looked_up(df: DataFrame, column: str, dictionary: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the value that a dictionary (unique key) has for a column, null where it has none. The
    dictionary is broadcast only where it is small enough by its count."""
    own = dictionary.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    small = own.limit(MAX_DOMAIN + 1).count() <= MAX_DOMAIN
    out = df.join(F.broadcast(own) if small else own, F.col(column) == F.col("_key"), "left")
    return out.withColumn(name, F.col("_value")).drop("_key", "_value")


def hashed_fingerprint(column: str, bits: int = 64, gram: int = 3) -> Column:
    """Bits of the hashed character n-grams of a text; null and shorter texts have none. The places are
    hashed once, sorted and laid out with runs of zeros between them: linear in n-grams and bits."""
    text = F.coalesce(F.col(column), F.lit(""))
    zero, one = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    grams = F.when(F.length(text) >= gram, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - gram + 1)), lambda i: (hash32(F.substr(text, i, F.lit(gram))) % bits).cast("int"))).otherwise(F.array().cast("array<int>"))
    places = F.array_sort(F.array_distinct(grams))

    def laid_out(p: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(p, i - 1))
        runs = F.transform(p, lambda at, i: F.concat(F.array_repeat(zero, at - before(i) - 1), F.array(one)))
        rest = F.lit(bits - 1) - F.coalesce(F.get(p, F.size(p) - 1), F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(zero, rest))

    # the lambda's variable holds the places, so that they are worked out once
    return F.get(F.transform(F.array(places), laid_out), F.lit(0))


# fixed values: atomic weights of the elements that line notations here use
WEIGHTS = {"B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.086, "P": 30.974, "S": 32.06, "Cl": 35.45, "Se": 78.971, "Br": 79.904, "I": 126.904}
#: element symbols of a line notation; two-letter ones outside brackets are Cl and Br alone
HEAVY_ATOM = r"(\[[0-9]*Si|\[[0-9]*Se|Cl|Br|[BCNOPSFI]|[bcnops])"


def heavy_atom_weight(column: str) -> Column:
    """The summed weight of the atoms of a line notation but hydrogen; null for null."""
    table = F.create_map(*(v for e, w in WEIGHTS.items() for v in (F.lit(e.lower()), F.lit(w))))
    atoms = F.regexp_extract_all(F.col(column), F.lit(HEAVY_ATOM), F.lit(1))
    return F.aggregate(atoms, F.lit(0.0), lambda total, a: total + F.coalesce(F.try_element_at(table, F.lower(F.regexp_replace(a, r"[\[0-9]", ""))), F.lit(0.0)))


@dataclass(frozen=True)
class ConstantDrop:
    """Takes out the vector positions that are constant in the rows it was fit on."""

    column: str
    positions: tuple[int, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> ConstantDrop:
        return cls(column, tuple(sorted(r[0] for r in constant_positions(df, column).collect())))

    def transform(self, df: DataFrame) -> DataFrame:
        return without_positions(df, self.column, list(self.positions))


class CentredPCA:
    """Principal components of a vector column, centred on the mean of the rows it was fit on."""

    def __init__(self, column: str, mean, model):
        self.column, self.mean, self.model = column, mean, model

    @classmethod
    def fit(cls, df: DataFrame, column: str, components: int = 32) -> CentredPCA:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        rows = df.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
        mean = rows.select(Summarizer.mean(F.col("v"))).first()[0]
        return cls(column, mean, PCA(k=components, inputCol="v", outputCol="p").fit(rows))

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        shift = F.array(*(F.lit(float(x)) for x in self.mean))
        centred = F.zip_with(F.col(self.column).cast("array<double>"), shift, lambda a, b: a - b)
        out = self.model.transform(df.withColumn("v", array_to_vector(centred)))
        return out.withColumn(name or self.column, vector_to_array("p")).drop("v", "p")


def rounded(column: str, places: int = 0) -> Column:
    """A descriptor as a whole number, or with its decimals kept."""
    value = F.round(F.col(column), places)
    return value.cast("int") if places == 0 else value


# fixed values: the widening order of numeric kinds
LEVELS = {"tinyint": 1, "smallint": 2, "int": 4, "float": 5, "bigint": 6, "double": 7}


def promoted(kinds: list[str]) -> str:
    """The kind of a matrix made of columns of these kinds."""
    return max(kinds, key=LEVELS.__getitem__)
