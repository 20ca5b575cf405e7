"""Splits that keep related records together, and records that stand in several splits (p4, p5).

Records are compared by the classes of their values (compounds.py). A null, missing or blank value
belongs to no class, and a null split name is no split; such records still get a split of their own
in assign_splits, by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm import compounds
from molquarry.llm.components import components
from molquarry.session import cut

#: parts of a hash that the shares of the splits are ranges of
RANGE = 1 << 30


def split_name(column: str) -> Column:
    return F.lower(F.btrim(F.col(column), F.lit(" \t")))


def classed(df: DataFrame, fields: list[str], keep: list[str | Column], key: str) -> DataFrame:
    """The columns keep and key with <field>_class of each field, over all values."""
    classes = compounds.compound_classes(df, fields)
    rows = compounds.with_ids(df, fields, [key, *keep])
    return compounds.with_classes(rows, classes, fields, key).drop(*(f"{f}_id" for f in fields))


#: the classes of a record as two numbers, and its values
SAME, EXACT = ["same", "same_too"], ["exact", "exact_too"]


def pair_of_hashes(columns: list[str], names: list[str]) -> list[Column]:
    """128 bits that stand for the columns where rows meet."""
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(1), *columns).alias(names[1])]


def overlap_rows(df: DataFrame, fields: list[str], keep: list[str | Column], key: str, split: str, train: str, held: tuple[str, ...], measured: bool = False) -> DataFrame:
    """key, keep, `split`, SAME (of the classes), EXACT (of the values) and, where measured, `coverage` of the
    training and held-out records whose fields are all present and whose values all have the class of a held-out
    value: no other training record can overlap. coverage (null for training records) is the
    share of a record's characters in passages that training values hold too."""
    name = split_name(split)
    classes = compounds.asked_classes(df, fields, name.isin(*held), name == train)
    # a missing value finds no class
    rows = compounds.with_ids(df.where(name.isin(train, *held)), fields, [key, *keep, name.alias("split")])
    rows = compounds.with_classes(rows, classes, fields, key, ("class", "size", "covered") if measured else ("class",), "inner")
    total = lambda c: sum((F.col(f"{f}_{c}") for f in fields), F.lit(0))
    coverage = [F.when(F.col("split") != train, total("covered") / total("size")).alias("coverage")] if measured else []
    names = [key, *(c for c in rows.columns if c != key and not any(c.startswith(f"{f}_") for f in fields))]
    return rows.select(*names, *coverage, *pair_of_hashes([f"{f}_class" for f in fields], SAME), *pair_of_hashes([f"{f}_id" for f in fields], EXACT))


def cross_split_pairs(df: DataFrame, fields: list[str], key: str = "row_id", split: str = "split_name", train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """(key_a, key_b), smaller first: a training and a held-out record of the same classes. The pairs of a
    class that many records share are the asked result; adaptive execution splits their join."""
    rows = cut(overlap_rows(df, fields, [], key, split, train, held).select(key, (F.col("split") == train).alias("learned"), *SAME))
    learned = rows.where("learned").select(F.col(key).alias("x"), *SAME)
    tested = rows.where("NOT learned").select(F.col(key).alias("y"), *SAME)
    met = learned.join(tested, SAME)
    return met.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def overlap_report(df: DataFrame, fields: list[str], source: str = "sheet_name", key: str = "row_id", split: str = "split_name", train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """(split, source, records, overlapping, exact, pairs) for each held-out split and source: records
    that overlap with training, those of them that do so in equal spelling, and the pairs. Counts by
    spelling and class meet, never pairs."""
    rows = overlap_rows(df, fields, [F.col(source).alias("source")], key, split, train, held)
    both = [*SAME, *EXACT]
    counted = cut(rows.groupBy(*both, "split", "source").agg(F.count("*").alias("m")))
    spelled = counted.where(F.col("split") == train).groupBy(*both).agg(F.sum("m").alias("n"))
    learned = spelled.groupBy(*SAME).agg(F.sum("n").alias("n"))
    tested = counted.where(F.col("split") != train)
    met = tested.join(spelled.select(*both, F.lit(True).alias("hit")), both, "left").join(learned, SAME, "left")
    return met.groupBy("split", F.col("source").alias(source)).agg(
        F.sum("m").alias("records"),
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("overlapping"),
        F.sum(F.when(F.col("hit"), F.col("m")).otherwise(0)).alias("exact"),
        F.sum(F.coalesce("n", F.lit(0)) * F.col("m")).alias("pairs"),
    )


def overlap_coverage(df: DataFrame, fields: list[str], source: str = "sheet_name", key: str = "row_id", split: str = "split_name", train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """(key, split, source, coverage, copies): every held-out record whose fields are all present, the share
    of its characters in passages that training values hold, and how many training records are the same."""
    rows = overlap_rows(df, fields, [F.col(source).alias("source")], key, split, train, held, measured=True)
    learned = rows.where(F.col("split") == train).groupBy(*SAME).agg(F.count("*").alias("copies"))
    tested = rows.where(F.col("split") != train).select(key, "split", F.col("source").alias(source), "coverage", *SAME)
    return compounds.salted_join(tested, learned, SAME, key, "left").select(key, "split", source, "coverage", F.coalesce("copies", F.lit(0)).alias("copies"))


def entity(fields: list[str]) -> Column:
    """One number for the classes of a record, null where one is missing."""
    return F.when(F.expr(" AND ".join(f"{f}_class IS NOT NULL" for f in fields)), F.xxhash64(*(f"{f}_class" for f in fields)))


def torn_entities(df: DataFrame, fields: list[str], key: str = "row_id", split: str = "split_name") -> DataFrame:
    """(entity_<key>): entities (records of one class in every field) that stand in two or more splits."""
    rows = classed(df, fields, [split_name(split).alias("split")], key)
    named = rows.select(key, "split", entity(fields).alias("entity")).where("split IS NOT NULL AND entity IS NOT NULL")
    linked = linked_records(named, key, ["entity"], keep=["split"])
    # hashes of the names: the least of a text would need a sort
    found = linked.groupBy("component").agg(F.min(F.xxhash64("split")).alias("low"), F.max(F.xxhash64("split")).alias("high"), F.min(key).alias(f"entity_{key}"))
    return found.where("low <> high").select(f"entity_{key}")


def ranges(targets: list[tuple[str, float]]) -> list[tuple[str, int]]:
    """(split, end of its range) in the order of names; shares are scaled to a sum of 1."""
    wanted = sorted((n, float(s)) for n, s in targets if n is not None and s is not None and s > 0)
    if not wanted:
        raise ValueError("no split has a positive share")
    total, at, out = sum(s for _, s in wanted), 0.0, []
    for name, share in wanted:
        at += share / total
        out.append((name, round(at * RANGE)))
    out[-1] = (out[-1][0], RANGE)
    return out


def split_of(component: Column, targets: list[tuple[str, float]], seed: int = 42) -> Column:
    place = F.pmod(F.xxhash64(component, F.lit(seed)), F.lit(RANGE))
    out = F.lit(None).cast("string")
    for name, end in reversed(ranges(targets)):
        out = F.when(place < end, F.lit(name)).otherwise(out)
    return out


def linked_records(df: DataFrame, key: str, entities: list[str], keep: list[str] | None = None) -> DataFrame:
    """(key, keep, component): records joined by any shared entity. The records of an entity are
    aggregated first: a record links its entities to one another, star rounds run over the entities,
    and a record follows its first one. Records without an entity are their own component."""
    names = [F.when(F.col(e).isNotNull(), F.xxhash64(F.lit(e), F.col(e))) for e in entities]
    alone = F.xxhash64(F.lit("\0record"), F.col(key))
    held = df.select(key, *(keep or []), F.filter(F.array(*names), lambda x: x.isNotNull()).alias("_e"))
    links = held.select(F.explode(F.transform("_e", lambda x: F.struct(F.element_at(F.col("_e"), 1).alias("a"), x.alias("b")))).alias("x")).select("x.a", "x.b").distinct()
    found = cut(components(links).select(F.col("node").alias("_node"), "component"))
    first = held.select(key, *(keep or []), F.get("_e", F.lit(0)).alias("_node"))
    out = compounds.checked_join(first, found, ["_node"], key, "left")
    return out.select(key, *(keep or []), F.coalesce("component", alone).alias("component"))


def linked_firsts(df: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """(key, first_<key>): the smallest key of each record's component."""
    linked = cut(linked_records(df, key, entities))
    firsts = linked.groupBy("component").agg(F.min(key).alias(f"first_{key}"))
    return compounds.salted_join(linked, firsts, ["component"], key).select(key, f"first_{key}")


def assign_splits(df: DataFrame, fields: list[str], targets: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """(key, component, assigned_split): records of one entity (one class in every field) share a
    split, dealt by a hash in the shares of targets (split_name, target_share)."""
    wanted = [(r[0], r[1]) for r in targets.select("split_name", "target_share").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 splits")
    rows = classed(df, fields, [], key)
    linked = linked_records(rows.select(key, entity(fields).alias("entity")), key, ["entity"])
    return linked.withColumn("assigned_split", split_of(F.col("component"), wanted, seed))
