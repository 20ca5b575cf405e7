"""Named queries of the operators in this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm import clusters, compounds, neighbours, oracle, packing, quality, splits, subset, tokens
from molquarry.session import read_table

SQL = oracle.SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual_pairs(read_table(spark, sf_dir, "component_vectors"))


@query
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(read_table(spark, sf_dir, "component_vectors"))


@query
def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.recall(read_table(spark, sf_dir, "component_vectors"))


@query
def p3_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.select_varied(read_table(spark, sf_dir, "dreher_dataset"), read_table(spark, sf_dir, "subset_requests"), ["additive", "aryl_halide"])


REACTION = ["ligand", "additive", "base", "aryl_halide"]
ENTITY = ["ligand", "additive"]


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cross_split_pairs(read_table(spark, sf_dir, "dreher_dataset"), REACTION)


@query
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlap_report(read_table(spark, sf_dir, "dreher_dataset"), REACTION)


@query
def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlap_coverage(read_table(spark, sf_dir, "dreher_dataset"), REACTION)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_entities(read_table(spark, sf_dir, "dreher_dataset"), ENTITY)


@query
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(read_table(spark, sf_dir, "dreher_dataset"), ENTITY, read_table(spark, sf_dir, "split_targets"))


@query
def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a ligand-additive or an additive-halide entity, in equal spelling, and the first
    record of each such component."""
    rows = read_table(spark, sf_dir, "dreher_dataset")
    pair = lambda a, b: F.concat(compounds.normalised(a), F.lit("|"), compounds.normalised(b))
    named = rows.select("row_id", pair("ligand", "additive").alias("entity"), pair("additive", "aryl_halide").alias("other"))
    return splits.linked_firsts(named, "row_id", ["entity", "other"])


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_members(read_table(spark, sf_dir, "dreher_dataset"), ENTITY)


@query
def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_table(read_table(spark, sf_dir, "dreher_dataset"), ENTITY)


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(read_table(spark, sf_dir, "documents"))


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate clusters are texts equal but for case and white space."""
    folded = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64(folded).alias("cluster"), "text")
    counted = tokens.count_tokens(docs, keep=("doc_id", "source", "cluster"))
    return packing.containers(counted, read_table(spark, sf_dir, "token_containers"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words")).where("is_case").select("doc_id")


@query
def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.quality_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))
    return rated.withColumn("signs", F.array_join("signs", ","))
