"""The registered queries of this folder over the smallest tables."""

import pytest

from molquarry.llm import neighbours
from molquarry.llm.queries import QUERIES, SQL
from tests.compare import both

COLUMNS = {
    "p2_found": {"vec_id_a", "vec_id_b"},
    "p2_neighbours": {"vec_id", "field_name", "neighbour", "cosine"},
    "p3_subset": {"request_id", "field_name", "rank", "value"},
    "p4_found": {"row_id_a", "row_id_b"},
    "p4_report": {"split", "sheet_name", "records", "overlapping", "exact", "pairs"},
    "p4_coverage": {"row_id", "split", "sheet_name", "coverage", "copies"},
    "p5_found": {"entity_row_id"},
    "p5_linked": {"row_id", "first_row_id"},
    "p5_splits": {"row_id", "component", "assigned_split"},
    "p6_found": {"cluster_row_id", "row_id"},
    "p6_clusters": {"cluster_row_id", "size", "typical"},
    "p7_ids": {"doc_id", "ids"},
    "p8_containers": {"container_kind", "container_id", "doc_id", "piece", "piece_size"},
    "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert set(df.columns) == COLUMNS[name] and df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, name):
    left, right = both(spark, tiny, QUERIES[name], SQL[name])
    assert left == right


def test_every_vector_counts(spark, tiny):
    """Of these few vectors one in a hundred is asked by the query; here one in two is."""
    rows = QUERIES["p2_recall"](spark, tiny).collect()
    assert rows and all(r["recall"] >= 0.9 for r in rows)
    rows = neighbours.recall(spark.read.parquet(f"{tiny}/component_vectors.parquet"), every=2).collect()
    assert len(rows) == 3 and all(r["recall"] >= 0.9 for r in rows)


def test_containers_hold_every_text(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").count()
    kinds = spark.read.parquet(f"{tiny}/token_containers.parquet").count()
    assert QUERIES["p8_containers"](spark, tiny).select("container_kind", "doc_id").distinct().count() == docs * kinds
