"""Overlaps, entity splits and clusters (p4, p5, p6) against plain versions."""

import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.llm import clusters, compounds, components, editing, splits
from tests.llm import reference as ref

FIELDS = ["ligand", "additive", "base", "aryl_halide"]
SCHEMA = "row_id bigint, ligand string, additive string, base string, aryl_halide string, split_name string, sheet_name string, id string, value string, same string"


def reactions(n=400, seed=1):
    """Few compounds in families, respelled, with every kind of missing value; extra columns whose
    names the operators use themselves."""
    r = random.Random(seed)

    def compound():
        return "".join(r.choice(["C", "N", "O", "c1", "(C)", "=O", "[nH]", "Cl"]) for _ in range(r.randint(5, 22)))

    def respell(v):
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            at = r.randrange(len(v) + 1)
            v = v[:at] + r.choice(["", "C", "(", "x"]) + v[at + r.choice([0, 1]) :]
        return r.choice(["", " ", "\t"]) + v + r.choice(["", " "])

    pools = []
    for size in (6, 10, 3, 8):
        cores = [compound() for _ in range(size)]
        pools.append(cores + [c + compound()[:8] for c in cores[: size // 2]] + ["C", "CO", "NCC", "Brc1ccc1"])
    out = []
    for i in range(n):
        values = [respell(r.choice(p)) if r.random() > 0.04 else r.choice([None, "", "NA", "nan", " ", "ValueNotFound"]) for p in pools]
        out.append((i, *values, r.choice(["train", "TRAIN ", "valid", " Test", "test", None, "train", "other"]), r.choice("AB"), "x", "y", "z"))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = reactions()
    return rows, spark.createDataFrame(rows, SCHEMA)


def dicts(rows):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]


def test_pairs_match_brute_force(table):
    rows, df = table
    rows = dicts(rows)
    keys = ref.classed(rows, FIELDS, ref.near)
    want = set()
    for a, ka in zip(rows, keys):
        for b, kb in zip(rows, keys):
            if ka and ka == kb and ref.split(a["split_name"]) == "train" and ref.split(b["split_name"]) in ("valid", "test"):
                want.add((min(a["row_id"], b["row_id"]), max(a["row_id"], b["row_id"])))
    got = [tuple(r) for r in splits.cross_split_pairs(df, FIELDS).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = splits.overlap_report(df, FIELDS).collect()
    assert sum(r["pairs"] for r in report) == len(want)
    learned = [(k, tuple(ref.value(r[f]) for f in FIELDS)) for r, k in zip(rows, keys) if k and ref.split(r["split_name"]) == "train"]
    held = [(k, tuple(ref.value(r[f]) for f in FIELDS)) for r, k in zip(rows, keys) if k and ref.split(r["split_name"]) in ("valid", "test")]
    assert sum(r["records"] for r in report) == len(held)
    assert sum(r["overlapping"] for r in report) == sum(k in {x for x, _ in learned} for k, _ in held)
    assert sum(r["exact"] for r in report) == sum(v in {x for _, x in learned} for _, v in held)


def test_two_field_overlaps_are_many(table):
    rows, df = table
    rows = dicts(rows)
    keys = ref.classed(rows, ["ligand", "additive"], ref.near)
    held = defaultdict(set)
    first = {}
    for r, k in zip(rows, keys):
        s = ref.split(r["split_name"])
        if k and s:
            held[k].add(s)
            first[k] = min(first.get(k, r["row_id"]), r["row_id"])
    want = {first[k] for k, s in held.items() if len(s) > 1}
    got = [r[0] for r in splits.torn_entities(df, ["ligand", "additive"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_assigned_splits_keep_entities_and_shares(table, spark):
    rows, df = table
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)], "split_name string, target_share double")
    out = {r["row_id"]: r for r in splits.assign_splits(df, ["ligand", "additive"], targets).collect()}
    assert len(out) == len(rows)
    keys = ref.classed(dicts(rows), ["ligand", "additive"], ref.near)
    seen = {}
    for r, k in zip(rows, keys):
        if k:
            assert seen.setdefault(k, out[r[0]]["assigned_split"]) == out[r[0]]["assigned_split"]
    lone = spark.range(20_000).select(F.col("id").alias("c"))
    share = {r[0]: r[1] / 20_000 for r in lone.groupBy(splits.split_of(F.col("c"), [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).alias("s")).count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_records_linked_by_any_entity(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", None), (4, None, None), (5, "c", "y"), (6, None, "y"), (7, None, None)], "k int, e string, f string")
    out = {r["k"]: r["component"] for r in splits.linked_records(df, "k", ["e", "f"]).collect()}
    assert out[1] == out[2] == out[3] and out[5] == out[6]
    assert len({out[k] for k in (1, 4, 5, 7)}) == 4


def test_clusters_match_brute_force(table):
    rows, df = table
    keys = ref.classed(dicts(rows), ["ligand", "additive"], ref.alike)
    members = defaultdict(list)
    for r, k in zip(rows, keys):
        if k:
            members[k].append(r[0])
    want = {(min(m), i) for m in members.values() if len(m) > 1 for i in m}
    got = [tuple(r) for r in clusters.cluster_members(df, ["ligand", "additive"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    table = clusters.cluster_table(df, ["ligand", "additive"]).collect()
    assert {(r[0], r[1]) for r in table} == {(min(m), len(m)) for m in members.values()}
    for r in table:
        mine = next(m for m in members.values() if min(m) == r[0])
        assert len(r["typical"]) == min(3, len(mine)) and set(r["typical"]) <= set(mine)


def test_shards_meet(spark, monkeypatch):
    """Many small shards give the classes of one."""
    rows = reactions(150, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    values = compounds.distinct_values(df, ["ligand", "additive"])
    of = {r["id"]: (r["field"], r["value"]) for r in values.collect()}
    for linked, links in ((ref.near, compounds.value_links(values, shard_values=7)), (ref.alike, clusters.similarity_links(values, shard_values=7).where("forest"))):
        got = {r["node"]: r["component"] for r in components.components(links.select("a", "b")).collect()}
        for field in ("ligand", "additive"):
            want = ref.classes({v for f, v in of.values() if f == field}, linked)
            pairs = {}
            for i, (f, v) in of.items():
                if f == field:
                    assert pairs.setdefault(want[v], got.get(i, i)) == got.get(i, i)
            assert len(set(pairs.values())) == len(pairs)


def test_short_values_only(spark):
    """More short values than a block holds, and a few longer ones within reach of them."""
    texts = ["".join(t) for t in {("C", "N"), ("C",), ("N", "O"), ("O", "O", "C"), ("S",), ("P", "P", "P", "P")}] + ["CNOSPFI", "CCCCCCCCC", "PPPPPPPP"]
    rows = [(i, t, "C", "C", "C", "train", "A", "", "", "") for i, t in enumerate(texts)]
    values = compounds.distinct_values(spark.createDataFrame(rows, SCHEMA), ["ligand"])
    of = {r["id"]: r["value"] for r in values.collect()}
    got = {r["node"]: r["component"] for r in components.components(compounds.value_links(values, shard_values=2)).collect()}
    want = ref.classes(set(of.values()), ref.near)
    groups = {}
    for i, v in of.items():
        groups.setdefault(want[v], set()).add(got.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_hub_columns_are_bounded(spark):
    """A node that is everyone's strongest neighbour keeps a bounded column, and links still connect."""
    graph = spark.createDataFrame([(0, i, 0.5) for i in range(1, 200)], "a bigint, b bigint, likeness double")
    limit = clusters.markov(graph).collect()
    assert len(limit) == 200 and all(0 < len(r["i"]) <= 50 and abs(sum(r["w"]) - 1) < 1e-9 for r in limit)


def test_typical_matches_brute_force(spark):
    """Families of up to 80 similar values, dealt to one and to several shards: the flow of every value
    is that of the plain matrix of all similar pairs, and so are the most typical records."""
    r = random.Random(3)
    texts = set()
    for n in (80, 30, 9, 2):
        base = "".join(r.choice(string.ascii_letters) for _ in range(24))
        while n:
            at, more = r.randrange(24), r.randint(1, 6)
            text = base[:at] + "".join(r.choice(string.digits) for _ in range(more)) + base[at + r.randint(0, 5) :]
            n -= text not in texts
            texts.add(text)
    texts = sorted(texts)
    rows = [(i, t, "CCCC", "C", "C", "train", "A", "", "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = ref.markov_flow(texts)
    values = compounds.distinct_values(df, ["ligand"])
    of = {x["id"]: x["value"] for x in values.collect()}
    for shard_values, block_values in ((4_000, 2_000), (40, 2_000), (40, 20)):
        pairs = clusters.similarity_links(values, shard_values).where("not forest").select("a", "b", "likeness")
        flow = defaultdict(float)
        for x in clusters.markov(pairs, block_values=block_values).collect():
            for i, w in zip(x["i"], x["w"]):
                flow[of[i]] += w
        assert all(abs(flow[t] - want[t]) < 1e-6 for t in texts)
    classes = ref.classes(set(texts), ref.alike)
    table = {x["cluster_row_id"]: x["typical"] for x in clusters.cluster_table(df, ["ligand", "additive"]).collect()}
    for name in set(classes.values()):
        mine = [i for i, t in enumerate(texts) if classes[t] == name]
        assert table[min(mine)] == sorted(mine, key=lambda i: (-round(want[texts[i]], 9), i))[:3]


def test_markov_settles_or_raises(spark):
    """Columns whose rows stay the same while their entries still move aren't settled."""
    ends = ([0, 0, 1, 2, 2, 3], [1, 2, 2, 3, 4, 4], [0.5, 0.5, 0.5, 0.35, 0.5, 0.500001])
    graph = spark.createDataFrame(list(zip(*ends)), "a bigint, b bigint, likeness double")
    nodes, w = clusters.settled(*(np.array(x) for x in ends))
    again = (w @ w) ** clusters.INFLATION
    assert np.allclose(again / again.sum(axis=0), w, atol=1e-8)
    with pytest.raises(RuntimeError):
        clusters.settled(*(np.array(x) for x in ends), rounds=2)
    with pytest.raises(RuntimeError):
        clusters.settled_by_joins(graph, rounds=1)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert splits.cross_split_pairs(none, FIELDS).count() == 0
    assert splits.torn_entities(none, ["ligand", "additive"]).count() == 0
    assert clusters.cluster_members(none, ["ligand", "additive"]).count() == 0
    blank = spark.createDataFrame([(1, None, "NA", " ", "nan", None, None, "", "", "")], SCHEMA)
    assert splits.cross_split_pairs(blank, FIELDS).count() == 0
    assert clusters.cluster_table(blank, ["ligand", "additive"]).count() == 0


def test_long_values(spark):
    long = "CNOP" * 3000
    rows = [(1, long, "C", "C", "C", "train", "A", "", "", ""), (2, long[:500] + "xx" + long[502:], "CC", "C", "C", "test", "A", "", "", ""), (3, long + "NNNNN", "C", "C", "C", "test", "A", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in splits.cross_split_pairs(df, FIELDS).collect()] == [(1, 2)]


def test_edit_distance():
    r = random.Random(3)
    a = ["".join(r.choice("ab c") for _ in range(r.randint(0, 14))) for _ in range(1500)]
    b = ["".join(c if r.random() < 0.8 else r.choice("abz") for c in x)[r.randint(0, 2) :] for x in a]
    for limit in (0, 1, 4):
        assert [bool(x) for x in editing.within(a, b, limit)] == [ref.edit_distance(x, y) <= limit for x, y in zip(a, b)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, None), (5, 5), (2000, 2000)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {n: n for e in edges if None not in e for n in e}
    for _ in range(2000):
        changed = False
        for x, y in edges:
            if y is not None and parent[x] != parent[y]:
                parent[x] = parent[y] = min(parent[x], parent[y])
                changed = True
        if not changed:
            break
    assert got == parent
