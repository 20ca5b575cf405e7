"""Shards, blocks and contraction of clusters (p6), passage scans and coverage (p4) against plain versions."""

import random
import string

import numpy as np
from pyspark.sql import functions as F

from molquarry.llm import clusters, compounds, splits
from tests.llm import reference as ref
from tests.llm.test_reactions import FIELDS, SCHEMA, dicts, reactions


def families(sizes=(20, 9, 3, 1, 1), seed=4):
    r = random.Random(seed)
    out = set()
    for n in sizes:
        base = "".join(r.choice(string.ascii_letters) for _ in range(30))
        while n:
            text = list(base)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 3)] = r.choice(["", "1", "22", "(C)"])
            text = "".join(text)
            n -= text not in out
            out.add(text)
    return sorted(out)


def chain(parts=4, seed=9):
    """Dense families of which each has one member that borders on the next."""
    r = random.Random(seed)
    bases = ["".join(r.choice(string.ascii_letters) for _ in range(24)) for _ in range(parts)]
    out = [b[:at] + str(k) + b[at:] for b in bases for k, at in enumerate((4, 9, 14, 19))]
    return sorted(out + [a[:18] + b[:18] for a, b in zip(bases, bases[1:])])


def table(spark, texts):
    return spark.createDataFrame([(i, t, "CCCC", "C", "C", "train", "A", "", "", "") for i, t in enumerate(texts)], SCHEMA)


def same_partition(got, want):
    pairs = {}
    for v, c in got.items():
        assert pairs.setdefault(want[v], c) == c
    return len(set(pairs.values())) == len(pairs)


def test_many_shards_and_levels(spark):
    texts = families() + chain() + ["ab", "xy", "c"]
    want = ref.classes(set(texts), ref.alike)
    values = compounds.distinct_values(table(spark, texts), ["ligand", "additive"])
    for shard_values, block_values in ((2_000, 2_000), (7, 2_000)):
        found = clusters.similarity_clusters(values, shard_values, block_values).where("field = 'ligand'").collect()
        assert len(found) == len(set(texts))
        assert same_partition({r["value"]: r["class"] for r in found}, want)


def test_markov_parts_what_links_connect(spark):
    """The first clustering gives more clusters than there are connected parts, as plain Markov clustering
    does; the contractions bring them together. Without Markov clustering its labels would differ."""
    texts = chain()
    want = ref.classes(set(texts), ref.alike)
    assert len(set(want.values())) == 1
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if ref.alike(texts[i], texts[j])]
    sets = [{t[k : k + 3] for k in range(len(t) - 2)} for t in texts]
    w = np.eye(len(texts))
    for i, j in pairs:
        w[i, j] = w[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    w /= w.sum(axis=0)
    for _ in range(60):
        w = (w @ w) ** 2
        w /= w.sum(axis=0)
    plain = dict(zip(texts, np.round(w, 6).argmax(axis=0).tolist()))
    values = compounds.distinct_values(table(spark, texts), ["ligand"])
    found = clusters.similarity_clusters(values).collect()
    labels = {r["value"]: r["label"] for r in found}
    assert len(set(labels.values())) > 1 and same_partition(labels, plain)
    assert len({r["class"] for r in found}) == 1
    assert {r["id"] for r in found} >= set(labels.values())  # attractors are values


def test_links_beyond_one_task(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (7, 8, 0.01)]
    links = spark.createDataFrame(edges, "a bigint, b bigint, likeness double")
    want = ref.classes({v for a, b, _ in edges for v in (a, b)}, lambda a, b: any({a, b} == {x, y} for x, y, _ in edges))
    for limit in (2_000, 2):
        assert same_partition({x["node"]: x["label"] for x in clusters.contract(links, limit).collect()}, want)
    nodes, label = clusters.contracted(np.array([1, 2]), np.array([2, 3]), np.array([1e-4, 1e-4]))
    assert len(set(label.tolist())) == 1  # links that Markov clustering parts are still links


def test_open_values_miss_none(spark):
    """Every similar pair of two clusters is found whatever the blocks; unions of one cluster each."""
    texts = families() + chain()
    values = compounds.distinct_values(table(spark, texts), ["ligand"])
    own = values.select("field", "id", "value", F.col("id").alias("label"))
    of = {r["id"]: r["value"] for r in values.collect()}
    sets = {i: {v[k : k + 3] for k in range(len(v) - 2)} for i, v in of.items()}
    code = lambda g: (ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2])
    unions = spark.createDataFrame([("ligand", i, sorted(map(code, s)), len(s)) for i, s in sets.items()], "field string, label bigint, grams array<bigint>, least int")
    want = {(min(a, b), max(a, b)) for a in of for b in of if a != b and ref.alike(of[a], of[b])}
    for shard_values, grams, meet in ((2_000, 2_000_000, 4_000), (20, 700, 1)):
        opened = clusters.cut(clusters.open_values(own, unions, shard_values, grams))
        got = [(r["a"], r["b"]) for r in clusters.links_between(opened, meet).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_flows_of_large_clusters(spark):
    texts = families()
    values = compounds.distinct_values(table(spark, texts), ["ligand"])
    found = clusters.similarity_clusters(values)
    small = {r["i"]: r["flow"] for r in clusters.flows(found).collect()}
    large = {r["i"]: r["flow"] for r in clusters.flows(found, block_values=5).collect()}
    assert small.keys() == large.keys() and all(abs(small[i] - large[i]) < 1e-6 for i in small)


def test_scans_in_blocks(spark, monkeypatch):
    """Few passages a shard, and blocks of hot shards, give the classes of one shard."""
    monkeypatch.setattr(compounds, "TEXT_ROWS", 3)
    rows = reactions(120, 6)
    values = compounds.distinct_values(spark.createDataFrame(rows, SCHEMA), ["ligand"])
    of = {r["id"]: r["value"] for r in values.collect()}
    want = ref.classes(set(of.values()), ref.near)
    for shard_values in (2, 50):
        got = {r["node"]: r["component"] for r in compounds.components(compounds.value_links(values, shard_values=shard_values)).collect()}
        assert same_partition({v: got.get(i, i) for i, v in of.items()}, want)


def test_asked_classes_reach_through_others(spark):
    """Held-out and training spellings that only spellings of no split connect, over several scans."""
    steps = ["C" * 20 + "N" * k for k in range(0, 25, 4)]
    rows = [(i, t, "C", "C", "C", "test" if i == 0 else "train" if i == len(steps) - 1 else None, "A", "", "", "") for i, t in enumerate(steps)]
    rows += [(90, "S" * 30, "C", "C", "C", "train", "A", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in splits.cross_split_pairs(df, FIELDS).collect()] == [(0, len(steps) - 1)]


def test_coverage(spark):
    rows = reactions(200, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    rows = dicts(rows)
    held = [r for r in rows if ref.split(r["split_name"]) in ("valid", "test") and all(ref.value(r[f]) for f in FIELDS)]
    known = {f: {ref.value(r[f]) for r in rows if ref.split(r["split_name"]) == "train"} - {None} for f in FIELDS}
    keys = ref.classed(rows, FIELDS, ref.near)
    learned = [k for r, k in zip(rows, keys) if k and ref.split(r["split_name"]) == "train"]

    def covered(f, v):
        if v in known[f]:
            return len(v)
        edges, n = compounds.passages(len(v)).tolist(), 0
        for i in range(5):
            part = v[edges[i] : edges[i + 1]]
            fits = lambda t, at: abs(len(t) - len(v)) <= 4 and abs(at - edges[i]) <= i and abs(len(t) - len(v) - at + edges[i]) <= 4 - i  # noqa: B023, E731
            if len(v) > 4 and any(t.startswith(part, at) and fits(t, at) for t in known[f] for at in range(len(t))):
                n += len(part)
        return n

    got = {r["row_id"]: r for r in splits.overlap_coverage(df, FIELDS).collect()}
    assert set(got) == {r["row_id"] for r in held} and held
    at = {r["row_id"]: k for r, k in zip(rows, keys)}
    for r in held:
        want = sum(covered(f, ref.value(r[f])) for f in FIELDS) / sum(len(ref.value(r[f])) for f in FIELDS)
        assert abs(got[r["row_id"]]["coverage"] - want) < 1e-9
        assert got[r["row_id"]]["copies"] == sum(k == at[r["row_id"]] for k in learned)


def test_salted_join(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    one = spark.createDataFrame([(7, "hot"), (8, "cold")], "k bigint, name string")
    got = {r["id"]: r["name"] for r in compounds.salted_join(rows, one, ["k"], "id", "left").collect()}
    assert len(got) == 1000 and got[3] == "hot" and got[8] == "cold" and got[7] == "hot" and got[10] is None


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    """Salted joins give what broadcasts give."""
    df = spark.createDataFrame(reactions(80, 3), SCHEMA)
    ask = {
        "pairs": lambda: splits.cross_split_pairs(df, FIELDS),
        "torn": lambda: splits.torn_entities(df, FIELDS[:2]),
        "members": lambda: clusters.cluster_members(df, FIELDS[:2]),
    }
    want = {n: sorted(map(tuple, f().collect())) for n, f in ask.items()}
    monkeypatch.setattr(compounds, "BROADCAST_ROWS", -1)
    for name, f in ask.items():
        assert sorted(map(tuple, f().collect())) == want[name] and want[name]
