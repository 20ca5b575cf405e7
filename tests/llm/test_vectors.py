"""Neighbours (p2) and varied subsets (p3)."""

import random

import numpy as np
import pytest

from molquarry.llm import neighbours, subset


def exact(keys, fields, x, k):
    out = {}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(len(keys)):
        same = [j for j in range(len(keys)) if j != i and fields[j] == fields[i]]
        cosine = {j: 1.0 if (x[i] == x[j]).all() else float(unit[i] @ unit[j]) for j in same}
        out[keys[i]] = [(keys[j], cosine[j]) for j in sorted(same, key=lambda j: (-cosine[j], keys[j]))[:k]]
    return out


def vectors(n=300, width=8, seed=1):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(12, width))
    x = (centres[random_.integers(0, 12, n)] + 0.15 * random_.normal(size=(n, width))).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are copies of one
    x[n // 3 : n // 3 + 3] = x[-1]
    return x


@pytest.fixture(scope="module")
def frame(spark):
    x = vectors()
    fields = ["a" if i % 4 else "b" for i in range(len(x))]
    rows = [(1000 + i, f, [float(v) for v in r], 0.5, "r") for i, (f, r) in enumerate(zip(fields, x))]
    bad = [(1, "a", None, 0.0, ""), (2, "a", [1.0] * 7, 0.0, ""), (3, "b", [0.0] * 8, 0.0, ""), (4, "b", [float("nan")] + [1.0] * 7, 0.0, ""), (5, "a", [], 0.0, ""), (6, None, [1.0] * 8, 0.0, ""), (7, "a", [None] + [1.0] * 7, 0.0, ""), (8, "a", [float("inf")] + [1.0] * 7, 0.0, ""), (9, "lone", [1.0] * 8, 0.0, ""), (10, "only bad", None, 0.0, "")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, field_name string, vec array<float>, cosine double, region string")
    return df, exact([r[0] for r in rows], fields, x.astype(np.float64), 5)


def test_all_neighbours(frame):
    df, want = frame
    got = {}
    for r in neighbours.neighbours(df, width=8, region_rows=40).collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour"], r["cosine"]))
    assert set(got) == set(want)
    hits = total = 0
    for key, near in want.items():
        assert len(got[key]) == 5 and len({n for n, _ in got[key]}) == 5 and key not in {n for n, _ in got[key]}
        hits += sum(c >= near[-1][1] - 1e-6 for _, c in got[key])
        total += 5
        if near[-1][1] == 1.0:  # ties among copies go to the smaller keys
            assert sorted(n for n, _ in got[key]) == [n for n, _ in near]
    assert hits / total >= 0.98


def test_mutual_pairs(frame):
    df, want = frame
    pairs = {(a, b) for a, near in want.items() for b, c in near if c >= 0.95 and a < b and a in {n for n, _ in want[b]}}
    got = [tuple(r) for r in neighbours.mutual_pairs(df, width=8).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, field_name string, vec array<float>")
    assert neighbours.mutual_pairs(df).count() == 0 and neighbours.neighbours(df).count() == 0


def test_recall_of_a_narrow_search(spark):
    x = vectors(3000, 16, 7)
    df = spark.createDataFrame([(i, "f", r.tolist()) for i, r in enumerate(x)], "vec_id bigint, field_name string, vec array<double>")
    out = neighbours.recall(df, every=10, width=16, candidates=600, region_rows=700).collect()
    assert out[0]["queries"] == 300 and out[0]["recall"] >= 0.9


def test_recall_where_the_index_prunes(spark):
    """20,000 vectors in families, candidates of 4 % of them; a query scans far less than the field."""
    random_ = np.random.default_rng(11)
    centres = random_.normal(size=(160, 24))
    x = (centres[random_.integers(0, 160, 20_000)] + 0.4 * random_.normal(size=(20_000, 24))).astype(np.float32)
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    index = neighbours.Index(unit[:16_384], 20_000, 800, 5_000)
    group, cell = index.group(unit), index.cell(unit)
    pools = [(index.route(g)[cell] | (group == g)).mean() for g in range(0, len(index.centres), 7)]
    assert np.mean(pools) < 0.12 and index.size() < 50_000_000
    df = spark.createDataFrame([(i, "f", r.tolist()) for i, r in enumerate(x)], "vec_id bigint, field_name string, vec array<float>")
    out = neighbours.recall(df, width=24, candidates=800, region_rows=5_000).collect()
    assert out[0]["queries"] == 200 and out[0]["recall"] >= 0.9


def test_samples_without_usable_vectors(spark):
    """A field whose drawn vectors are all unusable is still searched by its usable ones, or has none."""
    rows = [(i, "a", [1.0, 0.0 + i]) for i in range(30)] + [(100 + i, "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, field_name string, vec array<double>")
    assert {r["field_name"] for r in neighbours.neighbours(df, width=2).collect()} == {"a"}
    good = df.where(neighbours.usable_vector("vec", 2)).count()
    assert good == 30


def test_traverse_is_in_order_of_the_sum():
    r = np.random.default_rng(0)
    a, b = r.random(20), r.random(30)
    cells = neighbours.traverse(a, b, np.ones(600), 600)
    sums = (a[:, None] + b[None, :]).ravel()[cells]
    assert len(set(cells.tolist())) == 600 and (np.diff(sums) >= 0).all()


def test_crowded_codewords_are_split():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(300, 4)), 5 + 0.01 * r.normal(size=(700, 4))]).astype(np.float32)
    code = neighbours._nearest(x, neighbours.fit_codebook(x, 16, 1))
    assert np.bincount(code).max() < 300
    same = np.ones((500, 4), np.float32)
    assert len(neighbours.fit_codebook(same, 8, 1)) == 8


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, field_name string, subset_size int")


def test_subset_covers_families(spark):
    r = random.Random(1)
    cores = ["".join(r.choice("CNOPSFIcnops=#()123") for _ in range(40)) for _ in range(30)]
    rows = []
    for i in range(2000):  # one family holds most records
        core = cores[0] if r.random() < 0.8 else r.choice(cores[1:])
        at = r.randrange(40)
        rows.append((i, core[:at] + r.choice("CNO") + core[at + 1 :], None))
    rows += [(9000, None, None), (9001, "NA", "C"), (9002, " ", "N")]
    df = spark.createDataFrame(rows, "row_id bigint, additive string, aryl_halide string")
    asked = requests(spark, [(1, "additive", 30), (2, "additive", 10), (3, "aryl_halide", 5), (4, "other", 3), (5, "additive", 0), (6, "additive", None)])
    out = subset.select_varied(df, asked, ["additive", "aryl_halide"]).collect()
    chosen = {q: [x["value"] for x in sorted((x for x in out if x["request_id"] == q), key=lambda x: x["rank"])] for q in (1, 2, 3, 4, 5, 6)}
    assert len(set(chosen[1])) == 30 and chosen[2] == chosen[1][:10] and sorted(chosen[3]) == ["C", "N"]
    assert not chosen[4] and not chosen[5] and not chosen[6]
    family = [min(range(30), key=lambda c: sum(a != b for a, b in zip(cores[c], v))) for v in chosen[1]]
    assert len(set(family)) >= 27


def test_subset_beyond_the_feature_width(spark):
    r = random.Random(2)
    df = spark.createDataFrame([("".join(r.choice("CNOPSF") for _ in range(12)),) for _ in range(500)], "additive string")
    out = subset.select_varied(df, requests(spark, [(1, "additive", 300), (2, "additive", 5000)]), ["additive"]).collect()
    n = df.distinct().count()
    assert len({x["value"] for x in out if x["request_id"] == 1}) == 300
    assert len({x["value"] for x in out if x["request_id"] == 2}) == n
    assert subset.select_varied(df.limit(0), requests(spark, [(1, "additive", 3)]), ["additive"]).count() == 0


def test_pivots_are_those_of_plain_qr():
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 6))
    got = subset.pivots(x, 6)
    rest, want = x.copy(), []
    for _ in range(6):
        at = int((rest**2).sum(1).argmax())
        want.append(at)
        q = rest[at] / np.linalg.norm(rest[at])
        rest = rest - np.outer(rest @ q, q)
    assert got == want and subset.pivots(np.zeros((3, 4)), 2) == []
