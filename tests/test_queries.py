"""Every core query against its SQL, and those without SQL for their shape."""

import pytest

import __spark_entry__ as contract
from molquarry.functions.tokens import VOCABULARY
from molquarry.plans.oracle import SQL
from molquarry.plans.queries import QUERIES
from tests.compare import both


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, name):
    left, right = both(spark, tiny, QUERIES[name], SQL[name])
    assert left == right


@pytest.mark.parametrize("name", ["random_forest_eval", "gbt_eval", "forest_regression_eval", "grid_search_best"])
def test_models_run(spark, tiny, name):
    rows = QUERIES[name](spark, tiny).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_forest_beats_the_mean(spark, tiny):
    """Training error of a fitted forest lies below that of the mean (r2 above 0), and a second run is equal."""
    a = {r["role"]: r["r2"] for r in QUERIES["forest_regression_eval"](spark, tiny).collect()}
    b = {r["role"]: r["r2"] for r in QUERIES["forest_regression_eval"](spark, tiny).collect()}
    assert a["train"] > 0.1 and a == b


def test_pca_is_centred(spark, tiny):
    import numpy as np

    rows = QUERIES["pca_embeddings"](spark, tiny).collect()
    x = np.array([r["pca"] for r in rows])
    raw = np.array([r["embedding"] for r in spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-5)
    singular = np.linalg.svd(raw - raw.mean(axis=0), compute_uv=False)[:8]
    assert np.allclose(np.sqrt((x**2).sum(axis=0)), singular, rtol=1e-3)


def test_reactions_keep_all_bits(spark, tiny):
    """The fingerprint of every reaction, against hashes of its 3-grams one by one."""
    import hashlib

    texts = {r["row_id"]: r["reaction"] for r in QUERIES["reaction_string"](spark, tiny).collect()}
    got = {r["row_id"]: r["bits"] for r in QUERIES["reaction_fingerprint"](spark, tiny).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        held = {int(hashlib.md5(text[i : i + 3].encode()).hexdigest()[:8], 16) % 2048 for i in range(len(text) - 2)}
        assert len(got[k]) == 2048 and {i for i, b in enumerate(got[k]) if b == "1"} == held


def _framed(spark, tiny):
    """The framed words of every text, of any length."""
    texts = {r["row_id"]: r["tokens"] for r in QUERIES["regex_tokenize"](spark, tiny).collect()}
    words = {k: [w if w in VOCABULARY else "[UNK]" for w in t.split()] for k, t in texts.items() if t is not None}
    room = max(map(len, words.values())) + 2
    assert room > 60
    full = {k: ["[CLS]", *words[k], "[SEP]"] if k in words else [] for k in texts}
    return {k: w + ["[PAD]"] * (room - len(w)) for k, w in full.items()}


def test_token_ids_keep_every_token(spark, tiny):
    got = {r["row_id"]: r["ids"].split(",") for r in QUERIES["token_ids_padded"](spark, tiny).collect()}
    assert {k: [VOCABULARY[int(i)] for i in ids] for k, ids in got.items()} == _framed(spark, tiny)


def test_decoding_keeps_every_token(spark, tiny):
    got = {r["row_id"]: r["words"].split(" ") for r in QUERIES["token_decode"](spark, tiny).collect()}
    assert got == _framed(spark, tiny)


def test_subsets_of_all_parts(spark, tiny):
    types = {}
    for r in spark.read.parquet(f"{tiny}/part.parquet").collect():
        types.setdefault(r["p_brand"], set()).add(r["p_type"])
    want = {(a, b) for a in types for b in types if a != b and types[a] <= types[b]}
    got = [tuple(r) for r in QUERIES["genome_subset"](spark, tiny).select("p_brand", "other").collect()]
    assert len(got) == len(want) and set(got) == want
