"""Operators that SQL doesn't reach: loaders, sinks, checkpoints, search, evolution, kernels, streams."""

import csv
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molquarry.functions import tokens, values
from molquarry.operators import duplicates, encoders, evolve, kernels, metrics, models, positions, search, select, sorting, splits
from molquarry.sources import catalog, sinks
from molquarry.streaming import encode


def test_positions_and_running_totals(spark):
    r = random.Random(1)
    data = [(r.randrange(50), i, r.choice([None, r.randrange(9)])) for i in range(900)]
    df = spark.createDataFrame(data, "a int, b int, n int").repartition(7)
    got = sorted((x["a"], x["b"], x["p"]) for x in positions.dense_positions(df, ["a", "b"], "p").collect())
    assert [x[2] for x in got] == list(range(900))
    total, want = 0, {}
    for a, b, n in sorted(data):
        total += n or 0
        want[b] = total
    assert {x["b"]: x["cum_n"] for x in positions.running_totals(df, ["a", "b"], ["n"]).collect()} == want
    assert positions.dense_positions(df.limit(0), ["a"]).count() == 0 and positions.running_totals(df.limit(0), ["a"], ["n"]).count() == 0


def test_csv_loader(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="") as file:
        csv.writer(file).writerows([["name", "n", "x"], *([f"v{i}", i, "NA" if i % 5 == 0 else 'q"u,o'] for i in range(40))])
    df = catalog.CsvLoader(path, ["name", "x"], (10, 20)).load(spark)
    assert df.columns == ["row_id", "name", "x"]
    out = df.orderBy("row_id").collect()
    assert [r["name"] for r in out] == [f"v{i}" for i in range(10, 20)] and out[0]["x"] is None and out[1]["x"] == 'q"u,o'
    assert dict(catalog.CsvLoader(path).load(spark).dtypes)["n"] == "int"


def test_catalog(spark):
    held = catalog.Catalog(spark, "t_")
    arr = np.array([("Rex", 9, 81.0), ("Fido", 3, 27.0)], dtype=[("name", "U10"), ("age", "i4"), ("weight", "f4")])
    held.add("pets", catalog.from_numpy(spark, arr))
    with pytest.raises(ValueError):
        held.add("pets", held["pets"])
    assert held.shape("pets") == (2, 3) and spark.sql("select max(age) from t_pets").first()[0] == 9
    held.rename("pets", "animals")
    assert "pets" not in held and held.names() == ["animals"]
    assert held.create("none", "a int").count() == 0
    assert catalog.from_numpy(spark, np.arange(4)).columns == ["None"]
    for loader in (catalog.ExcelLoader("x.xlsx", "s"), catalog.Hdf5Loader("x.h5", "t")):
        with pytest.raises((ImportError, FileNotFoundError)):
            loader.load(spark)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"a": 1.0}), (2, "x", {"b": 2.0})], "k int, s string, m map<string,double>")
    sinks.export_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out_metric_m")).count() == 2
    sinks.export_columns({"a": [1, 2, 3], "b": [1]}, str(tmp_path / "c"))
    assert (tmp_path / "c.csv").read_text().splitlines() == ["a,b", "1,1", "2,", "3,"]
    folds = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, mae double")
    sinks.export_folds(folds, ["mae"], str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").read_text().splitlines() == ["Average", "mae", "2.0", "Steps", "NR.,mae", "0,1.0", "1,3.0"]
    rows = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    sinks.export_statistics(duplicates.summary(rows, ["a"]), duplicates.distribution(rows, ["a"]), str(tmp_path / "d.json"))
    assert '"entry_most_duplicates": 2' in (tmp_path / "d.json").read_text()
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(df, str(tmp_path / "t"))


def test_tokenizer_golden(spark):
    text = "CC1=C(C=C(C=C1[N+](=O)[O-])[N+](=O)[O-])[N+](=O)[O-]"
    df = spark.createDataFrame([(text,), (None,), ("",), ("C" * 200,)], "s string")
    out = tokens.tokenize(df, "s").collect()
    want = [3, 7, 7, 9, 11, 7, 14, 7, 11, 7, 14, 7, 11, 7, 9, 24, 14, 11, 8, 15, 22, 15, 24, 14, 11, 8, 15, 22, 15, 24, 14, 11, 8, 15, 22, 4]
    assert out[0]["s_ids"] == want + [0] * (100 - len(want))
    assert out[1]["s_ids"] == [0] * 100 and out[2]["s_ids"] == [3, 4] + [0] * 98
    assert out[3]["s_ids"] == [3] + [7] * 98 + [4] and out[3]["s_tokens"][:2] == ["[CLS]", "C"]
    with pytest.raises(ValueError):
        tokens.tokenize(tokens.tokenize(df, "s"), "s")
    assert len(tokens.VOCABULARY) == 105


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.floats(0.01, 0.99))
def test_split_sizes(n, share):
    import math

    assert splits.test_count(n, test_size=share) == min(n, math.ceil(n * share))


def test_train_size_keeps_double_noise():
    assert splits.test_count(10, train_size=0.7) == 4


@pytest.mark.parametrize("n", [3, 3333])
def test_shuffle_is_disjoint_and_exhaustive(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    out = splits.by_shuffle(df, 2, 42, test_size=0.3).collect()
    for k in (0, 1):
        test = [r["row_id"] for r in out if r["split"] == k and r["role"] == "test"]
        train = [r["row_id"] for r in out if r["split"] == k and r["role"] == "train"]
        assert len(test) == splits.test_count(n, 0.3) and sorted(test + train) == list(range(n))
    with pytest.raises(ValueError):
        splits.batches(df, 0)
    assert splits.is_ascending([1, 2, 5]) and not splits.is_ascending([1, 1])


def test_metric_edges(spark):
    none = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    row = metrics.MetricStack(("precision", "recall", "f1", "matthews")).calculate(none).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)
    gaps = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "y double, p double")
    with pytest.raises(Exception, match="null label"):
        metrics.MetricStack(("mae",)).calculate(gaps).collect()
    assert metrics.MetricStack(("mae",)).calculate(gaps, nulls="drop").first()[0] == 0.0
    with pytest.raises(ValueError):
        metrics.MetricStack(())
    with pytest.raises(ValueError):
        metrics.badness(F.lit(1.0), "confusion_matrix")
    assert metrics.MetricStack(("mae",)) == metrics.MetricStack(("mae",))
    folds = spark.createDataFrame([(0, 1.2), (1, 0.7), (2, 0.8)], "fold int, r2 double")
    assert metrics.best(folds, "r2").first()["fold"] == 0 or abs(1 - 1.2) <= abs(1 - 0.8) + 1e-9


def test_positional_writes(spark):
    df = spark.range(6).select(F.col("id").alias("row_id"), F.lit("a").alias("s"))
    new = spark.createDataFrame([(2, None), (4, "b")], "row_id bigint, s string")
    assert [r["s"] for r in select.overwrite_rows(df, new, ["s"]).orderBy("row_id").collect()] == ["a", "a", None, "a", "b", "a"]
    doubled = select.map_chunks(df.select("row_id"), lambda pdf: pdf * 2)
    assert sorted(r[0] for r in doubled.collect()) == [0, 2, 4, 6, 8, 10]
    with pytest.raises(ValueError):
        select.assembled(df, ["s"])
    big = select.gather(df, list(range(0, 5000, 2)))
    assert sorted(r[0] for r in big.collect()) == [0, 2, 4]


def test_sorts(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (3, "A")], "n int, s string")
    assert [tuple(r) for r in sorting.lexsort(df).collect()] == [(1, "b"), (3, "A"), (3, "a")]
    assert [r["n"] for r in sorting.sort_by(df, -F.col("n"), "s").collect()] == [3, 3, 1]


def test_encoders(spark):
    df = spark.createDataFrame([("x", "y", [1, 0, 5]), (None, "x", [1, 2, 5])], "a string, b string, v array<int>")
    hot = encoders.MultiHot.fit(df, ["a", "b"]).transform(df)
    assert hot.columns == ["v", "onehot_ab"] and [list(r["onehot_ab"]) for r in hot.collect()] == [[1, 1], [1, 0]]
    drop = encoders.ConstantDrop.fit(df, "v")
    assert drop.positions == (0, 2) and [r["v"] for r in drop.transform(df).select("v").collect()] == [[0], [2]]
    assert encoders.promoted(["tinyint", "int", "float"]) == "float"
    assert df.select(values.padded(F.col("v"), 5, F.lit(-1))).first()[0] == [1, 0, 5, -1, -1]


def test_kernels(spark):
    df = spark.createDataFrame([("CCl",), ("CCl",), (None,), ("[H]O",)], "s string")
    assert sorted(r["n"] for r in kernels.convert(df, ["s"], "heavy_atoms", ["n"]).where("s is not null").collect()) == [1, 2, 2]
    with pytest.raises(ValueError):
        kernels.convert(df, ["s"], "heavy_atoms", ["a", "b"])
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            kernels.canonical("C")


def test_search():
    assert search.Range(1, 4, whole=True).values() == [1, 2, 3] and search.Range(0, 1, count=3).values() == [0, 0.5, 1]
    assert search.grid({"a": search.Choice((1, 2)), "b": search.Choice(("x", "y"))})[:2] == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    run = lambda c, fold: c["a"] + fold
    assert search.grid_search({"a": search.Choice((3, 1, 2))}, [0, 1], run, "mae")[0] == {"a": 1}
    assert search.grid_search([{"a": search.Choice((3, 1))}], [0], run, "accuracy")[0] == {"a": 3}
    best, tried = search.random_search({"a": search.Range(0, 1), "k": search.Choice(("u", "v"))}, [0], run, "mae", 20)
    assert len(tried) == 20 and best["a"] == min(c["a"] for c, _ in tried) and best["k"] in ("u", "v")
    with pytest.raises(ValueError):
        search.search([], [0], run, "mae")


def test_patterns():
    a, b = evolve.Pattern(("C", "N", "O"), ("=", "-")), evolve.Pattern(("S",))
    assert a.text() == "C=NO" and a.slice(1, 2).text() == "NO"
    chance = random.Random(1)
    for _ in range(50):
        child = evolve.cross(a, b, chance)
        assert len(child.bonds) == len(child.atoms) - 1 and "S" in child.atoms
    one, two = evolve.Genome([a, b]), evolve.Genome([b, a])
    assert one.id() == two.id() and one.covers(two) and len(one + evolve.Genome([b])) == 2
    assert evolve.generation_sizes(10, 0.2, 0.3, 0.5) == (2, 3, 5, 5)


def test_evolution_does_not_get_worse(spark):
    r = random.Random(5)
    rows = [("".join(r.choice("CNOS") for _ in range(12)),) for _ in range(80)]
    df = spark.createDataFrame(rows, "s string").withColumn("y", values.occurrences(F.col("s"), "NO").cast("double"))
    seen = []
    search_ = evolve.Evolution(df, "s", ["C", "N", "O", "S", "x"], evolve.mean_fitness(df, "s", "y"), size=3, population=6, aging=0.1)
    best = search_.run(2, save=lambda step, people: seen.append((step, people[0].fitness, [g.texts() for g in people])))
    assert [s[0] for s in seen] == [0, 1, 2] and best.fitness >= 0.2
    assert all(len(set(t)) == len(t) and not any("x" in p for p in t) for _, _, people in seen for t in people)
    table = evolve.population_frame(spark, 2, [best])
    assert table.count() == len(best) and evolve.best_members(table, 1).count() == 1
    again = evolve.Evolution(df, "s", ["C", "N", "O", "S", "x"], evolve.mean_fitness(df, "s", "y"), size=3, population=6, aging=0.1)
    assert again.run(2).texts() == best.texts()


def test_checkpoints(spark, tmp_path):
    held = models.Checkpoints(str(tmp_path / "c"), keep=2)
    for i in range(3):
        held.save(f"s{i}", spark.range(i + 1), epoch=i)
    assert [e["name"] for e in held.entries()] == ["s1", "s2"]
    entry, table = models.Checkpoints(str(tmp_path / "c")).newest(spark)
    assert entry["meta"] == {"epoch": 2} and table.count() == 3
    with pytest.raises(ValueError):
        held.save("s2", spark.range(1))
    with pytest.raises(ValueError):
        models.estimator("unknown")


def test_model_can_be_saved(spark, tmp_path):
    df = spark.createDataFrame([(float(i), [float(i), 1.0]) for i in range(30)], "y double, x array<double>").withColumn("role", F.lit("train"))
    model, predicted, measured = models.TrainEval("linear_regression", "x", "y", metrics.MetricStack(("r2", "mae"))).run(df)
    assert measured.first()["r2"] > 0.99
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml.regression import LinearRegressionModel

    assert models.predict(LinearRegressionModel.load(str(tmp_path / "m")), df, "x").count() == 30
    sinks.export_predictions(predicted, str(tmp_path / "p"))


def test_stream_appends(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    stream = encode.read_stream(spark, f"{tiny}/events.parquet*", schema)
    encode.run_once(encoders.pattern_counts(stream, "event_type", ["i", "e"]).select("event_id", "features"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_fingerprints(spark):
    from molquarry.operators import fingerprints as fp

    recipe = fp.many_fingerprints(16)
    assert len(recipe) == 24 and fp.total_width(recipe) == 23 * 16 + 167
    assert fp.element_kind(recipe) == "tinyint" and fp.element_kind([fp.Fingerprint("circular_counts")]) == "int"
    with pytest.raises(ValueError):
        fp.Fingerprint("other")
    small = [fp.Fingerprint("path", 3), fp.Fingerprint("avalon", 4)]
    df = spark.createDataFrame([("CO",), ("CO",), (None,)], "s string")
    kernel = lambda v: [0, 1, 1, 1, 0, 0, 1]
    plain = fp.encode(df, "s", small, "f", kernel).orderBy(F.col("s").isNull()).collect()
    assert [r["f"] for r in plain] == [[0, 1, 1, 1, 0, 0, 1]] * 2 + [[0] * 7]
    places = fp.encode(df, "s", small, "f", kernel, indices=True, offset=10).orderBy(F.col("s").isNull()).collect()
    assert [r["f"] for r in places] == [[11, 12, -1, 10, 13, -1, -1]] * 2 + [[-1] * 7]
    out = fp.reaction(spark.createDataFrame([("C", "N", None)], "a string, b string, c string"), "f", ["a"], ["b"], ["c"], 32)
    assert out.columns == ["f"] and sum(out.first()["f"]) >= 1
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            fp.from_text(recipe)("C")


def test_training_resumes(spark, tmp_path):
    seen = []

    def step(state, batch):
        seen.append(batch)
        if len(seen) == 4:
            raise KeyboardInterrupt
        return state.select((F.col("n") + batch).alias("n"))

    held = models.Checkpoints(str(tmp_path / "c"), keep=1)
    start = spark.createDataFrame([(0,)], "n int")
    with pytest.raises(KeyboardInterrupt):
        models.train_in_batches(step, [1, 10, 100], 2, held, start)
    assert models.train_in_batches(step, [1, 10, 100], 2, held, start).first()[0] == 222
    assert seen == [1, 10, 100, 1, 1, 10, 100]


def test_pipeline_is_fit_on_training_rows(spark):
    df = spark.createDataFrame([(0, [1, 0]), (1, [1, 1]), (2, [2, 1])], "row_id bigint, v array<int>")
    out, steps = models.fitted_pipeline(df, [(encoders.ConstantDrop, "v"), lambda d: d.withColumn("n", F.size("v"))], df.where("row_id < 2"))
    assert steps[0].positions == (0,) and [r["n"] for r in out.collect()] == [1, 1, 1]
    parts = splits.split_frames(df, splits.by_shuffle(df, 2, 42, test_size=0.3))
    assert {k: (v["train"].count(), v["test"].count()) for k, v in parts.items()} == {0: (2, 1), 1: (2, 1)}


def test_patterns_from_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("C=N,1\nO,2\n")
    texts = evolve.load_patterns(spark, str(tmp_path / "p.csv"))
    assert texts == ["C=N", "O"]
    df = spark.createDataFrame([("OC=NO",), (None,)], "s string")
    genome = evolve.Genome([evolve.Pattern(("C", "N"), ("=",)), evolve.Pattern(("O",))])
    assert [r["features"] for r in evolve.encode_genome(df, "s", genome, match=False).collect()] == [[1, 2], [0, 0]]
