"""Jobs, nested search, metric stacks, cut values and evolution from data."""

import json

import pytest
from pyspark.sql import functions as F

from molquarry.operators import duplicates, encoders, evolve, fingerprints, jobs, metrics, models, positions, search, select, splits
from molquarry.sources import catalog


@pytest.fixture(scope="module")
def line(spark):
    rows = [(i, [float(i), float(i % 3)], 2.0 * i + 1, i % 2, "train" if i % 4 else "test", "x") for i in range(60)]
    return spark.createDataFrame(rows, "row_id bigint, v array<double>, t double, c int, role string, prediction string")


def test_jobs_write_and_measure(spark, line, tmp_path):
    stack = metrics.MetricStack(("r2", "mae"))
    job = jobs.create("train_eval", kind="linear_regression", features="v", label="t", metrics=stack, folder=str(tmp_path), step=3)
    done = jobs.Runner().run([job], line)[0]
    assert done.measured.where("role = 'test'").first()["r2"] > 0.999
    for role in ("Train", "Test"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/Outer_Step_3_{role}prediction").columns == ["True_values", "Predicted_values"]
        assert spark.read.option("header", True).csv(f"{tmp_path}/Outer_Step_3_{role}metrics").columns == ["r2", "mae"]
    table = jobs.finished_table(spark, "grid", [({"a": 1}, done)], str(tmp_path / "jobs"))
    assert table.count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "jobs")).count() == 1
    evaluated = jobs.EvalJob(done.model, "v", "t", stack, str(tmp_path / "eval")).run(line)
    assert evaluated.measured.first()["mae"] < 1e-6 and spark.read.option("header", True).csv(str(tmp_path / "eval" / "prediction")).count() == 60


def test_predictions_are_written_back(spark, line, tmp_path):
    model = jobs.TrainJob("linear_regression", "v", "t").run(line).model
    done = jobs.PredictJob(model, "v", [3, 5, 1000], str(tmp_path / "p"), column="guess").run(line)
    got = {r["row_id"]: r["guess"] for r in done.predicted.collect()}
    assert set(got) == {3, 5} and abs(got[3] - 7) < 1e-6
    whole = select.overwrite_rows(line.withColumn("t", F.lit(0.0)), spark.read.parquet(str(tmp_path / "p")).withColumnRenamed("guess", "t"), ["t"])
    assert whole.where("t <> 0").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        jobs.PredictJob(model, "v", None, str(tmp_path / "p")).run(line)


def test_classifiers_keep_probabilities(line):
    done = jobs.TrainEvalJob("random_forest_classifier", "v", "c", metrics.MetricStack(("accuracy",)), {"n_estimators": 3}).run(line)
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in done.predicted.collect())


def test_runner_keeps_errors(line):
    def fail(df):
        raise RuntimeError("no")

    runner = jobs.Runner(keep_errors=True)
    assert runner.run([jobs.create("custom", function=fail, name="bad"), jobs.TrainJob("linear_regression", "v", "t")], line)[0].model is not None
    assert [n for n, _ in runner.failed] == ["bad"]
    with pytest.raises(RuntimeError):
        jobs.Runner().run([jobs.CustomJob(fail)], line)
    with pytest.raises(ValueError):
        jobs.create("unknown")


def test_nested_search(line):
    test = lambda n: [F.col("row_id").cast("bigint") % (2 * n) < n, F.col("row_id").cast("bigint") % (2 * n) >= n]
    found = jobs.NestedSearch("linear_regression", "t", "r2", test(1), test(2)).run(line, {"features": search.Choice(("v",)), "fitIntercept": search.Choice((True, False))}).collect()
    assert len(found) == 4 and sum(r["best"] for r in found) == 2
    assert all(r["best"] == ("True" in r["parameters"]) and (r["outer_test"] is not None) == r["best"] for r in found)


def test_whole_stack(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.4), (0, 0, 0.1)], "y int, p int, score double")
    out = {(r["metric"], r["item"]): r["value"] for r in metrics.MetricStack(tuple(metrics.DIRECTIONS)).calculate_all(rows).collect()}
    assert {m for m, _ in out} == set(metrics.DIRECTIONS)
    assert out["accuracy", None] == 0.5 and out["accuracy_count", None] == 2 and out["roc_auc", None] == 0.75
    assert out["confusion_matrix", "1/0"] == 1 and out["recall_matrix", "1"] == 0.5 and out["roc_curve", "inf:fpr"] == 0
    with pytest.raises(ValueError):
        metrics.MetricStack(("roc_auc",)).calculate(rows)
    with pytest.raises(ValueError):
        metrics.MetricStack(("other",)).calculate_all(rows)
    assert metrics.recall_score(rows).first()[0] == metrics.recall_score(rows, "micro").first()[0] == 0.5


def test_confusion_needs_all_labels(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c")], "y string, p string")
    assert metrics.confusion_matrix(rows).columns == ["y", "pred_a", "pred_b", "pred_c"]
    with pytest.raises(ValueError):
        metrics.confusion_matrix(rows, ["a", "b"])


def test_cut_values(spark, monkeypatch):
    """Exactly n rows at any n, with many ties of the hash, and none of an empty table."""
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7 * 600_000_000).alias("h"))
    order = [r["k"] for r in rows.orderBy("h", "k").collect()]
    for n, bucket in ((1, 1), (70, 1), (250, 1), (250, 100_000), (499, 100_000), (500, 1), (900, 100_000)):
        monkeypatch.setattr(positions, "BUCKET_ROWS", bucket)
        found = positions.smallest(rows, [F.col("h"), F.col("k")], "k", n)
        assert sorted(r["k"] for r in rows.where(found[0].inside(F.col("h"), "k")).collect()) == sorted(order[:n])
        assert rows.where(found[1].inside(F.col("k"), "k")).count() == min(n, 500)
    assert positions.smallest(rows, [F.col("h")], "k", 0) == [None] and positions.smallest(rows.limit(0), [F.col("h")], "k", 5) == [None]
    assert select.exact_sample(rows, 900, "k").count() == 500 and select.exact_sample(rows, 0, "k").count() == 0
    assert splits.by_shuffle(rows.limit(0).withColumnRenamed("k", "row_id"), 2).count() == 0


def test_running_totals(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else float(i), "x") for i in range(50)], "k int, v double, _seq2 string").repartition(5)
    out = {r["k"]: r["cum_v"] for r in positions.running_totals(rows, ["k"], ["v"]).collect()}
    total = 0.0
    for i in range(50):
        total += 0 if i == 3 else i
        assert out[i] == total
    assert positions.running_totals(rows.limit(0), ["k"], ["v"]).count() == 0


def test_duplicates_with_nulls(spark):
    rows = spark.createDataFrame([(None, 1, None), (None, 1, "a"), (2, 1, "b"), (2, None, "b"), (2, None, "b"), (5, 5, None)], "x int, y int, last string")
    got = {r["last"]: r["rows"] for r in duplicates.by_last_column(rows, ["x", "y", "last"]).collect()}
    assert got == {None: 1, "a": 1, "b": 2}


def test_fingerprints_agree(spark):
    texts = ["", "ab", "abc", "abcabc", None, "a€𝄞b" * 4, "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    native = {r["i"]: r["b"] for r in df.select("i", encoders.hashed_fingerprint("t", 100).alias("b")).collect()}
    import pyarrow as pa

    assert [native[i] for i in range(len(texts))] == fingerprints.folded(pa.array(texts, pa.string()), 100, 3).tolist()


def test_weights(spark):
    df = spark.createDataFrame([("CCO",), ("c1ccccc1Cl",), ("[Si](C)[nH]",), ("[13CH4]",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(encoders.heavy_atom_weight("s")).collect()]
    want = [2 * 12.011 + 15.999, 6 * 12.011 + 35.45, 28.086 + 12.011 + 14.007, 12.011, 0.0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)) and got[5] is None


def test_pool_and_patterns(spark, tmp_path):
    df = spark.createDataFrame([("CCN(C)",), ("CC=O",), ("C[nH]",), (None,), ("NA",)], "smiles string")
    pool = {r["primitive"]: r for r in evolve.primitive_pool(df, "smiles").collect()}
    assert pool["C"]["least"] == 1 and pool["C"]["most"] == 3 and pool["[nH]"]["kind"] == "atom" and pool["="]["least"] == 0
    assert evolve.atoms_of(evolve.primitive_pool(df, "smiles"))[0] == "C"
    for text in ("C", "CN", "C=O", "[nH]:c#Br", "ClC"):
        assert evolve.read_pattern(text).text() == text
    people = [evolve.Genome([evolve.read_pattern("C=O"), evolve.read_pattern("N")], 0.5), evolve.Genome([evolve.read_pattern("Br")], 0.25)]
    assert evolve.newest_step(spark, str(tmp_path / "none")) is None
    for step in (0, 1):
        evolve.save_step(spark, str(tmp_path / "e"), step, people[step:])
    step, held = evolve.newest_step(spark, str(tmp_path / "e"))
    assert step == 1 and [g.texts() for g in held] == [["Br"]] and held[0].fitness == 0.25
    evolve.save_step(spark, str(tmp_path / "e"), 2, people)
    assert [g.texts() for g in evolve.newest_step(spark, str(tmp_path / "e"))[1]] == [["C=O", "N"], ["Br"]]


def test_evolution_resumes(spark, tmp_path):
    df = spark.createDataFrame([("C" * (i % 5 + 1) + "N" * (i % 3), float(i % 5)) for i in range(40)], "s string, y double")
    start = lambda: evolve.Evolution(df, "s", ["C", "N"], evolve.mean_fitness(df, "s", "y"), size=2, population=4, longest=2)
    evolve.resumed(start(), spark, str(tmp_path / "r"), 1)
    evolve.resumed(start(), spark, str(tmp_path / "r"), 2)
    assert evolve.newest_step(spark, str(tmp_path / "r"))[0] == 2


def test_model_fitness(spark):
    df = spark.createDataFrame([(i, "C" * (i % 5 + 1) + "N" * (i % 3), float(i % 5)) for i in range(60)], "i int, s string, y double")
    tell = evolve.model_fitness(df, "s", "y", [F.col("i") % 3 == 0, F.col("i") % 3 == 1], "mae")
    good, poor = tell([evolve.Genome([evolve.read_pattern("C")]), evolve.Genome([evolve.read_pattern("N")])])
    assert good > poor and abs(good) < 1e-6
    assert evolve.model_fitness(df, "s", "none", [F.lit(True)])([evolve.Genome([evolve.read_pattern("C")])]) == [0.0]


def test_diversity_of_columns(spark):
    rows = [([0, 1], [1]), ([0, 0], [1]), ([1, 1], [0])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    want = 2 * sum(x[c][k] == y[c][k] for i, x in enumerate(rows) for y in rows[:i] for c in (0, 1) for k in range(len(x[c]))) + 6
    got = evolve.diversity_score(df, ["a", "b"], 0.2).first()
    assert got["collisions"] == want and abs(got["ratio"] - want / 36) < 1e-12 and abs(got["score"] - (1 - abs(want / 36 - 0.2))) < 1e-12


def test_checkpoints_on_the_tables_file_system(spark, tmp_path):
    held = models.Checkpoints(f"file:{tmp_path}/c", keep=1)
    assert held.newest(spark) is None
    for k in range(3):
        held.save(f"s{k}", spark.range(k + 1), step=k)
    entry, table = models.Checkpoints(f"file:{tmp_path}/c").newest(spark)
    assert entry["meta"]["step"] == 2 and table.count() == 3
    assert [e["name"] for e in json.loads((tmp_path / "c" / "manifest.json").read_text())] == ["s2"] and not (tmp_path / "c" / "s0").exists()


def test_nested_roles_and_catalog(spark):
    import pandas as pd

    rows = splits.nested_roles(spark.range(12), [F.col("id") < 4], [F.col("id") % 2 == 0])
    assert {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()} == {"outer_test": 4, "inner_test": 4, "train": 4}
    held = catalog.Catalog(spark, "jobs_")
    held.add("a", catalog.from_pandas(spark, pd.DataFrame({"k": [2, 1], "t": ["x", None]})))
    assert held["a"].where("t IS NULL").count() == 1
    held.copy("a", "b")
    assert held.resize("b", 1, ["k"]).first()["k"] == 1 and held.resize("b", 3, ["k"]).count() == 3 and held["a"].count() == 2
