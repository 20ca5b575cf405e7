"""Named queries of the core operators: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import tokens, values
from molquarry.operators import duplicates, encoders, evolve, fingerprints, jobs, kernels, metrics, models, positions, search, select, sorting, splits
from molquarry.session import read_table, scratch_folder
from molquarry.sources import catalog, rejects
from molquarry.streaming import encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "dreher_raw").where("line_no > 1")
    return rejects.load_lines(lines).where("reason IS NOT NULL").select("line_id", "reason")


@query
def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "dreher_raw").where("line_no > 1")
    return rejects.load_lines(lines).where("reason IS NULL").select("line_id", *rejects.FIELDS[:4], rejects.number(F.col("output")).alias("output_value"))


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return positions.dense_positions(read_table(spark, sf_dir, "events").select("event_id", *columns), ["event_id"])


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return positions.dense_positions(read_table(spark, sf_dir, "orders").select("o_orderkey", *columns), ["o_orderkey"])


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _bits(spark: SparkSession, sf_dir: str, least: float = 0.15) -> DataFrame:
    """Embeddings as 0/1 vectors."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x > least).cast("int")).alias("bits"))


# sources and metadata


@query
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = catalog.Catalog(spark, "shape_").load({n: catalog.ParquetLoader(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "part")})
    out = None
    for name in held.names():
        one = held[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(held[name].columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def file_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rows_by_file(read_table(spark, sf_dir, "dreher_raw")).agg(F.sum("rows").alias("n_rows"))


@query
def null_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dreher_dataset").select("row_id", *(values.null_sentinels(c).alias(c) for c in ("ligand", "additive", "base", "aryl_halide")))


# projection, filters, positional access


@query
def project_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rows_between(_orders(spark, sf_dir, "o_totalprice"), 100, 200).select("row_id", "o_orderkey", "o_totalprice")


@query
def gather_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = positions.dense_positions(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["doc_id"])
    return select.gather(docs, [0, 5, 17, 42, 99, 1_000_000])


@query
def inverse_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("row_id", "event_id")
    return select.inverse(events, events.where("row_id % 7 = 0"))


@query
def sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.valid_values(read_table(spark, sf_dir, "toxicity"), "smiles").select("row_id", "smiles")


@query
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_of_each(read_table(spark, sf_dir, "lipophilicity"), F.replace("smiles", F.lit("@"), F.lit("")), "row_id").select("row_id", "smiles")


@query
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.renumbered(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") <= 25, ["p_partkey"]).select("ID", "p_partkey", "p_size")


@query
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exact_sample(read_table(spark, sf_dir, "orders"), 1000, "o_orderkey").select("o_orderkey", "o_totalprice")


@query
def feature_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.feature_width(read_table(spark, sf_dir, "embeddings"), ["embedding", "label"])


@query
def assemble_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = select.assembled(read_table(spark, sf_dir, "embeddings"), ["embedding", "label"])
    return wide.select("vec_id", F.posexplode("features").alias("pos", "x"))


@query
def overwrite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = positions.dense_positions(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    new = part.where("row_id % 3 = 0").select("row_id", (F.col("p_size") + 100).alias("p_size"))
    return select.overwrite_rows(part, new, ["p_size"]).select("row_id", "p_partkey", "p_size")


@query
def align_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional alignment of a feature and a target table."""
    x = positions.dense_positions(read_table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    y = _orders(spark, sf_dir, "o_totalprice").select("row_id", "o_totalprice")
    return x.join(y, "row_id")


# sort, reorder, shuffle, top-k, duplicates


@query
def lexsort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.lexsort_rank(read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber"), ["l_suppkey", "l_partkey", "l_linenumber"])


@query
def topk_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top(read_table(spark, sf_dir, "events"), 50, "value", "event_id").select("event_id", "value")


@query
def reorder_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.by_range(_orders(spark, sf_dir).select("row_id", "o_orderkey"), 500, 900)
    return sorting.reordered(split).select("new_id", "row_id", "o_orderkey", "role")


@query
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.shuffled(read_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


DUPLICATES = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.summary(read_table(spark, sf_dir, "lineitem"), DUPLICATES)


@query
def dup_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.distribution(read_table(spark, sf_dir, "lineitem"), DUPLICATES)


@query
def dup_by_last_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.by_last_column(read_table(spark, sf_dir, "lineitem"), DUPLICATES)


@query
def value_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.value_domain(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query
def column_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return duplicates.relevance(lines, ["l_orderkey", "l_quantity", "l_tax", "l_returnflag", "one"])


@query
def constant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.constant_positions(_bits(spark, sf_dir, 0.3), "bits")


@query
def drop_constant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = _bits(spark, sf_dir, 0.3)
    return encoders.ConstantDrop.fit(bits, "bits").transform(bits).select("vec_id", F.size("bits").cast("bigint").alias("width"), F.aggregate("bits", F.lit(0), lambda a, x: a + x).cast("bigint").alias("ones"))


# splits


@query
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    return splits.all_train(part).unionByName(splits.all_test(part))


@query
def split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_range(_events(spark, sf_dir).select("row_id", "event_id"), 2000, 10_000_000)


@query
def split_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_shuffle(_events(spark, sf_dir), 2, 42, train_size=0.7)


@query
def split_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("row_id", "event_id")
    return splits.by_fold(events, 5, events.count())


@query
def split_nested_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.nested(_events(spark, sf_dir), (100, 300), (50, 250))


@query
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = splits.by_range(_events(spark, sf_dir).select("row_id"), 0, 500).where("role = 'train'")
    return splits.batches(train, 128, 2)


# metrics


def _yp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("p"))


@query
def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.MetricStack(("r2", "mae", "mse", "max_error", "explained_variance")).calculate(_yp(spark, sf_dir)), 4)


@query
def metric_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("accuracy", "zero_one_loss", "hamming_loss", "precision", "recall", "f1", "jaccard", "matthews")
    return _rounded(metrics.MetricStack(names).calculate(_binary(spark, sf_dir)))


@query
def metric_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    both = [metrics.specificity(labels, a).withColumn("average", F.lit(a)) for a in ("macro", "micro")]
    return _rounded(both[0].unionByName(both[1]))


@query
def metric_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.balanced_accuracy(_labels(spark, sf_dir)))


@query
def recall_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.recall_matrix(_labels(spark, sf_dir)))


@query
def specificity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.specificity_matrix(_labels(spark, sf_dir)))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_labels(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("score"))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir)))


@query
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_curve(_scored(spark, sf_dir)))


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir, "value")
    folds = splits.by_fold(events, 5, events.count()).withColumn("y", F.col("value")).withColumn("p", F.lit(50.0))
    return metrics.MetricStack(("mae", "mse")).calculate(folds, by=["fold"])


@query
def fold_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.fold_average(_fold_metrics(spark, sf_dir).withColumn("config", F.lit("fixed")), ["config"], ["mae", "mse"]))


@query
def best_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(_fold_metrics(spark, sf_dir), "mae").select("fold", F.round("mae", 6).alias("mae"))


# encoders


@query
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return encoders.MultiHot.fit(lines, ["l_returnflag", "l_linestatus"]).transform(lines, "code").select("l_orderkey", "l_linenumber", F.array_join(F.col("code").cast("array<string>"), "").alias("code"))


@query
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read_table(spark, sf_dir, "events").select("event_type").distinct()
    coded = encoders.random_vectors(kinds, ["event_type"], 8)
    return coded.select("event_type", F.posexplode("vec_event_type").alias("pos", "x")).withColumn("x", F.round("x", 9))


@query
def regex_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    smiles = read_table(spark, sf_dir, "lipophilicity")
    return smiles.select("row_id", F.array_join(tokens.regex_tokens(F.col("smiles")), " ").alias("tokens"))


def _whole_length(smiles: DataFrame) -> int:
    """Room for the tokens of the longest text and both frame tokens."""
    longest = smiles.agg(F.max(F.size(tokens.regex_tokens(F.col("smiles"))))).first()[0]
    return max(longest or 0, 0) + 2


@query
def token_ids_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text, padded to the longest."""
    smiles = read_table(spark, sf_dir, "lipophilicity").select("row_id", "smiles")
    coded = tokens.tokenize(smiles, "smiles", _whole_length(smiles))
    return coded.select("row_id", F.array_join(F.col("smiles_ids").cast("array<string>"), ",").alias("ids"))


@query
def token_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every token of every text."""
    smiles = read_table(spark, sf_dir, "lipophilicity").select("row_id", "smiles")
    ids = tokens.token_ids(tokens.regex_tokens(F.col("smiles")), _whole_length(smiles))
    return smiles.select("row_id", tokens.decoded(ids).alias("words"))


@query
def reaction_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dreher_dataset").select("row_id", values.reaction_string(["aryl_halide", "ligand"], ["base"], ["additive"]).alias("reaction"))


@query
def reaction_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2048 folded bits of the reaction string of every record."""
    coded = fingerprints.reaction(read_table(spark, sf_dir, "dreher_dataset"), "bits", ["aryl_halide", "ligand"], ["base"], ["additive"], as_text=True)
    return coded.select("row_id", "bits")


@query
def nonzero_indices_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).select("vec_id", F.array_join(values.nonzero_indices(F.col("bits"), 1, -1).cast("array<string>"), ",").alias("places"))


PATTERNS = ["C(=O)", "N", "c1", "[nH]", "=C"]


@query
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoders.pattern_counts(read_table(spark, sf_dir, "toxicity"), "smiles", PATTERNS)
    return coded.select("row_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("counts"))


@query
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoders.pattern_counts(read_table(spark, sf_dir, "toxicity"), "smiles", PATTERNS, match=True)
    return coded.select("row_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("bits"))


@query
def regex_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket atoms, two-digit ring labels, and a chain of three carbons."""
    coded = encoders.regex_counts(read_table(spark, sf_dir, "toxicity"), "smiles", [r"\[[^\]]+\]", r"%[0-9][0-9]", "CCC"])
    return coded.select("row_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("counts"))


@query
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoders.looked_up(read_table(spark, sf_dir, "customer"), "c_nationkey", read_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation")
    return coded.select("c_custkey", "nation")


@query
def hashed_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(encoders.hashed_fingerprint("p_name", 64).cast("array<string>"), "").alias("bits"))


@query
def kernel_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    smiles = select.valid_values(read_table(spark, sf_dir, "toxicity"), "smiles")
    return kernels.convert(smiles, ["smiles"], "heavy_atoms", ["atoms"]).select("row_id", "atoms")


@query
def descriptor_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", encoders.rounded("o_totalprice").alias("whole"), encoders.rounded("o_totalprice", 1).alias("tenths"))


@query
def genome_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("genes"))
    return genes.select("p_brand", values.genome_id(F.col("genes")).alias("id"))


@query
def genome_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of brands of which one's types are all among the other's."""
    return evolve.subset_pairs(read_table(spark, sf_dir, "part"), "p_brand", "p_type")


@query
def heavy_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    smiles = select.valid_values(read_table(spark, sf_dir, "toxicity"), "smiles")
    return smiles.select("row_id", F.round(encoders.heavy_atom_weight("smiles"), 3).alias("weight"))


@query
def weight_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules up to a weight, with dense new ids."""
    smiles = select.valid_values(read_table(spark, sf_dir, "lipophilicity"), "smiles").select("row_id", "smiles")
    return select.renumbered(smiles, encoders.heavy_atom_weight("smiles") <= 800, ["row_id"]).select("ID", "row_id", "smiles")


# fitness and search


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round(F.avg("o_totalprice") / 1000 - 150, 6)
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("member"), F.col("o_orderpriority").alias("dataset")).agg(price.alias("score"))


def _fitness(weighting: str, norms: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(evolve.weighted_fitness(_scores(spark, sf_dir), weighting, norms), 5)


PRIORITIES = {"1-URGENT": 2.0, "2-HIGH": 3.0, "3-MEDIUM": 4.0, "4-LOW": 5.0, "4-NOT SPECIFIED": 5.0, "5-LOW": 6.0}
for _weighting in evolve.WEIGHTINGS:
    QUERIES[f"fitness_{_weighting}"] = _fitness(_weighting, PRIORITIES)


@query
def diversity_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evolve.diversity(_bits(spark, sf_dir), "bits"))


@query
def diversity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector columns: the embedding's bits by a low and by a high threshold."""
    both = read_table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: (x > 0.15).cast("int")).alias("a"), F.transform("embedding", lambda x: (x > 0.3).cast("int")).alias("b"))
    return _rounded(evolve.diversity_score(both, ["a", "b"], 0.5))


@query
def primitive_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.primitive_pool(read_table(spark, sf_dir, "lipophilicity"), "smiles")


@query
def metric_stack_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric over one table: whether a discount is high, guessed and scored by quantity."""
    rows = read_table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), F.col("l_quantity").cast("double").alias("score"))
    return _rounded(metrics.MetricStack(tuple(metrics.DIRECTIONS)).calculate_all(rows))


@query
def split_nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda k: [F.col("event_id") % k == i for i in range(k)]
    return splits.nested_roles(read_table(spark, sf_dir, "events").select("event_id"), fold(2), [(F.col("event_id") / 2).cast("bigint") % 3 == i for i in range(3)])


@query
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"depth": search.Range(2, 8, 2, whole=True).values(), "trees": [10, 50, 100], "kind": ["a", "b"]}
    return search.grid_frame(spark, wanted).select(F.col("combination").cast("bigint"), F.col("depth").cast("bigint"), F.col("trees").cast("bigint"), "kind")


# models, jobs, evolution (no SQL equivalent)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = positions.dense_positions(read_table(spark, sf_dir, "embeddings"), ["vec_id"])
    roles = splits.by_shuffle(vectors, 1, 42, test_size=0.3)
    return vectors.join(roles.select("row_id", "role"), "row_id").withColumn("first", (F.col("label") >= 5).cast("int"))


@query
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return encoders.CentredPCA.fit(vectors, "embedding", 8).transform(vectors, "pca").select("vec_id", "pca")


def _eval(kind: str, label: str, names: tuple[str, ...], **parameters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: models.TrainEval(kind, "embedding", label, metrics.MetricStack(names), parameters).run(_vectors(spark, sf_dir))[2]


QUERIES["random_forest_eval"] = _eval("random_forest_classifier", "label", ("accuracy", "zero_one_loss"), n_estimators=10, max_depth=5, random_state=42)
QUERIES["gbt_eval"] = _eval("boosted_trees_classifier", "first", ("accuracy", "f1"), iterations=5, depth=3, random_state=42)
QUERIES["forest_regression_eval"] = _eval("random_forest_regressor", "label", ("r2", "mae"), n_estimators=10, max_depth=5, random_state=42)


@query
def grid_search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.prepared(_vectors(spark, sf_dir), "embedding", "label").persist()

    def run(parameters: dict, fold: DataFrame) -> float:
        model = models.estimator("linear_regression", **parameters).fit(fold.where("role = 'train'"))
        scored = model.transform(fold.where("role = 'test'")).withColumn("y", F.col("_y"))
        return metrics.MetricStack(("mse",)).calculate(scored).first()[0]

    _, tried = search.grid_search({"regParam": search.Choice((0.0, 0.1, 1.0)), "elasticNetParam": search.Choice((0.0, 1.0))}, [rows], run, "mse")
    rows.unpersist()
    return search.results_frame(spark, tried, "linear_regression", "mse")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.array(F.col(c).cast("double")).alias(n) for c, n in (("l_quantity", "by_quantity"), ("l_tax", "by_tax"))]
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), *columns)


@query
def job_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line fitted to half of the orders predicts the prices of all line items."""
    rows = _priced(spark, sf_dir)
    model = jobs.create("train", kind="linear_regression", features="by_quantity", label="price").run(rows.where("l_orderkey % 2 = 0")).model
    done = jobs.Runner().run([jobs.create("predict", model=model, features="by_quantity", column="guess")], rows)[0].predicted
    return done.select("l_orderkey", "price", F.round("guess", 3).alias("guess"))


@query
def grid_nested_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outer and two inner splits; which column and whether with an intercept, by the mean absolute error."""
    test = lambda n: [F.col("l_orderkey").cast("bigint") % (2 * n) < n, F.col("l_orderkey").cast("bigint") % (2 * n) >= n]
    searched = jobs.NestedSearch("linear_regression", "price", "mae", test(1), test(2))
    found = searched.run(_priced(spark, sf_dir), {"features": search.Choice(("by_quantity", "by_tax")), "fitIntercept": search.Choice((True, False))})
    return found.select("outer", "config", F.round("inner_mean", 4).alias("inner_mean"), F.round("outer_test", 4).alias("outer_test"), "best")


@query
def evolve_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    smiles = select.valid_values(read_table(spark, sf_dir, "lipophilicity"), "smiles").where("output_value IS NOT NULL AND NOT isnan(output_value)").persist()
    atoms = evolve.atoms_of(evolve.primitive_pool(smiles, "smiles"))
    found = evolve.Evolution(smiles, "smiles", atoms, evolve.mean_fitness(smiles, "smiles", "output_value"), size=6, population=8)
    best = found.run(2)
    smiles.unpersist()
    return evolve.population_frame(spark, 2, [best])


@query
def stream_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "stream")
    schema = read_table(spark, sf_dir, "events").schema
    stream = encode.read_stream(spark, f"{sf_dir}/events.parquet*", schema)
    encode.run_batches(encode.windowed_counts(stream), lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/state", "complete")
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
