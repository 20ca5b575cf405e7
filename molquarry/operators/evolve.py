"""Evolutionary search for pattern features (EV).

A pattern (gene) is a text with bonds between atoms, a genome a list of distinct patterns. The
population is small and stays on the driver; what touches the data is distributed: one aggregate
tells which of all new patterns are relevant, one groups the fitness of a whole generation.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.functions.tokens import regex_tokens
from molquarry.functions.values import is_value, signed_square

BONDS = ("-", "=", "#", ":")


@dataclass(frozen=True)
class Pattern:
    """Atoms joined by bonds: there is one bond less than atoms."""

    atoms: tuple[str, ...]
    bonds: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if len(self.bonds) != max(0, len(self.atoms) - 1):
            raise ValueError("a pattern has one bond less than atoms")

    def __len__(self) -> int:
        return len(self.atoms)

    def text(self) -> str:
        out = "".join(a + ("" if b == "-" else b) for a, b in zip(self.atoms, (*self.bonds, "")))
        return out

    def slice(self, start: int, end: int) -> Pattern:
        return Pattern(self.atoms[start : end + 1], self.bonds[start:end])


@dataclass
class Genome:
    genes: list[Pattern]
    fitness: float | None = field(default=None, compare=False)

    def __len__(self) -> int:
        return len(self.genes)

    def __add__(self, other: Genome) -> Genome:
        return Genome(self.genes + [g for g in other.genes if g not in self.genes])

    def covers(self, other: Genome) -> bool:
        return set(other.genes) <= set(self.genes)

    def id(self) -> str:
        return hashlib.md5("".join(sorted((g.text() for g in self.genes), reverse=True)).encode()).hexdigest()

    def texts(self) -> list[str]:
        return [g.text() for g in self.genes]


def random_pattern(atoms: list[str], longest: int, chance: random.Random) -> Pattern:
    n = chance.randint(1, max(1, longest))
    return Pattern(tuple(chance.choice(atoms) for _ in range(n)), tuple(chance.choice(BONDS) for _ in range(n - 1)))


def cross(father: Pattern, mother: Pattern, chance: random.Random) -> Pattern:
    """A slice of each parent; the bond between them follows the first slice in its parent, or is a
    random one where that slice reaches the parent's end."""
    a, b = (father, mother) if chance.random() >= 0.5 else (mother, father)
    ends = []
    for parent in (a, b):
        start = chance.randrange(len(parent))
        ends.append((start, chance.randrange(start, len(parent))))
    first, second = a.slice(*ends[0]), b.slice(*ends[1])
    bond = a.bonds[ends[0][1]] if ends[0][1] < len(a) - 1 else chance.choice(BONDS)
    return Pattern(first.atoms + second.atoms, (*first.bonds, bond, *second.bonds))


def _counted(df: DataFrame, column: str, patterns: list[str], *keep) -> DataFrame:
    """(pos, n, keep...): the occurrences of every pattern in every row. One short plan however many
    patterns there are; what follows is pre-aggregated by pattern before it is shuffled."""
    text = F.coalesce(F.col(column), F.lit(""))
    every = F.array(*(F.lit(p) for p in patterns))
    counts = F.transform(every, lambda p: ((F.length(text) - F.length(F.replace(text, p, F.lit("")))) / F.length(p)).cast("int"))
    return df.select(*keep, F.posexplode(counts).alias("pos", "n"))


def relevant(df: DataFrame, column: str, patterns: list[str]) -> list[str]:
    """The patterns whose number of occurrences differs between rows: all in one aggregate."""
    if not patterns:
        return []
    spread = _counted(df, column, patterns).groupBy("pos").agg((F.min("n") != F.max("n")).alias("differs"))
    good = {r["pos"] for r in spread.where("differs").collect()}
    return [p for i, p in enumerate(patterns) if i in good]


def diversity(df: DataFrame, vector: str) -> DataFrame:
    """(collisions, diversity): ordered pairs of rows that agree, summed over positions, with each row
    once against itself, over (rows)^2. Counts by position and value take the place of pairs."""
    cells = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos", "x").agg(F.count(F.lit(1)).alias("k"))
    pairs = F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("bigint")
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    found = cells.agg(pairs.alias("pairs")).join(F.broadcast(rows))
    return found.select((2 * F.col("pairs") + F.col("n")).alias("collisions"), ((2 * F.col("pairs") + F.col("n")) / (F.col("n") * F.col("n")).cast("double")).alias("diversity"))


def diversity_score(df: DataFrame, vectors: list[str], target: float) -> DataFrame:
    """(collisions, ratio, score): as diversity() over the vectors of several columns; each column adds its
    own collisions and one of each row with itself, the ratio is over (rows x columns)^2, and
    the score says how near the ratio comes to the target."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(v).alias("v")) for i, v in enumerate(vectors)))).alias("e")
    cells = df.select(each).select("e.c", F.posexplode("e.v").alias("pos", "x")).groupBy("c", "pos", "x").agg(F.count(F.lit(1)).alias("k"))
    pairs = F.sum(F.col("k") * (F.col("k") - 1)).cast("bigint")
    rows = df.agg((F.count(F.lit(1)) * len(vectors)).alias("n"))
    found = cells.agg(pairs.alias("pairs")).join(F.broadcast(rows)).select((F.coalesce("pairs", F.lit(0)) + F.col("n")).alias("collisions"), "n")
    ratio = F.try_divide(F.col("collisions").cast("double"), F.col("n").cast("double") * F.col("n"))
    return found.select("collisions", ratio.alias("ratio"), (1 - F.abs(ratio - F.lit(target))).alias("score"))


def primitive_pool(df: DataFrame, column: str) -> DataFrame:
    """(primitive, kind, rows, least, most, relevant): what patterns can be made of, from the data: every token
    of the line notations with the number of rows that hold it, its least and most occurrences in a
    row, and whether these differ. Atoms are kept in any case, other tokens where they are relevant.
    Counts are taken within rows before they are shuffled; nulls and missing values are left out."""
    text = df.where(is_value(column)).select(regex_tokens(F.col(column)).alias("t"))
    total = text.agg(F.count(F.lit(1)).alias("n"))
    distinct = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("primitive"), F.size(F.filter("t", lambda x: x == w)).alias("k")))
    counted = text.select(F.explode(distinct).alias("x")).select("x.*").groupBy("primitive").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("most"))
    least = F.when(F.col("rows") < F.col("n"), F.lit(0)).otherwise(F.col("low"))
    atom = F.col("primitive").rlike(r"^(\[.+\]|[A-Za-z]{1,2})$")
    out = counted.join(F.broadcast(total)).select("primitive", F.when(atom, "atom").otherwise("other").alias("kind"), "rows", least.alias("least"), "most", (least != F.col("most")).alias("relevant"))
    return out.where((F.col("kind") == "atom") | F.col("relevant"))


def atoms_of(pool: DataFrame) -> list[str]:
    """The atoms of a pool, the most common first: a vocabulary, not data."""
    return [r["primitive"] for r in pool.where("kind = 'atom'").orderBy(F.desc("rows"), "primitive").limit(1_000).collect()]


def subset_pairs(df: DataFrame, genome: str, gene: str) -> DataFrame:
    """(genome, other): pairs of genomes of which one's genes are all among the other's. Genomes meet by a
    shared gene; counts of shared genes are compared with sizes, nothing is listed."""
    cells = df.where(F.col(genome).isNotNull() & F.col(gene).isNotNull()).select(genome, gene).distinct()
    sizes = cells.groupBy(genome).agg(F.count(F.lit(1)).alias("_n"))
    met = cells.join(cells.withColumnRenamed(genome, "other"), gene).where(F.col(genome) != F.col("other"))
    shared = met.groupBy(genome, "other").agg(F.count(F.lit(1)).alias("_shared"))
    return shared.join(sizes, genome).where("_shared = _n").select(genome, "other")


WEIGHTINGS = ("average", "average_pow", "norm_max", "norm_max_pow", "norm_asList", "norm_asList_pow")


def weighted_fitness(scores: DataFrame, weighting: str, norms: dict[str, float] | None = None, member: str = "member", dataset: str = "dataset", score: str = "score") -> DataFrame:
    """(member, fitness) of scores by member and dataset: means of the scores, of their signed squares,
    or of either after division by the dataset's largest score (1 where that isn't positive) or by
    given norms."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"no weighting {weighting}")
    value = F.col(score).cast("double")
    if weighting.startswith("norm_max"):
        top = scores.groupBy(dataset).agg(F.max(score).alias("_top"))
        scores = scores.join(top, dataset)
        value = value / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    elif weighting.startswith("norm_asList"):
        if not norms:
            raise ValueError("norms are needed")
        table = F.create_map(*(v for k, n in norms.items() for v in (F.lit(k), F.lit(float(n)))))
        value = value / F.element_at(table, F.col(dataset))
    if weighting.endswith("_pow"):
        value = signed_square(value)
    return scores.groupBy(member).agg(F.avg(value).alias("fitness"))


def generation_sizes(population: int, keep: float, new: float, parents: float) -> tuple[int, int, int, int]:
    """(kept, new, children, parents) of the next generation."""
    kept, fresh = int(population * keep), int(population * new)
    return kept, fresh, population - kept - fresh, max(2, int(population * parents))


@dataclass
class Evolution:
    """The search. fitness maps a generation of genomes to their numbers (larger is better)."""

    df: DataFrame
    column: str
    atoms: list[str]
    fitness: Callable[[list[Genome]], list[float]]
    size: int = 8
    population: int = 10
    longest: int = 3
    keep: float = 0.2
    new: float = 0.2
    parents: float = 0.5
    recombination: float = 0.6
    new_gene: float = 0.2
    aging: float = 0.0
    seed: int = 42

    def __post_init__(self) -> None:
        self.chance = random.Random(self.seed)
        self.known: dict[str, bool] = {}
        self.pool: list[Pattern] = []

    def fresh(self, n: int) -> list[Pattern]:
        """n relevant random patterns; candidates are tested in batches."""
        for _ in range(20):
            if len(self.pool) >= n:
                break
            drawn = {p.text(): p for p in (random_pattern(self.atoms, self.longest, self.chance) for _ in range(4 * n + 20))}
            self.check([t for t in drawn])
            self.pool += [p for t, p in drawn.items() if self.known[t] and p not in self.pool]
        out, self.pool = self.pool[:n], self.pool[n:]
        return out

    def check(self, texts: list[str]) -> None:
        unknown = [t for t in dict.fromkeys(texts) if t not in self.known]
        good = set(relevant(self.df, self.column, unknown))
        self.known.update({t: t in good for t in unknown})

    def start(self) -> list[Genome]:
        return [Genome(self.fresh(self.size)) for _ in range(self.population)]

    def child(self, father: Genome, mother: Genome) -> list[tuple[Pattern | None, Pattern]]:
        """(wanted gene or None for a new one, the gene to fall back on) for each place."""
        a, b = father.genes[:], mother.genes[:]
        self.chance.shuffle(a)
        self.chance.shuffle(b)
        out = []
        for x, y in zip(a, b):
            u = self.chance.random()
            if u <= self.recombination:
                out.append((cross(x, y, self.chance), x))
            elif u >= self.recombination + self.new_gene:
                out.append((self.chance.choice((x, y)), x))
            else:
                out.append((None, x))
        return out

    def step(self, ranked: list[Genome]) -> list[Genome]:
        kept, fresh, children, parents = generation_sizes(self.population, self.keep, self.new, self.parents)
        drafts = []
        for _ in range(children):
            i, j = self.chance.sample(range(min(parents, len(ranked))), 2)
            drafts.append(self.child(ranked[i], ranked[j]))
        self.check([g.text() for d in drafts for g, _ in d if g])
        out = [Genome(g.genes[:], g.fitness) for g in ranked[:kept]]
        for g in out:
            for k in range(len(g)):
                if self.chance.random() < self.aging and (new := self.fresh(1)):
                    g.genes[k], g.fitness = new[0], None
        for d in drafts:
            genes: list[Pattern] = []
            for gene, other in d:
                for option in (gene if gene and self.known.get(gene.text()) else None, other):
                    if option and option not in genes:
                        genes.append(option)
                        break
                else:
                    genes += [p for p in self.fresh(1) if p not in genes]
            out.append(Genome(genes))
        return out + [Genome(self.fresh(self.size)) for _ in range(fresh)]

    def run(self, steps: int, population: list[Genome] | None = None, save: Callable[[int, list[Genome]], None] | None = None) -> Genome:
        """The best genome; a saved population resumes the search."""
        people = population or self.start()
        for step in range(steps + 1):
            open_ = [g for g in people if g.fitness is None]
            for g, value in zip(open_, self.fitness(open_) if open_ else []):
                g.fitness = value
            people.sort(key=lambda g: -g.fitness)
            if save:
                save(step, people)
            if step < steps:
                people = self.step(people)
        return people[0]


def mean_fitness(df: DataFrame, column: str, target: str) -> Callable[[list[Genome]], list[float]]:
    """A fitness of one aggregate a generation: the largest absolute correlation of a genome's pattern
    counts with the target, averaged over its genes."""

    def measure(genomes: list[Genome]) -> list[float]:
        texts = sorted({t for g in genomes for t in g.texts()})
        if not texts:
            return [0.0] * len(genomes)
        counted = _counted(df, column, texts, F.col(target).cast("double").alias("y"))
        row = {r["pos"]: r["c"] for r in counted.groupBy("pos").agg(F.corr(F.col("n").cast("double"), "y").alias("c")).collect()}
        value = {t: abs(v) if (v := row.get(i)) is not None and v == v else 0.0 for i, t in enumerate(texts)}
        return [sum(value[t] for t in g.texts()) / max(1, len(g)) for g in genomes]

    return measure


def population_frame(spark, step: int, people: list[Genome]) -> DataFrame:
    """(step, member, gene_idx, gene, fitness) for saving."""
    rows = [(step, m, i, t, g.fitness) for m, g in enumerate(people) for i, t in enumerate(g.texts())]
    return spark.createDataFrame(rows, "step int, member int, gene_idx int, gene string, fitness double")


def save_step(spark, folder: str, step: int, people: list[Genome]) -> None:
    """One folder a step, written whole or not at all."""
    population_frame(spark, step, people).coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={step}")


def newest_step(spark, folder: str) -> tuple[int, list[Genome]] | None:
    """(step, members in their order) of the newest saved step, None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.option("basePath", folder).schema("step int, member int, gene_idx int, gene string, fitness double").parquet(folder)
        last = held.agg(F.max("step")).first()[0]
    except AnalysisException:
        return None
    if last is None:
        return None
    members: dict[int, list] = {}
    for r in held.where(F.col("step") == last).orderBy("member", "gene_idx").collect():
        members.setdefault(r["member"], []).append((r["gene"], r["fitness"]))
    return last, [Genome([read_pattern(g) for g, _ in genes], genes[0][1]) for _, genes in sorted(members.items())]


def read_pattern(text: str) -> Pattern:
    """The pattern of a text as Pattern.text() writes it."""
    atoms, bonds, at = [], [], 0
    while at < len(text):
        if atoms:
            bonds.append(text[at] if text[at] in BONDS else "-")
            at += text[at] in BONDS
        found = re.match(r"\[[^\]]+\]|Br|Cl|.", text[at:])
        if not found:
            raise ValueError(f"no pattern: {text}")
        atoms.append(found.group())
        at += found.end()
    return Pattern(tuple(atoms), tuple(bonds))


def resumed(search: Evolution, spark, folder: str, steps: int) -> Genome:
    """Run to `steps` in all, from the newest saved step where there is one; every step is saved."""
    found = newest_step(spark, folder)
    start = found[0] if found else 0
    return search.run(max(0, steps - start), found[1] if found else None, lambda step, people: save_step(spark, folder, start + step, people))


def model_fitness(df: DataFrame, column: str, target: str, splits: list, metric: str = "mae") -> Callable[[list[Genome]], list[float]]:
    """A fitness by a model: each genome is encoded, a linear model is fit on the training rows of each
    split (predicates that say which rows are test rows), and the metric's mean over the splits is
    taken, negative where less is better. A genome whose model fails has 0."""
    from molquarry.operators.metrics import DIRECTIONS, LOWER, ONE, MetricStack
    from molquarry.operators.models import TrainEval

    def measure(genomes: list[Genome]) -> list[float]:
        out = []
        for genome in genomes:
            coded = encode_genome(df, column, genome, match=False, name="_features")
            try:
                job = TrainEval("linear_regression", "_features", target, MetricStack((metric,)))
                values = [job.run(coded.withColumn("role", F.when(test, "test").otherwise("train")))[2].where("role = 'test'").first()[metric] for test in splits]
                mean = sum(values) / len(values)
            except Exception:  # what a model raises is its library's choice
                out.append(0.0)
                continue
            direction = DIRECTIONS[metric]
            out.append(-mean if direction == LOWER else -abs(1 - mean) if direction == ONE else mean)
        return out

    return measure


def best_members(population: DataFrame, n: int) -> DataFrame:
    ranked = population.select("member", "fitness").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc("fitness"), "member")))
    return ranked.where(F.col("r") <= n).drop("r")


def load_patterns(spark, path: str) -> list[str]:
    """The first column of a CSV without header, in file order (a genome is a small list)."""
    return [r[0] for r in spark.read.csv(path).select("_c0").collect() if r[0]]


def encode_genome(df: DataFrame, column: str, genome: Genome, match: bool = True, name: str = "features") -> DataFrame:
    """df with one number for each gene: whether, or how often, its text occurs."""
    from molquarry.operators.encoders import pattern_counts

    return pattern_counts(df, column, genome.texts(), match, name)
