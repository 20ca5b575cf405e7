"""Clusters of similar records by Markov clustering of their values (p6).

Two values are similar if their sets of 3-character substrings share at least a third of their
union. Markov clustering squares the column-stochastic matrix of the similarity graph, raises its
entries to a power, normalises them (inflation) and drops small ones until nothing changes; rows
that still hold flow are attractors, and a column belongs to the attractor of its largest entry.

Membership is found by contraction:
1. the distinct values of a field are dealt to shards of about SHARD_VALUES; each shard clusters the
   graph of all its similar pairs in memory (no pair leaves the task) and contracts each cluster to
   its attractor;
2. attractors are values themselves: they are dealt to shards and clustered again, until one shard
   holds all those of a field (or a level no longer halves them);
3. links that are left: a value can only be similar to a member of another cluster if it shares
   enough substrings with the union of that cluster. Values that pass this bound meet only those
   of the other cluster that pass it in turn, and the exact test yields one link for a pair of clusters;
4. the graph of clusters and links is clustered and contracted again until no link is left.
No step lists the pairs of a cluster, and every similar pair ends in one cluster.

The flow of a value (how typical it is) is that of Markov clustering of all similar pairs of its
final cluster: one task squares a cluster of at most BLOCK_VALUES values as a dense matrix; a larger
one is squared by joins on the middle index, with the same results.

Defined results: a missing value belongs to no cluster; a value of fewer than 3 characters has no
substrings and is similar to none but itself; repeated rows are members of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm import compounds
from molquarry.llm.components import components
from molquarry.session import cut, parallelism

GRAM = 3
#: shared / union >= 1 / 3, as shared * RATIO >= the sum of both sizes
RATIO = 4
#: values of a shard, about; no more than one task squares as a dense matrix
SHARD_VALUES = 2_000
INFLATION = 2.0
#: values of a component that one task squares as a dense matrix (32 MB)
BLOCK_VALUES = 2_000
#: substrings of cluster unions that one task holds (32 MB)
UNION_GRAMS = 2_000_000
#: values of one side of a meeting of two clusters
MEET_VALUES = 4_000
#: entries below this share of a column are dropped; a round that changes none by more is the last
NEGLIGIBLE = 1e-9
#: decimals of an entry, so that rounding errors don't grow from round to round and part equal values
DECIMALS = 12
#: decimals by which the attractors of a column are compared, so that equal ones tie
TIE_DECIMALS = 6
MAX_ROUNDS = 100
TYPICAL = 3


def gram_rows(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, gram): the distinct substrings of value i, as numbers in ascending order, are
    gram[start[i]:start[i + 1]]. Three code points of 21 bits make a number, so none clash."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(values)), size)
    begin = np.arange(max(0, len(codes) - GRAM + 1))
    begin = begin[owner[begin] == owner[begin + GRAM - 1]] if len(begin) else begin
    owner, gram = owner[begin], np.zeros(len(begin), np.int64)
    for k in range(GRAM):
        gram = (gram << 21) | codes[begin + k]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram = owner[new], gram[new]
    return np.searchsorted(owner, np.arange(len(values) + 1)), gram


def similar(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(i, j, similarity) of all similar pairs, each once, and a spanning forest of them, between left
    and right (numbered after left), or within left where right is None."""
    start, gram = gram_rows(left + (right or []))
    number = np.unique(gram, return_inverse=True)[1]
    first = 0 if right is None else len(left)
    shift, n = first, len(start) - 1 - first
    size = np.diff(start)[first:]
    low = start[first]
    member = np.repeat(np.arange(n), size)[np.argsort(number[low:], kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(number[low:], minlength=int(number.max(initial=-1)) + 1))])
    forest, edges = compounds._Forest(len(start) - 1), []
    label = np.arange(n)  # of the right side, as last looked up
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(left)):
        grams = number[start[i] : start[i + 1]]
        if not len(grams) or not n:
            continue
        shared = np.bincount(np.concatenate([member[a:b] for a, b in zip(edge[grams].tolist(), edge[grams + 1].tolist())]), minlength=n)
        hit = np.flatnonzero((RATIO * shared >= len(grams) + size) & (size > 0))
        if right is None:
            hit = hit[hit != i]
        if not len(hit):
            continue
        once = hit[hit > i] if right is None else hit
        found.append((np.full(len(once), i, np.int32), (once + shift).astype(np.int32), shared[once] / (len(grams) + size[once] - shared[once])))
        # one member of each class met so far is enough to link
        for at in np.unique(label[hit], return_index=True)[1]:
            j = int(hit[at]) + shift
            if forest.join(i, j):
                edges.append((i, j))
        if i % 64 == 63:
            roots = [forest.find(j + shift) for j in range(n)]
            label = np.unique(roots, return_inverse=True)[1]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), edges
    a, b, likeness = (np.concatenate(x) for x in zip(*found))
    return a, b, likeness, edges


def similarity_links(values: DataFrame, shard_values: int = 2 * SHARD_VALUES) -> DataFrame:
    """(a, b, likeness, forest): forest rows connect all similar pairs; the others are these pairs, each
    once, as the joins on the middle index need them. values: (id, field, value), materialised."""
    counts = {r["field"]: r["n"] for r in values.groupBy("field").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for field, n in counts.items():
        shards = F.when(F.col("field") == field, F.lit(max(1, -(-n // shard_values)))).otherwise(shards)
    dealt = values.withColumn("shards", shards).withColumn("own", F.pmod(F.xxhash64("id", F.lit(11)), F.col("shards")).cast("bigint"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: F.struct(F.least(s.cast("bigint"), "own").alias("i"), F.greatest(s.cast("bigint"), "own").alias("j"))))
    roles = dealt.select("field", "id", "value", "own", meet.alias("m")).select("field", "id", "value", "own", "m.i", "m.j")

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rows = sorted(zip(table["own"].to_pylist(), table["id"].to_pylist(), table["value"].to_pylist()))
        left = [(k, v) for own, k, v in rows if own == i]
        right = None if i == j else [(k, v) for own, k, v in rows if own == j]
        ids = np.array([k for k, _ in left + (right or [])], np.int64)
        if not left or right == []:
            a = b = np.empty(0, np.int64)
            likeness, edges = np.empty(0), []
        else:
            a, b, likeness, edges = similar([v for _, v in left], None if right is None else [v for _, v in right])
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "a": pa.array(ids[np.concatenate([ends[:, 0], a])], pa.int64()),
            "b": pa.array(ids[np.concatenate([ends[:, 1], b])], pa.int64()),
            "likeness": pa.array(np.concatenate([np.zeros(len(ends)), likeness]), pa.float64()),
            "forest": pa.array(np.concatenate([np.ones(len(ends), bool), np.zeros(len(a), bool)])),
        })

    return roles.groupBy("field", "i", "j").applyInArrow(run, "a bigint, b bigint, likeness double, forest boolean")


def _inflate(w: np.ndarray, inflation: float) -> np.ndarray:
    """Columns raised to a power and normalised, without what no result shows."""
    w = w**inflation
    w /= w.sum(axis=0)
    w[w < NEGLIGIBLE] = 0
    return np.round(w / w.sum(axis=0), DECIMALS)


def settled(a: np.ndarray, b: np.ndarray, likeness: np.ndarray, inflation: float = INFLATION, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, limit) of Markov clustering of the undirected edges a, b as one dense matrix, whose
    column j is that of node j."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    w = np.eye(len(nodes))
    np.maximum.at(w, (i, j), likeness)
    w = np.maximum(w, w.T)
    w /= w.sum(axis=0)
    for _ in range(rounds):
        before, w = w, _inflate(w @ w, inflation)
        if np.abs(w - before).max() <= NEGLIGIBLE:
            return nodes, w
    raise RuntimeError(f"unsettled Markov columns after {rounds} rounds")


def _normalised(entries: DataFrame) -> DataFrame:
    total = entries.groupBy("k").agg(F.sum("w").alias("total"))
    return entries.join(total, "k").select("k", "i", (F.col("w") / F.col("total")).alias("w"))


def settled_by_joins(edges: DataFrame, inflation: float = INFLATION, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(k, i, w): the entries of the limit as of settled(), by a join on the middle index a round."""
    both = edges.select("a", "b", "likeness").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    loops = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("likeness"))
    first = both.unionByName(loops).groupBy("a", "b").agg(F.max("likeness").alias("w"))
    entries = cut(_normalised(first.select(F.col("a").alias("k"), F.col("b").alias("i"), "w")))
    for _ in range(rounds):
        inner = entries.select(F.col("k").alias("m"), "i", F.col("w").alias("g"))
        met = entries.select("k", F.col("i").alias("m"), F.col("w").alias("f")).join(inner, "m")
        power = met.groupBy("k", "i").agg(F.pow(F.sum(F.col("f") * F.col("g")), F.lit(inflation)).alias("w"))
        kept = _normalised(_normalised(power).where(F.col("w") >= NEGLIGIBLE))
        before, entries = entries, cut(kept.withColumn("w", F.round("w", DECIMALS)))
        both_rounds = entries.join(before.withColumnRenamed("w", "was"), ["k", "i"], "full")
        change = both_rounds.agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        if change is None or change <= NEGLIGIBLE:
            return entries
    raise RuntimeError(f"unsettled Markov columns after {rounds} rounds")


COLUMNS = "k bigint, i array<bigint>, w array<double>"


def markov(graph: DataFrame, inflation: float = INFLATION, rounds: int = MAX_ROUNDS, classes: DataFrame | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The limit of Markov clustering of any undirected graph (a, b, likeness): (k, i, w), the column of
    every node. classes: (node, component) of the graph, if known, materialised."""
    classes = cut(components(graph)) if classes is None else classes
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
    edges = graph.join(classes.join(sizes, "component"), F.col("a") == F.col("node")).select("component", "size", "a", "b", "likeness")

    def run(table: pa.Table) -> pa.Table:
        nodes, w = settled(table["a"].to_numpy(), table["b"].to_numpy(), table["likeness"].to_numpy(), inflation, rounds)
        k, i = np.nonzero(w.T)
        offsets = pa.array(np.searchsorted(k, np.arange(len(nodes) + 1)), pa.int32())
        rows = pa.ListArray.from_arrays(offsets, pa.array(nodes[i], pa.int64()))
        return pa.table({"k": pa.array(nodes, pa.int64()), "i": rows, "w": pa.ListArray.from_arrays(offsets, pa.array(w[i, k], pa.float64()))})

    columns = edges.where(F.col("size") <= block_values).select("component", "a", "b", "likeness").groupBy("component").applyInArrow(run, COLUMNS)
    if sizes.where(F.col("size") > block_values).limit(1).count():
        entries = settled_by_joins(edges.where(F.col("size") > block_values), inflation, rounds)
        listed = entries.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("e"))
        columns = columns.unionByName(listed.select("k", F.col("e.i").alias("i"), F.col("e.w").alias("w")))
    return columns


def attractors(n: int, a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """For each of n nodes the attractor that Markov clustering of the edges leads it to: nodes of
    one attractor system share the one of most flow (ties: the first). A node without an edge is
    its own. No flow leaves a connected part, so each is a matrix of its own."""
    parts, systems = compounds._Forest(n), compounds._Forest(n)
    for i, j in zip(a.tolist(), b.tolist()):
        parts.join(i, j)
    part, flow = parts.labels(), np.zeros(n)
    order = np.argsort(part[a], kind="stable")
    for chunk in np.split(order, np.flatnonzero(np.diff(part[a][order])) + 1):
        if len(chunk):
            nodes, w = settled(a[chunk], b[chunk], likeness[chunk])
            flow[nodes] = w.sum(axis=1)
            for node, pulled in zip(nodes.tolist(), nodes[np.round(w, TIE_DECIMALS).argmax(axis=0)].tolist()):
                systems.join(node, pulled)
    label = systems.labels()
    order = np.lexsort((np.arange(n), -np.round(flow, TIE_DECIMALS), label))
    first = order[np.concatenate([[True], np.diff(label[order]) != 0])] if n else order
    strongest = np.zeros(n, np.int64)
    strongest[label[first]] = first
    return strongest[label]


def strongest_links(a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unordered pair of different ends once, with its largest likeness."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((-likeness, high, low))
    low, high, likeness = low[order], high[order], likeness[order]
    keep = (low != high) & np.concatenate([[True], (np.diff(low) != 0) | (np.diff(high) != 0)]) if len(low) else np.empty(0, bool)
    return low[keep], high[keep], likeness[keep]


def contracted(a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, label): Markov clustering of a graph, contracted and clustered again until no link is left."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        step = attractors(len(nodes), a, b, likeness)
        if (step[a] == a).all() and (step[b] == b).all():
            # no cluster holds a linked pair: each node follows its least neighbour instead
            np.minimum.at(step, a, b)
            np.minimum.at(step, b, a)
        label = step[label]
        a, b, likeness = strongest_links(step[a], step[b], likeness)
    return nodes, nodes[label]


def contracted_by_joins(links: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, label) as of contracted(), for graphs of any size: every round is one clustering by joins."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = cut(ends.select("node", F.col("node").alias("label")))
    links = cut(links.select("a", "b", "likeness").where("a <> b"))
    for _ in range(rounds):
        if not links.limit(1).count():
            return held
        entries = settled_by_joins(links)
        pulled = F.max(F.struct(F.round("w", TIE_DECIMALS).alias("w"), (-F.col("i")).alias("i")))
        step = cut(entries.groupBy("k").agg((-pulled["i"]).alias("to")))
        if not step.where("k <> to").limit(1).count():
            both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = cut(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("b")).select("k", F.least("k", "b").alias("to")))
        held = cut(held.join(step, F.col("label") == F.col("k"), "left").select("node", F.coalesce("to", "label").alias("label")))
        left, right = step.select(F.col("k").alias("a"), F.col("to").alias("x")), step.select(F.col("k").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        links = cut(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("likeness").alias("likeness")))
    raise RuntimeError(f"links are left after {rounds} contractions")


def contract(links: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(node, label) of the nodes of links (a, b, likeness), materialised. One task contracts a graph of
    few nodes; a larger one goes by joins, with clusters of the same connected values in the end."""
    links = cut(links)
    if links.select(F.explode(F.array("a", "b")).alias("node")).distinct().limit(block_values + 1).count() > block_values:
        return contracted_by_joins(links)

    def run(table: pa.Table) -> pa.Table:
        nodes, label = contracted(table["a"].to_numpy(), table["b"].to_numpy(), table["likeness"].to_numpy())
        return pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(label, pa.int64())})

    few = links.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))  # at most one row a pair of nodes
    return cut(few.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(run, "node bigint, label bigint"))


# one row a value (id, value, label), a union of a cluster (label, grams, least) or a link (label, other, likeness)
SHARD = "field string, id bigint, value string, label bigint, other bigint, likeness double, grams array<bigint>, least int"


def cluster_shards(values: DataFrame, shards: dict[str, int]) -> DataFrame:
    """Markov clustering of (field, id, value), shard by shard; see SHARD for the rows."""
    dealt = values.select("field", "id", "value", _dealt(shards).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        field = table["field"][0].as_py()
        rows = sorted(zip(table["id"].to_pylist(), table["value"].to_pylist()))
        ids, texts = np.array([k for k, _ in rows], np.int64), [v for _, v in rows]
        a, b, likeness, _ = similar(texts, None)
        label = attractors(len(texts), a, b, likeness)
        low, high, best = strongest_links(label[a], label[b], likeness)
        start, gram = gram_rows(texts)
        owner = np.repeat(label, np.diff(start))
        cell = np.unique(np.stack([owner, gram]), axis=1) if len(gram) else np.empty((2, 0), np.int64)
        held, first = np.unique(cell[0], return_index=True)
        least = np.full(len(texts), np.iinfo(np.int32).max, np.int64)
        size = np.diff(start)
        np.minimum.at(least, label[size > 0], size[size > 0])
        grams = pa.ListArray.from_arrays(pa.array(np.append(first, cell.shape[1]), pa.int32()), pa.array(cell[1], pa.int64()))
        n, m, k = len(texts), len(held), len(low)
        none = pa.nulls
        return pa.table({
            "field": pa.array([field] * (n + m + k), pa.string()),
            "id": pa.concat_arrays([pa.array(ids), none(m + k, pa.int64())]),
            "value": pa.concat_arrays([pa.array(texts, pa.string()), none(m + k, pa.string())]),
            "label": pa.array(ids[np.concatenate([label, held, low])], pa.int64()),
            "other": pa.concat_arrays([none(n + m, pa.int64()), pa.array(ids[high], pa.int64())]),
            "likeness": pa.concat_arrays([none(n + m, pa.float64()), pa.array(best, pa.float64())]),
            "grams": pa.concat_arrays([none(n, pa.list_(pa.int64())), grams, none(k, pa.list_(pa.int64()))]),
            "least": pa.concat_arrays([none(n, pa.int32()), pa.array(least[held], pa.int32()), none(k, pa.int32())]),
        })

    # the work of a shard lies in its pairs, not its bytes, so partitions must not be merged by size
    return dealt.repartition(2 * max(1, sum(shards.values())), "field", "shard").groupBy("field", "shard").applyInArrow(run, SHARD)


def _dealt(shards: dict[str, int]):
    """The shard of a row by its field and id."""
    count = F.lit(1)
    for field, n in shards.items():
        count = F.when(F.col("field") == field, F.lit(n)).otherwise(count)
    return F.pmod(F.xxhash64("id", F.lit(11)), count).cast("bigint")


def _shards(rows: DataFrame, size: int) -> dict[str, int]:
    return {r["field"]: max(1, -(-r["n"] // size)) for r in rows.groupBy("field").agg(F.count("*").alias("n")).collect()}


def open_values(values: DataFrame, unions: DataFrame, shard_values: int = SHARD_VALUES, union_grams: int = UNION_GRAMS) -> DataFrame:
    """(field, id, value, label, other): values that may be similar to a member of the cluster `other`,
    by the substrings shared with its union. values: (field, id, value, label), unions: (field, label,
    grams, least), both materialised. Unions beyond union_grams go to blocks that every shard meets."""
    shards = _shards(values, shard_values)
    blocks = {r["field"]: max(1, -(-r["n"] // union_grams)) for r in unions.groupBy("field").agg(F.sum(F.size("grams")).alias("n")).collect()}

    def by_field(counts: dict[str, int]):
        out = F.lit(1)
        for field, n in counts.items():
            out = F.when(F.col("field") == field, F.lit(n)).otherwise(out)
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"field": pa.string(), "id": pa.int64(), "value": pa.string(), "label": pa.int64(), "other": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in empty.items()})
        ids, texts, label = left["id"].to_numpy(), left["value"].to_pylist(), left["label"].to_numpy()
        clusters, least = right["label"].to_numpy(), right["least"].to_numpy().astype(np.int64)
        lists = right["grams"].combine_chunks()
        owner = np.repeat(np.arange(len(clusters)), lists.value_lengths().to_numpy())
        known, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = owner[np.argsort(at, kind="stable")]
        edge = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))])
        start, gram = gram_rows(texts)
        size = np.diff(start)
        value = np.repeat(np.arange(len(texts)), size)
        place = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        hit = known[place] == gram
        value, place = value[hit], place[hit]
        out, step = [], max(1, 4_000_000 // len(clusters))
        for low in range(0, len(texts), step):
            mine = slice(*np.searchsorted(value, [low, low + step]))
            n = edge[place[mine] + 1] - edge[place[mine]]
            met = owner[np.repeat(edge[place[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            rows = min(step, len(texts) - low)
            shared = np.bincount(np.repeat(value[mine] - low, n) * len(clusters) + met, minlength=rows * len(clusters)).reshape(rows, -1)
            i, c = np.nonzero((RATIO * shared >= size[low : low + rows, None] + least[None, :]) & (clusters[None, :] != label[low : low + rows, None]))
            out.append((i + low, c))
        i, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({
            "field": left["field"].take(pa.array(i)), "id": pa.array(ids[i], pa.int64()), "value": pa.array([texts[k] for k in i.tolist()], pa.string()),
            "label": pa.array(label[i], pa.int64()), "other": pa.array(clusters[c], pa.int64()),
        })

    every = lambda counts: F.explode(F.sequence(F.lit(0), by_field(counts) - 1).cast("array<bigint>"))
    rows = values.select("field", "id", "value", "label", _dealt(shards).alias("shard"), every(blocks).alias("block"))
    sets = unions.select("field", "label", "grams", "least", every(shards).alias("shard"), F.pmod(F.xxhash64("label"), by_field(blocks)).cast("bigint").alias("block"))
    by = ["field", "shard", "block"]
    return rows.groupBy(*by).cogroup(sets.groupBy(*by)).applyInArrow(run, "field string, id bigint, value string, label bigint, other bigint")


def links_between(opened: DataFrame, meet_values: int = MEET_VALUES) -> DataFrame:
    """(a, b, likeness): one link for each pair of clusters that holds a similar pair, from the values of
    either that open_values names for the other. opened must be materialised. Sides of more than
    meet_values are cut into blocks that meet each other."""
    paired = opened.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b"), (F.col("label") > F.col("other")).alias("side"), "id", "value")
    counts = paired.groupBy("a", "b").agg(F.count_if(~F.col("side")).alias("m"), F.count_if(F.col("side")).alias("n"))
    counts = cut(counts.where("m > 0 AND n > 0").select("a", "b", F.ceil(F.col("m") / meet_values).cast("int").alias("mb"), F.ceil(F.col("n") / meet_values).cast("int").alias("nb")))
    sized = compounds.checked_join(paired, counts, ["a", "b"], "id")
    own = F.pmod(F.xxhash64("id", F.lit(13)), F.when(F.col("side"), F.col("nb")).otherwise(F.col("mb"))).cast("int")
    facing = F.explode(F.sequence(F.lit(0), F.when(F.col("side"), F.col("mb")).otherwise(F.col("nb")) - 1))
    met = sized.select("a", "b", "side", "id", "value", own.alias("own"), facing.alias("facing"))
    met = met.select("a", "b", "side", "id", "value", F.when(F.col("side"), F.col("facing")).otherwise(F.col("own")).alias("i"), F.when(F.col("side"), F.col("own")).otherwise(F.col("facing")).alias("j"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["side"].to_pylist(), table["id"].to_pylist(), table["value"].to_pylist()))
        left, right = [v for side, _, v in rows if not side], [v for side, _, v in rows if side]
        likeness = similar(left, right)[2] if left and right else np.empty(0)
        found = likeness.max(initial=0) if len(likeness) else None
        ends = (table["a"][0].as_py(), table["b"][0].as_py())
        return pa.table({"a": pa.array([ends[0]] if found else [], pa.int64()), "b": pa.array([ends[1]] if found else [], pa.int64()), "likeness": pa.array([found] if found else [], pa.float64())})

    by = ["a", "b", "i", "j"]
    blocks = met.repartition(parallelism(opened.sparkSession), *by).groupBy(*by).applyInArrow(run, "a bigint, b bigint, likeness double")
    return blocks.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def similarity_clusters(values: DataFrame, shard_values: int = SHARD_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(field, id, value, label, class), materialised: label is the attractor of the first clustering, class
    that of the last contraction. values: (id, field, value), materialised."""
    shards = _shards(values, shard_values)
    first = cut(cluster_shards(values, shards))
    rows = first.where("id IS NOT NULL").select("field", "id", "value", "label")
    tops, links = None, first.where("other IS NOT NULL").select(F.col("label").alias("a"), F.col("other").alias("b"), "likeness")
    level, count = rows.where("id = label").select("field", "id", "value"), sum(shards.values())
    while count > len(shards):  # a field still has several shards
        level = cut(level)
        shards = _shards(level, shard_values)
        above = cut(cluster_shards(level, shards))
        step = above.where("id IS NOT NULL").select("id", F.col("label").alias("to"))
        tops = step.withColumnRenamed("to", "top") if tops is None else tops.join(step.withColumnRenamed("id", "mid"), F.col("top") == F.col("mid")).select("id", F.col("to").alias("top"))
        links = links.unionByName(above.where("other IS NOT NULL").select(F.col("label").alias("a"), F.col("other").alias("b"), "likeness"))
        level, before, count = above.where("id IS NOT NULL AND id = label").select("field", "id", "value"), count, sum(shards.values())
        if 2 * count > before:
            break  # attractors no longer halve: the exact links do the rest
    if tops is not None:
        tops = cut(tops)
        links = _moved(links, tops)
        rows = cut(rows.join(tops.withColumnRenamed("id", "bottom"), F.col("label") == F.col("bottom")).select("field", F.col("id"), "value", "label", "top"))
    else:
        rows = rows.withColumn("top", F.col("label"))
    sets = first.where("grams IS NOT NULL").select("field", "label", "grams", "least")
    if tops is not None:
        sets = sets.join(tops.withColumnRenamed("id", "bottom"), F.col("label") == F.col("bottom")).select("field", F.col("top").alias("label"), "grams", "least")
        cells = sets.select("field", "label", F.explode("grams").alias("g")).distinct().groupBy("field", "label").agg(F.collect_list("g").alias("grams"))
        sets = cells.join(sets.groupBy("label").agg(F.min("least").alias("least")), "label").select("field", "label", "grams", "least")
    opened = cut(open_values(rows.select("field", "id", "value", F.col("top").alias("label")), cut(sets), shard_values))
    final = contract(links.unionByName(links_between(opened)), block_values).select(F.col("node").alias("top"), F.col("label").alias("last"))
    return cut(compounds.checked_join(rows, final, ["top"], "id", "left").select("field", "id", "value", "label", F.coalesce("last", "top").alias("class")))


def _moved(links: DataFrame, tops: DataFrame) -> DataFrame:
    """Links between nodes as links between what became of them."""
    left, right = tops.select(F.col("id").alias("a"), F.col("top").alias("x")), tops.select(F.col("id").alias("b"), F.col("top").alias("y"))
    out = links.join(left, "a", "left").join(right, "b", "left")
    return out.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "likeness").where("a <> b")


def flows(clustered: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(i, flow): how much Markov flow of its cluster ends in a value, 0 ones left out. clustered: (field,
    id, value, class), materialised."""
    sizes = clustered.groupBy("class").agg(F.count("*").alias("size")).where("size > 1")
    sized = compounds.salted_join(clustered, sizes, ["class"], "id").select("field", "id", "value", "class", "size")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["value"].to_pylist()))
        a, b, likeness, _ = similar([v for _, v in rows], None)
        nodes, w = settled(a, b, likeness)
        ids = np.array([k for k, _ in rows], np.int64)
        return pa.table({"i": pa.array(ids[nodes], pa.int64()), "flow": pa.array(np.round(w.sum(axis=1), 9), pa.float64())})

    few = sized.where(F.col("size") <= block_values).repartition(parallelism(clustered.sparkSession), "class")
    found = few.groupBy("class").applyInArrow(run, "i bigint, flow double")
    large = sized.where(F.col("size") > block_values)
    if sizes.where(F.col("size") > block_values).limit(1).count():
        entries = settled_by_joins(cut(similarity_links(cut(large.select("id", F.col("class").cast("string").alias("field"), "value"))).where("not forest")))
        found = found.unionByName(entries.groupBy("i").agg(F.round(F.sum("w"), 9).alias("flow")))
    return found.where("flow > 0")


def clustered(df: DataFrame, fields: list[str], key: str = "row_id", with_flow: bool = False) -> DataFrame:
    """(key, <field>_class[, flow]) of the records whose fields are all present."""
    values = similarity_clusters(compounds.distinct_values(df, fields))
    classes = values.select("id", "class")
    if with_flow:
        pulled = flows(values)
        classes = cut(classes.join(pulled, F.col("id") == F.col("i"), "left").select("id", "class", F.coalesce("flow", F.lit(0.0)).alias("flow")))
    rows = compounds.with_ids(df, fields, [key])  # a missing value finds no class
    out = compounds.with_classes(rows, classes, fields, key, ("class", "flow") if with_flow else ("class",), "inner")
    score = F.lit(1.0)
    for f in fields if with_flow else ():
        score = score * (F.lit(1.0) + F.col(f"{f}_flow"))
    return out.select(key, *(f"{f}_class" for f in fields), *([score.alias("flow")] if with_flow else []))


def cluster_members(df: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    """(cluster_<key>, key) of the records in clusters of two or more. A cluster's name is joined back
    by its classes and a salt, so that the largest cluster is no single task."""
    rows = cut(clustered(df, fields, key))
    by = [f"{f}_class" for f in fields]
    named = rows.groupBy(*by).agg(F.min(key).alias(f"cluster_{key}"), F.count("*").alias("n")).where("n > 1")
    return compounds.salted_join(rows, named, by, key).select(f"cluster_{key}", key)


def cluster_table(df: DataFrame, fields: list[str], key: str = "row_id", typical: int = TYPICAL) -> DataFrame:
    """(cluster_<key>, size, typical): every cluster with the keys of its most typical records, those
    of strongest flow (ties: smaller keys). Partial top lists are kept before the shuffle."""
    rows = cut(clustered(df, fields, key, with_flow=True))
    by = [f"{f}_class" for f in fields]
    named = rows.groupBy(*by).agg(F.min(key).alias(f"cluster_{key}"), F.count("*").alias("size"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("flow"), key))).where(F.col("r") <= typical)
    best = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("typical"))
    return named.join(best, by).select(f"cluster_{key}", "size", "typical")
