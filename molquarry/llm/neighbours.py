"""The k most similar vectors (cosine) of every vector of its field, by an inverted multi-index (p2).

Index. On a bounded sample of each field (SAMPLE vectors, by a hash of the key) codebooks are fit
for the two halves of the normalised vectors; a cell is a pair of centroids. Vectors near one
another as wholes form query groups. From each group's centre the centroid pairs are traversed in
the order of summed distance with a heap, until the cells hold about `candidates` vectors; these
are the group's candidates, with the group itself and the cells of its members. Codewords that hold much of the sample are split again, so a crowd of
similar vectors gets more cells and groups instead of one large one.

Search. Groups near one another form regions of about `region_rows` queries. One pass routes every
vector to the region that asks for its neighbours and to the regions whose groups traverse its
cell; each region then reranks, group by group, with exact cosines. All vectors are indexed and all
are queries; the sample only places the centroids.

Copies. Of equal vectors only the k + 1 with the smallest keys can be among anyone's k most similar
(ties go to the smaller key), so a batch routes no more of them than that; the others get the k
smallest keys of their copies by a join. No group of copies reaches one task.

Defined results: a vector that is null, of another length, with a null, NaN or infinite entry, or
all zero is not usable and has no row; a field of n <= k usable vectors gives n - 1 neighbours
each; an empty table has no rows. Keys must be unique.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 16_384
CANDIDATES = 20_000
REGION_ROWS = 49_152
#: rows of a query group, about, until there are MOST_GROUPS groups
GROUP_ROWS = 160
MOST_GROUPS = 2_048
#: parts of the surplus copies of one vector where they are joined
SALTS = 16
#: k-means rounds; share of the sample that no codeword may exceed unless its vectors are equal
ROUNDS = 6
LARGEST_SHARE = 0.02
#: entries of one block of cosines
BLOCK = 4_000_000
STRIDE = 16


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    bias = (centres**2).sum(1) / 2
    step = max(1, BLOCK // max(1, len(centres)))
    for i in range(0, len(x), step):
        out[i : i + step] = (x[i : i + step] @ centres.T - bias).argmax(1)
    return out


def _means(x: np.ndarray, code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    order = np.argsort(code, kind="stable")
    present, first = np.unique(code[order], return_index=True)
    out = centres.copy()
    out[present] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return out


def fit_codebook(x: np.ndarray, size: int, seed: int, share: float = LARGEST_SHARE) -> np.ndarray:
    """Centroids of k-means; codewords above `share` of x are split, at most doubling the codebook."""
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        centres = _means(x, _nearest(x, centres), centres)
    code = _nearest(x, centres)
    room, limit, stuck = len(centres), max(8, share * len(x)), set()
    while room > 0:
        count = np.bincount(code, minlength=len(centres))
        count[list(stuck)] = 0
        worst = int(count.argmax())
        if count[worst] <= limit:
            break
        mine = np.flatnonzero(code == worst)
        pair = x[mine[random.choice(len(mine), 2, replace=False)]].copy()
        for _ in range(ROUNDS):
            pair = _means(x[mine], _nearest(x[mine], pair), pair)
        half = _nearest(x[mine], pair)
        if half.min() == half.max():
            stuck.add(worst)
            continue
        centres = np.concatenate([centres, pair[1:]])
        centres[worst] = pair[0]
        code[mine[half == 1]] = len(centres) - 1
        room -= 1
    return centres


def traverse(first: np.ndarray, second: np.ndarray, mass: np.ndarray, enough: float) -> np.ndarray:
    """Cells (i * len(second) + j) in ascending order of first[i] + second[j] until their mass is
    enough: the sorted distances of each half meet in a heap with one entry a row begun."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d, e, rows, columns = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    width, total, out = len(e), 0.0, []
    heap = [(d[0] + e[0], 0, 0)]
    weigh = mass.tolist()
    while heap:
        _, i, j = heap[0]
        cell = rows[i] * width + columns[j]
        out.append(cell)
        total += weigh[cell]
        if total >= enough:
            break
        if j + 1 < width:
            heapq.heapreplace(heap, (d[i] + e[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(d):
            heapq.heappush(heap, (d[i + 1] + e[0], i + 1, 0))
    return np.array(out, np.int64)


def _regions(centres: np.ndarray, mass: np.ndarray, count: int) -> np.ndarray:
    """Groups dealt to regions of like mass by bisection along the axis of largest variance."""
    out = np.zeros(len(centres), np.int64)
    waiting = [(np.arange(len(centres)), 0, count)]
    while waiting:
        members, low, parts = waiting.pop()
        if parts <= 1 or len(members) <= 1:
            out[members] = low
            continue
        own = centres[members] - centres[members].mean(0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        members = members[np.argsort(own @ axis, kind="stable")]
        left = parts // 2
        weight = np.cumsum(mass[members])
        cut = int(np.clip(np.searchsorted(weight, weight[-1] * left / parts) + 1, 1, len(members) - 1))
        waiting += [(members[:cut], low, left), (members[cut:], low + left, parts - left)]
    return out


class Index:
    """The fitted index of one field. Codebooks and query groups grow with the rows up to a bound: at
    most 256 centroids a half and 2,048 groups before the split of crowded codewords, which at
    most doubles them. A group's route is kept as bits or as a list of cells, whichever is smaller."""

    def __init__(self, sample: np.ndarray, rows: int, candidates: int, region_rows: int):
        half = sample.shape[1] // 2
        size = int(np.clip(3 * rows ** (1 / 3), 16, 256))
        groups = int(np.clip(rows / GROUP_ROWS, 1, MOST_GROUPS))
        self.halves = (fit_codebook(sample[:, :half], size, 1), fit_codebook(sample[:, half:], size, 2))
        self.centres = fit_codebook(sample, groups, 3)
        self.cells = len(self.halves[0]) * len(self.halves[1])
        group = _nearest(sample, self.centres)
        mass = np.bincount(self.cell(sample), minlength=self.cells) * (rows / len(sample))
        weight = np.bincount(group, minlength=len(self.centres)).astype(float)
        self.region_of = _regions(self.centres, weight, -(-rows // region_rows))
        self.regions = int(self.region_of.max()) + 1
        self.routes: list[np.ndarray] = []
        wanted = np.zeros((self.regions, self.cells), bool)
        for g, centre in enumerate(self.centres):
            d = [((c - part) ** 2).sum(1) for c, part in zip(self.halves, (centre[:half], centre[half:]))]
            route = traverse(d[0], d[1], mass, candidates)
            marks = np.zeros(self.cells, bool)
            marks[route] = True
            self.routes.append(route.astype(np.uint32) if 32 * len(route) < self.cells else np.packbits(marks))
            wanted[self.region_of[g], route] = True
        self.wanted = np.packbits(wanted, axis=1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return _nearest(x[:, :half], self.halves[0]) * len(self.halves[1]) + _nearest(x[:, half:], self.halves[1])

    def group(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def asks(self, region: int) -> np.ndarray:
        return np.unpackbits(self.wanted[region], count=self.cells).astype(bool)

    def route(self, group: int) -> np.ndarray:
        held = self.routes[group]
        if held.dtype == np.uint8:
            return np.unpackbits(held, count=self.cells).astype(bool)
        marks = np.zeros(self.cells, bool)
        marks[held] = True
        return marks

    def size(self) -> int:
        """Bytes of what is sent to the workers."""
        return self.wanted.nbytes + self.centres.nbytes + sum(x.nbytes for x in (*self.halves, *self.routes))


def usable(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, those vectors normalised)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        sound = np.isfinite(top) & (top > 0)
        x, at = x[sound] / top[sound, None], at[sound]
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    return at, (x + 0.0).astype(np.float32)


def _copies(x: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal rows."""
    if not len(x):
        return np.empty(0, np.int64)
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    return np.unique(rows, return_inverse=True)[1]


def _rank_in_copies(copy: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, copy))
    start = np.flatnonzero(np.concatenate([[True], np.diff(copy[order]) != 0])) if len(copy) else np.empty(0, np.int64)
    out = np.empty(len(copy), np.int64)
    out[order] = np.arange(len(copy)) - np.repeat(start, np.diff(np.append(start, len(copy))))
    return out


def _best(q: np.ndarray, c: np.ndarray, own: np.ndarray, take: int) -> np.ndarray:
    """For each row of q the positions of its `take` largest products in c, without position own
    (-1: none). The maxima of strided column sets say where the largest can be."""
    pad = -len(c) % STRIDE
    product = q @ c.T
    row = np.flatnonzero(own >= 0)
    product[row, own[row]] = -3
    if len(c) <= 8 * STRIDE * take:
        return np.argpartition(-product, min(take, len(c)) - 1, axis=1)[:, :take]
    if pad:
        product = np.concatenate([product, np.full((len(q), pad), -4, np.float32)], axis=1)
    folded = product.reshape(len(q), STRIDE, -1)
    columns = np.argpartition(-folded.max(axis=1), take - 1, axis=1)[:, :take]
    few = np.take_along_axis(folded, columns[:, None, :], axis=2)
    inner = np.argpartition(-few.reshape(len(q), -1), take - 1, axis=1)[:, :take]
    level, which = np.divmod(inner, take)
    return level * folded.shape[2] + np.take_along_axis(columns, which, axis=1)


def rerank(keys: np.ndarray, x: np.ndarray, role: np.ndarray, group: np.ndarray, cell: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query key, neighbour key, cosine) in one region, best first. role: 1 query, 2 candidate, 3 both."""
    copy = _copies(x)
    rank = _rank_in_copies(copy, keys)
    keep = rank <= k
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not keep.all():
        # further copies that other batches kept: their neighbours are the first k of their copies
        late = np.flatnonzero(~keep & ((role & 1) > 0))
        order = np.lexsort((keys, copy))
        first = order[np.searchsorted(copy[order], copy[late])[:, None] + np.arange(k)[None, :]]
        out.append((np.repeat(keys[late], k), keys[first].ravel(), np.ones(k * len(late))))
    keys, x, role, group, cell, copy, rank = (v[keep] for v in (keys, x, role, group, cell, copy, rank))
    order = np.lexsort((keys, copy))
    keys, x, role, group, cell = (v[order] for v in (keys, x, role, group, cell))
    start = np.flatnonzero(rank[order] == 0)
    count = np.diff(np.append(start, len(keys)))
    one, cells, asked = x[start], cell[start], (role[start] & 2) > 0
    queries, take = (role[start] & 1) > 0, k + 3
    for g in np.unique(group[start][queries]).tolist():
        mine = np.flatnonzero(queries & (group[start] == g))
        # the group itself and the cells that its queries fell into are candidates wherever they lie
        inside = np.zeros(index.cells, bool)
        inside[cells[mine]] = True
        pool = np.flatnonzero((asked & index.route(g)[cells]) | (group[start] == g) | inside[cells])
        place = np.full(len(start), -1, np.int64)
        place[pool] = np.arange(len(pool))
        step = max(1, BLOCK // len(pool))
        for part in (mine[i : i + step] for i in range(0, len(mine), step)):
            near = pool[_best(one[part], one[pool], place[part], min(take, len(pool)))]
            cosine = np.einsum("qd,qtd->qt", one[part].astype(np.float64), one[near].astype(np.float64))
            cosine[near == part[:, None]] = -3
            out += _expand(part, near, cosine, keys, start, count, k)
    if not out:
        return np.empty(0, keys.dtype), np.empty(0, keys.dtype), np.empty(0)
    return tuple(np.concatenate(v) for v in zip(*out))


def _expand(part, near, cosine, keys, start, count, k):
    """Neighbours of distinct vectors to neighbours of keys: copies of a query come first, copies of
    a neighbour tie by their keys."""
    plain = (count[part] == 1) & (count[near].max(axis=1) == 1)
    tie = keys[start[near]]
    order = np.lexsort((tie, -cosine), axis=1) if near.size else near
    near, cosine = np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1)
    top = min(k, near.shape[1])
    rows = np.flatnonzero(plain)
    a = np.repeat(keys[start[part[rows]]], top)
    b, c = keys[start[near[rows, :top]]].ravel(), cosine[rows, :top].ravel()
    good = c > -2
    out = [(a[good], b[good], c[good])]
    for r in np.flatnonzero(~plain).tolist():
        own = keys[start[part[r]] : start[part[r]] + count[part[r]]]
        others, values = [], []
        for n, value in zip(near[r].tolist(), cosine[r].tolist()):
            if value > -2:
                others.append(keys[start[n] : start[n] + count[n]])
                values.append(np.full(count[n], value))
        others = np.concatenate([own, *others])
        values = np.concatenate([np.full(len(own), 1.0), *values])
        best = np.lexsort((others, -values))
        for me in own:
            mine = best[others[best] != me][:k]
            out.append((np.full(len(mine), me, keys.dtype), others[mine], values[mine]))
    return out


def _fit(df: DataFrame, width: int, candidates: int, region_rows: int) -> dict[str, Index]:
    sizes = {r[0]: r[1] for r in df.groupBy("field").count().collect() if r[0] is not None}
    if len(sizes) > 10_000:
        raise ValueError("more than 10,000 fields")
    if not sizes:
        return {}
    rate = F.lit(0)
    for field, n in sizes.items():
        rate = F.when(F.col("field") == field, F.lit(min(1 << 20, int(1.05 * SAMPLE / n * (1 << 20)) + 1))).otherwise(rate)
    drawn = df.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < rate).select("field", "key", "vec").toArrow()
    indexes = {}
    for field, n in sorted(sizes.items()):
        x = _sampled(drawn.filter(pc.equal(drawn["field"], field)), width)
        if not len(x):
            # a crowd of unusable vectors: draw among the usable ones alone, if there are any
            few = df.where((F.col("field") == field) & usable_vector("vec", width))
            n = few.count()
            x = _sampled(few.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < min(1 << 20, int(1.05 * SAMPLE / max(1, n) * (1 << 20)) + 1)).select("field", "key", "vec").toArrow(), width)
        if len(x):
            indexes[field] = Index(x, n, candidates, region_rows)
    return indexes


def _sampled(table: pa.Table, width: int) -> np.ndarray:
    return usable(table.sort_by("key").slice(0, 2 * SAMPLE)["vec"], width)[1]


def usable_vector(column: str, width: int) -> Column:
    """Whether a vector is usable, as an expression."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == width) & finite & F.exists(x, lambda v: v != 0)


def neighbours(df: DataFrame, key: str = "vec_id", field: str = "field_name", vector: str = "vec", width: int = 48, k: int = 5, candidates: int = CANDIDATES, region_rows: int = REGION_ROWS, least: float | None = None, surplus: bool = True) -> DataFrame:
    """(key, field, neighbour, cosine): up to k rows for each usable vector.

    least: leave out neighbours of a smaller cosine, before anything is shuffled again.
    surplus: also give the rows of copies beyond the k + 1 smallest keys; they are never mutual."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(field).cast("string").alias("field"), F.col(vector).alias("vec"))
    indexes = _fit(rows.where("field IS NOT NULL"), width, candidates, region_rows)
    names = sorted(indexes)
    base = np.cumsum([0, *(indexes[n].regions for n in names)])
    shared = spark.sparkContext.broadcast(indexes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, parts = batch.column(1), []
            for number, name in enumerate(names):
                index = shared.value[name]
                which = np.flatnonzero(pc.fill_null(pc.equal(fields, name), False).to_numpy(zero_copy_only=False))
                at, x = usable(batch.column(2).take(pa.array(which)), width)
                if not len(at):
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)[which[at]]
                copy = _copies(x)
                beyond = _rank_in_copies(copy, keys) > k
                if beyond.any() and surplus:
                    i = np.flatnonzero(beyond)
                    parts.append((np.full(len(i), base[number]), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), keys[i], x[i]))
                keys, x = keys[~beyond], x[~beyond]
                group, cell = index.group(x), index.cell(x)
                home = index.region_of[group]
                for region in range(index.regions):
                    role = (home == region) + 2 * index.asks(region)[cell].astype(np.int64)
                    i = np.flatnonzero(role)
                    parts.append((np.full(len(i), base[number] + region), role[i], np.where(role[i] & 1, group[i], -1), cell[i], keys[i], x[i]))
            if parts:
                region, role, group, cell, keys, x = (np.concatenate(v) for v in zip(*parts))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region, pa.int32()), pa.array(role, pa.int8()), pa.array(group, pa.int32()), pa.array(cell, pa.int32()), pa.array(keys, pa.int64()), blob],
                    ["region", "role", "grp", "cell", "key", "x"],
                )

    def search(table: pa.Table, region: int) -> pa.RecordBatch:
        number = int(np.searchsorted(base, region, side="right")) - 1
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, width)
        value = lambda c: table[c].to_numpy().astype(np.int64)
        a, b, cosine = rerank(value("key"), x, value("role"), value("grp"), value("cell"), shared.value[names[number]], k)
        if least is not None:
            a, b, cosine = (v[cosine >= least] for v in (a, b, cosine))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([names[number]] * len(a), pa.string()), pa.array(b, pa.int64()), pa.array(cosine, pa.float64())], ["key", "field", "neighbour", "cosine"])

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds one region (a session that merges partitions may give it several)."""
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            for region in sorted(pc.unique(table["region"]).to_pylist()):
                yield search(table.filter(pc.equal(table["region"], region)), region)

    if not names:
        found = spark.createDataFrame([], "key bigint, field string, neighbour bigint, cosine double")
    else:
        routed = rows.mapInArrow(route, "region int, role byte, grp int, cell int, key bigint, x binary")
        # the region is the partition: no two regions share a task by a clash of hashes
        dealt = routed.where("role > 0").repartitionById(int(base[-1]), F.col("region"))
        found = dealt.mapInArrow(search_all, "key bigint, field string, neighbour bigint, cosine double")
        if surplus:
            number = F.lit(0)
            for low in base[:-1].tolist():
                number = number + (F.col("region") >= low).cast("int")
            named = F.element_at(F.array(*(F.lit(n) for n in names)), number).alias("field")
            marked = routed.select("role", named, "key", F.xxhash64("x").alias("h"), F.md5("x").alias("m"))
            extra, by = marked.where("role = 0").select("field", "key", "h", "m"), ["field", "h", "m"]
            # the k smallest keys of each group of copies, of what the batches kept; the limit by rank
            # passes no more than k of them a partition, and the surplus copies are dealt to salts
            kept = marked.where("role > 0 AND (role & 1) = 1").join(extra.select(*by).distinct(), by, "left_semi")
            ranked = kept.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("r") <= k)
            first = ranked.groupBy(*by).agg(F.collect_list("key").alias("near"))
            copies = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = extra.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
            added = salted.join(copies, [*by, "salt"]).select("key", "field", F.explode("near").alias("neighbour"), F.lit(1.0).alias("cosine"))
            found = found.unionByName(added)
    return found.select(F.col("key").alias(key), F.col("field").alias(field), "neighbour", "cosine")


def mutual_pairs(df: DataFrame, least: float = 0.95, key: str = "vec_id", **more) -> DataFrame:
    """(key_a, key_b), smaller first: vectors each among the other's k most similar, cosine >= least."""
    near = neighbours(df, key=key, least=least, surplus=False, **more)
    pair = near.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b"), (F.col(key) < F.col("neighbour")).alias("up"))
    both = pair.groupBy(f"{key}_a", f"{key}_b").agg(F.max("up").alias("u"), F.min("up").alias("d"))
    return both.where(F.col("u") & ~F.col("d")).select(f"{key}_a", f"{key}_b")


def recall(df: DataFrame, every: int = 100, key: str = "vec_id", field: str = "field_name", vector: str = "vec", width: int = 48, k: int = 5, block: int = 8_192, **more) -> DataFrame:
    """(field, queries, recall): the share of the exact k best cosines that the index reaches, for all keys
    divisible by `every` against all rows. Blocks of `block` queries (1.6 MB of 48 numbers) are sent to the workers in turn."""
    spark = df.sparkSession
    drawn = df.select(F.col(key).cast("bigint").alias("key"), F.col(field).alias("field"), F.col(vector).alias("vec"))
    asked = drawn.where((F.col("key") % every == 0) & F.col("field").isNotNull())
    parts = max(1, -(-asked.count() // block))
    exact = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow()
        at, x = usable(mine["vec"], width)
        shared = spark.sparkContext.broadcast((np.array(mine["key"].to_pylist(), np.int64)[at], np.array(mine["field"].to_pylist(), object)[at], x))
        best = drawn.mapInArrow(_scan(shared, width, k), "key bigint, field string, cosine float")
        exact = best if exact is None else exact.unionByName(best)
    # each partition gives the k best of its rows
    exact = exact.groupBy("key", "field").agg(F.slice(F.sort_array(F.collect_list("cosine"), False), 1, k).alias("best"))
    exact = exact.select("key", "field", F.element_at("best", -1).alias("last"), F.size("best").alias("n"))
    near = neighbours(df, key=key, field=field, vector=vector, width=width, k=k, **more).select(F.col(key).alias("key"), "cosine")
    hit = exact.join(near, "key", "left").groupBy("key", "field", "n").agg(F.sum(F.when(F.col("cosine") >= F.col("last") - 1e-6, 1).otherwise(0)).alias("hit"))
    return hit.groupBy(F.col("field").alias(field)).agg(F.count("*").alias("queries"), (F.sum(F.least("hit", "n")) / F.sum("n")).alias("recall"))


def _scan(shared, width: int, k: int):
    """The k best cosines of every query among the rows of a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fields, q = shared.value
        best = np.full((len(keys), k), -3, np.float32)
        for batch in batches:
            place, own = usable(batch.column(2), width)
            mine = batch.column(0).to_numpy(zero_copy_only=False)[place]
            kind = np.array(batch.column(1).to_pylist(), object)[place]
            for name in set(fields):
                a, b = np.flatnonzero(fields == name), np.flatnonzero(kind == name)
                if not len(b):
                    continue
                product = q[a] @ own[b].T
                product[keys[a][:, None] == mine[b][None, :]] = -3
                whole = np.concatenate([best[a], product], axis=1)
                best[a] = -np.partition(-whole, k - 1, axis=1)[:, :k]
        good = best > -2
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, k)[good.ravel()], pa.int64()), pa.array(np.repeat(fields, k)[good.ravel()].tolist(), pa.string()), pa.array(best[good], pa.float32())], ["key", "field", "cosine"])

    return scan
