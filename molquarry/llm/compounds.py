"""Classes of values that are the same compound: linked by at most EDITS changed characters (p4, p5).

The distinct values of each field are normalised and given a 64-bit id. A value is cut into EDITS + 1
passages; EDITS changes leave one of them whole, at a shift that the changes before and after it
allow. The passages of the asked values are dealt to shards by a hash of their characters. A text
goes to those shards only to which one of its own substrings of fitting length and place hashes,
so no text meets all shards. In a shard, an Aho-Corasick automaton over the passages scans the texts; matched
intervals merge into coverage for each asked value, and pairs of a value and a text are decided by the
exact edit distance. A shard returns a spanning forest of its links (no more than a row a value), which
keeps every connection without listing all pairs of a class.

Which values are asked is the caller's choice. For overlaps between splits (p4) they are the values
of held-out records; a text that is linked to one is asked next, until no new one is linked, so that classes are
whole even where they hang together by values of no split. For entities (p5) all values are asked.

Hot passages: a shard of more than SHARD_ROWS passages or TEXT_ROWS texts is cut into blocks of either side that
meet each other. Values of at most EDITS characters are within reach of one another by definition and form
one class at once; they meet all texts of at most 2 * EDITS characters in a shard of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import MISSING
from molquarry.llm.components import components
from molquarry.llm.editing import within
from molquarry.session import cut

EDITS = 4
#: passages and texts of one block
SHARD_ROWS = 20_000
TEXT_ROWS = 50_000
#: pairs of a passage and a text that are looked at at once
HITS = 500_000
#: class tables of at most so many rows (16 bytes each) are broadcast, larger ones are joined
BROADCAST_ROWS = 250_000
#: parts that the rows of a hot key are dealt to where they are joined
SALTS = 16


def trimmed(column: str) -> Column:
    """The value without blanks at its ends. Trimming by a set of characters is slow, and most values have
    no blanks at their ends."""
    value = F.col(column)
    blank = value.startswith(" ") | value.startswith("\t") | value.endswith(" ") | value.endswith("\t")
    return F.when(blank, F.btrim(value, F.lit(" \t"))).otherwise(value)


def normalised(column: str) -> Column:
    """The value without blanks at its ends, null where it is missing."""
    return F.when(~trimmed(column).isin(*MISSING), trimmed(column))


def with_ids(df: DataFrame, fields: list[str], keep: list[str | Column]) -> DataFrame:
    """keep and <field>_id of each field: values leave the rows as ids, so no text is shuffled. A missing
    value has an id like any other, which no class table holds: a test for it here would make the plan
    work out the trimmed text again and again."""
    return df.select(*keep, *(F.xxhash64(F.lit(f), trimmed(f)).alias(f"{f}_id") for f in fields))


def distinct_values(df: DataFrame, fields: list[str], **marks: Column) -> DataFrame:
    """(id, field, value[, marks]) of every distinct value, checkpointed; a mark is true where it is true
    in any of its records. One pass: the values of a row are exploded and aggregated before the shuffle."""
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), trimmed(f).alias("value")) for f in fields)))
    flat = df.select(listed.alias("x"), *(F.coalesce(c, F.lit(False)).alias(m) for m, c in marks.items())).select("x.field", "x.value", *marks).where(~F.col("value").isin(*MISSING))
    found = flat.groupBy("field", "value").agg(*(F.max(m).alias(m) for m in marks)) if marks else flat.distinct()
    return cut(found.select(F.xxhash64("field", "value").alias("id"), "field", "value", *marks))


def passages(length: int, edits: int = EDITS) -> np.ndarray:
    """The edges of the edits + 1 passages of a value."""
    return np.arange(edits + 2) * length // (edits + 1)


def shifts(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(longer, passage, shift): where a whole passage of a value may stand in a text that is `longer`
    characters longer: the changes before it (at most its number) and after it (at most the rest)
    bound the shift."""
    out = []
    for longer in range(-edits, edits + 1):
        for i in range(edits + 1):
            out += [(longer, i, d) for d in range(max(-i, longer - edits + i), min(i, longer + edits - i) + 1)]
    return out


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


class _Hashes:
    """Hashes of substrings of many texts, each from two prefix sums (modulo 2^64)."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes) + 1
        inverse = np.uint64(pow(int(self.STEP), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n, self.STEP)]))
        down = np.cumprod(np.concatenate([one, np.full(n, inverse)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * down[: len(codes)], dtype=np.uint64)])

    def shard(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
        low = self.begin[row] + start
        h = (self.sums[low + size] - self.sums[low]) * self.up[low]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


#: the shard of values that are too short for passages
SHORT = -1


def routes(texts: list[str], asked: np.ndarray, searched: np.ndarray, shards: int, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shard, passage) of the rows that go to shards: passage is the number of an asked value's
    passage, or -1 where the text is to be scanned."""
    hashes = _Hashes(texts)
    size, out = hashes.size, []
    mine = np.flatnonzero(asked & (size > edits))
    for i in range(edits + 1):
        low, high = i * size[mine] // (edits + 1), (i + 1) * size[mine] // (edits + 1)
        out.append((mine, hashes.shard(mine, low, high - low, shards), np.full(len(mine), i)))
    brief = np.flatnonzero(asked & (size <= edits))
    out.append((brief, np.full(len(brief), SHORT), np.zeros(len(brief), np.int64)))
    scanned = []
    for longer, i, d in shifts(edits):
        length = size - longer
        low = i * length // (edits + 1)
        high = (i + 1) * length // (edits + 1)
        t = np.flatnonzero(searched & (length > edits) & (low + d >= 0) & (high + d <= size))
        scanned.append(np.stack([t, hashes.shard(t, low[t] + d, high[t] - low[t], shards)]))
    t = np.flatnonzero(searched & (size <= 2 * edits))
    scanned.append(np.stack([t, np.full(len(t), SHORT)]))
    t, shard = np.unique(np.concatenate(scanned, axis=1), axis=1)
    out.append((t, shard, np.full(len(t), -1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def bag_distance(bags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of the pairs: characters that one value has beyond the other."""
    more = bags[a] - bags[b]
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def _bags(values: list[str], width: int = 48) -> np.ndarray:
    size = np.fromiter(map(len, values), np.int64, len(values))
    codes = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32) % width
    bags = np.bincount(np.repeat(np.arange(len(values)), size) * width + codes, minlength=len(values) * width)
    return np.minimum(bags, 30_000).astype(np.int16).reshape(-1, width)


def scanned(asked: list[str], parts: list[tuple[int, int]], texts: list[str], edits: int = EDITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asked value, text, passage) of the passages (parts: value, number) that stand whole in a text at a
    fitting place, found by one automaton; in batches of whole texts."""
    import ahocorasick

    automaton, number, posting = ahocorasick.Automaton(), {}, []
    owner = np.array([v for v, _ in parts], np.int64)
    which = np.array([i for _, i in parts], np.int64)
    size = np.fromiter(map(len, asked), np.int64, len(asked))
    place, end = which * size[owner] // (edits + 1), (which + 1) * size[owner] // (edits + 1)
    for p, (v, low, high) in enumerate(zip(owner.tolist(), place.tolist(), end.tolist())):
        word = asked[v][low:high]
        if word not in number:
            number[word] = len(number)
            automaton.add_word(word, number[word])
            posting.append([])
        posting[number[word]].append(p)
    if not number:
        return
    automaton.make_automaton()
    count = np.fromiter(map(len, posting), np.int64, len(posting))
    first = np.cumsum(count) - count
    flat = np.concatenate([np.array(p, np.int64) for p in posting])
    width = (end - place)[flat[first]]

    def pairs(hits: list[tuple[int, int]], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stop, word = np.array(hits, np.int64).T
        text, n = np.array(owners, np.int64), count[word]
        entry = flat[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        text, begin = np.repeat(text, n), np.repeat(stop - width[word] + 1, n)
        v, i = owner[entry], which[entry]
        shift, longer = begin - place[entry], length[text] - size[v]
        near = (np.abs(longer) <= edits) & (np.abs(shift) <= i) & (np.abs(longer - shift) <= edits - i)
        return v[near], text[near], i[near]

    length = np.fromiter(map(len, texts), np.int64, len(texts))
    hits: list[tuple[int, int]] = []
    owners: list[int] = []
    load = 0
    for t, text in enumerate(texts):
        found = list(automaton.iter(text))
        hits += found
        owners += [t] * len(found)
        load += sum(int(count[w]) for _, w in found)
        if load > HITS:
            yield pairs(hits, owners)
            hits, owners, load = [], [], 0
    if hits:
        yield pairs(hits, owners)


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its group."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return out


def link_forest(values: list[str], batches: Iterator[tuple[np.ndarray, np.ndarray]], edits: int = EDITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the candidate pairs (positions in values). Pairs that are
    connected by then need no test."""
    forest, edges, bags = _Forest(len(values)), [], _bags(values)
    label = forest.labels()

    def open_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = label[a] != label[b]
        return a[apart], b[apart]

    def test(a: np.ndarray, b: np.ndarray) -> None:
        good = np.flatnonzero(within([values[i] for i in a.tolist()], [values[i] for i in b.tolist()], edits))
        for i, j in zip(a[good].tolist(), b[good].tolist()):
            if forest.join(i, j):
                edges.append((i, j))

    for a, b in batches:
        a, b = open_pairs(a, b)
        near = np.concatenate([bag_distance(bags, a[i : i + 100_000], b[i : i + 100_000]) <= edits for i in range(0, len(a), 100_000)]) if len(a) else np.empty(0, bool)
        a, b = a[near], b[near]
        take = 1
        while len(a):
            # one pair of each class met so far, on either side, then two, four...: most of what the first
            # join needs no test
            chosen = (_places(label[a]) < take) | (_places(label[b]) < take)
            test(a[chosen], b[chosen])
            label = forest.labels()
            a, b = open_pairs(a[~chosen], b[~chosen])
            take *= 2
    return edges


ROUTED = "field string, shard int, passage int, id bigint, value string, asked boolean, learned boolean"


def passage_links(values: DataFrame, edits: int = EDITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b, mask): links between the ids of values (id, field, value, asked, searched, learned), of asked
    ones and searched ones, that connect all that are within reach; and rows with b null: the passages
    of the asked value a, as bits, that some learned text holds."""
    count = {r["field"]: r["n"] for r in values.where("asked").groupBy("field").agg(F.count("*").alias("n")).collect()}
    shards = max(1, -(-(edits + 1) * max(count.values(), default=1) // shard_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fields, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            if not texts:
                continue
            flag = lambda i: batch.column(i).to_numpy(zero_copy_only=False).astype(bool)
            row, shard, passage = routes(texts, flag(3), flag(4), shards, edits)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([fields.take(at), pa.array(shard, pa.int32()), pa.array(passage, pa.int32()), ids.take(at), batch.column(2).take(at), batch.column(3).take(at), batch.column(5).take(at)], ["field", "shard", "passage", "id", "value", "asked", "learned"])

    routed = values.select("id", "field", "value", "asked", "searched", "learned").mapInArrow(route, ROUTED)
    load = routed.groupBy("field", "shard").agg(F.count_if(F.col("passage") >= 0).alias("m"), F.count_if(F.col("passage") < 0).alias("n"))
    full = cut(load.where(F.col("m").between(1, 2 * shard_rows) & (F.col("n") <= TEXT_ROWS)).select("field", "shard", F.lit(1).alias("mb"), F.lit(1).alias("nb")).unionByName(
        load.where((F.col("m") > 2 * shard_rows) | (F.col("n") > TEXT_ROWS)).where("m > 0").select("field", "shard", F.ceil(F.col("m") / shard_rows).cast("int").alias("mb"), F.ceil(F.col("n") / TEXT_ROWS).cast("int").alias("nb"))))
    sized = checked_join(routed, full, ["field", "shard"], "id")
    is_text = F.col("passage") < 0
    own = F.pmod(F.xxhash64("id"), F.when(is_text, F.col("nb")).otherwise(F.col("mb"))).cast("int")
    facing = F.explode(F.sequence(F.lit(0), F.when(is_text, F.col("mb")).otherwise(F.col("nb")) - 1))
    met = sized.select("field", "shard", "passage", "id", "value", "asked", "learned", own.alias("own"), facing.alias("facing"))
    met = met.select("field", "shard", "passage", "id", "value", "asked", "learned", F.when(is_text, F.col("facing")).otherwise(F.col("own")).alias("i"), F.when(is_text, F.col("own")).otherwise(F.col("facing")).alias("j"))

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["passage"].to_pylist(), table["value"].to_pylist(), table["asked"].to_pylist(), table["learned"].to_pylist()))
        place: dict[int, int] = {}
        ids, values, parts, texts, both, learned = [], [], [], [], [], []
        for key, passage, value, asked, known in rows:
            at = place.setdefault(key, len(ids))
            if at == len(ids):
                ids.append(key)
                values.append(value)
            if passage >= 0:
                parts.append((at, passage))
            else:
                texts.append(at)
                both.append(asked)
                learned.append(known)
        text_at, asks = np.array(texts, np.int64), np.array(both, bool)
        known, mask = np.array(learned, bool), np.zeros(len(ids), np.int64)

        def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if not parts or not texts:
                return
            if table["shard"][0].as_py() == SHORT:
                asked = np.array([v for v, _ in parts], np.int64)
                step = max(1, HITS // len(asked))
                for low in range(0, len(text_at), step):
                    part = text_at[low : low + step]
                    yield np.repeat(asked, len(part)), np.tile(part, len(asked))
                return
            for v, t, i in scanned(values, parts, [values[k] for k in texts], edits):
                np.bitwise_or.at(mask, v[known[t]], 1 << i[known[t]])
                # two asked values find each other both ways: one is enough (ids ascend with the positions)
                k = (v < text_at[t]) | ((v > text_at[t]) & ~asks[t])
                yield v[k], text_at[t[k]]

        ends = np.array(link_forest(values, candidates(), edits), np.int64).reshape(-1, 2)
        covered, key = np.flatnonzero(mask), np.array(ids, np.int64)
        return pa.table({
            "a": pa.array(key[np.concatenate([ends[:, 0], covered])], pa.int64()),
            "b": pa.concat_arrays([pa.array(key[ends[:, 1]], pa.int64()), pa.nulls(len(covered), pa.int64())]),
            "mask": pa.array(np.concatenate([np.zeros(len(ends), np.int64), mask[covered]]), pa.int32()),
        })

    # the work of a shard lies in its pairs, not its bytes, so partitions must not be merged by size
    by = ["field", "shard", "i", "j"]
    found = met.repartition(2 * max(1, len(count)) * (shards + 1), *by).groupBy(*by).applyInArrow(meet, "a bigint, b bigint, mask int")
    brief = values.where(F.length("value") <= edits)
    least = brief.groupBy("field").agg(F.min("id").alias("b"))
    return found.unionByName(brief.join(least, "field").where("id <> b").select(F.col("id").alias("a"), "b", F.lit(0).alias("mask")))


def value_links(values: DataFrame, edits: int = EDITS, shard_values: int = SHARD_ROWS // 5) -> DataFrame:
    """(a, b): links between the ids of (id, field, value) that connect all that are within reach."""
    every = F.lit(True)
    marked = values.select("id", "field", "value", every.alias("asked"), every.alias("searched"), F.lit(False).alias("learned"))
    return passage_links(marked, edits, (edits + 1) * shard_values).where("b IS NOT NULL").select("a", "b")


def reached_links(values: DataFrame, edits: int = EDITS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), coverage (id, mask)), materialised: the links that connect the asked values of (id,
    field, value, asked, learned) with all that are within reach of them, be it through other values."""
    links = coverage = None
    open_ = values.select("id", "field", "value", "asked", F.lit(True).alias("searched"), "learned")
    while True:
        found = cut(passage_links(open_, edits, shard_rows))
        met = found.where("b IS NOT NULL").select("a", "b")
        links = met if links is None else links.unionByName(met)
        if coverage is None:
            coverage = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.bit_or("mask").alias("mask"))
        # values that were asked need no further scan: what is newly linked asks those that weren't
        ends = met.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("new", F.lit(True))
        rest = open_.where("NOT asked AND searched").drop("asked").join(ends, "id", "left")
        open_ = cut(rest.select("id", "field", "value", F.coalesce("new", F.lit(False)).alias("asked"), "searched", "learned"))
        if not open_.where("asked").limit(1).count():
            return links, cut(coverage)


def _classes(values: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return cut(values.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("class")))


def compound_classes(df: DataFrame, fields: list[str], edits: int = EDITS) -> DataFrame:
    """(id, class) of every distinct value that isn't missing; class is the smallest id."""
    values = distinct_values(df, fields)
    return _classes(values.select("id"), value_links(values, edits))


def asked_classes(df: DataFrame, fields: list[str], asked: Column, learned: Column, edits: int = EDITS) -> DataFrame:
    """(id, class, size, covered) of the values of asked records and of all that are the same compound:
    size is the value's length, covered how many of its characters stand in passages that
    learned records hold too (null for values of no asked record)."""
    values = distinct_values(df, fields, asked=asked, learned=learned)
    links, coverage = reached_links(values, edits)
    n = F.length("value")
    edge = lambda i: F.floor(n * F.lit(i) / F.lit(edits + 1))
    merged = sum((F.when(F.coalesce("mask", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, edge(i + 1) - edge(i)).otherwise(0) for i in range(edits + 1)), F.lit(0))
    # a value that a learned record has in equal spelling is covered whole
    covered = F.when(F.col("asked"), F.when(F.col("learned"), n).otherwise(merged)).cast("int")
    known = cut(values.join(coverage, "id", "left").select("id", "asked", n.alias("size"), covered.alias("covered")))
    found = components(links)
    joined = known.join(found, F.col("id") == F.col("node"), "left").where("asked OR node IS NOT NULL")
    return cut(joined.select("id", F.coalesce("component", "id").alias("class"), "size", "covered"))


def salted_join(rows: DataFrame, table: DataFrame, by: list[str], key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows with the one row of table that agrees in `by`. A hot key of rows is dealt to `salts` parts
    by a hash of `key`, each of which meets a copy of the table's row."""
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*by, "_salt"], how).drop("_salt")


def checked_join(rows: DataFrame, table: DataFrame, by: list[str], key: str, how: str = "inner") -> DataFrame:
    """rows with the one row of a materialised table that agrees in `by`: broadcast after a count of its
    rows, by a salted join beyond BROADCAST_ROWS."""
    return rows.join(F.broadcast(table), by, how) if table.count() <= BROADCAST_ROWS else salted_join(rows, table, by, key, how)


def with_classes(df: DataFrame, classes: DataFrame, fields: list[str], key: str, columns: tuple[str, ...] = ("class",), how: str = "left") -> DataFrame:
    """df (with an id column <field>_id for each field) with <field>_<column>, null for missing values.
    classes must be materialised; it is broadcast only after a count of its rows, and joined by a
    salted key beyond that."""
    small = classes.count() <= BROADCAST_ROWS
    for field in fields:
        own = classes.select(F.col("id").alias(f"{field}_id"), *(F.col(c).alias(f"{field}_{c}") for c in columns))
        df = df.join(F.broadcast(own), f"{field}_id", how) if small else salted_join(df, own, [f"{field}_id"], key, how)
    return df
