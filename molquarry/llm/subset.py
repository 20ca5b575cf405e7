"""A varied subset of given size by tournament-pivoted rank-revealing QR (p3).

Every distinct value is a feature row: its hashed 3-character substrings in WIDTH dimensions with
signs, normalised. Blocks of rows nominate linearly independent ones by QR with column pivoting
(the row of largest residual is next); nominees meet in pairs and are pivoted again, in a tree,
until one list is left. The next round deflates: it starts with what is left of the rows outside
the span of the tail of the selection, and repeats until k records are selected. A family of many
similar rows spans few directions, so it gets few places.

Defined results: null, missing and blank values are no candidates; repeated values are one; a
subset larger than the number of candidates holds all; an unknown field or a size that is null or
not positive gives no rows; ties go to the smaller value.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm import compounds
from molquarry.session import cut

WIDTH = 256
GRAM = 3
BLOCK_ROWS = 2_000
#: nominee lists that one task reduces, in pairs
FAN = 8
#: selected rows that the driver gathers before they are added to the table
PENDING_ROWS = 4_096
#: residual (of a unit row) below which a row counts as dependent
TINY = 1e-6


def features(values: list[str], width: int = WIDTH) -> np.ndarray:
    """Unit rows of signed, hashed substring counts (the value itself where it is shorter)."""
    out = np.zeros((len(values), width))
    for i, value in enumerate(values):
        for j in range(max(1, len(value) - GRAM + 1)):
            h = zlib.crc32(value[j : j + GRAM].encode())
            out[i, (h >> 1) % width] += 1 if h & 1 else -1
    norm = np.sqrt((out**2).sum(axis=1))
    norm[norm == 0] = 1
    return out / norm[:, None]


def pivots(rows: np.ndarray, limit: int, basis: np.ndarray | None = None) -> list[int]:
    """Up to `limit` positions in the order of pivoted QR: each is the row of largest residual
    against those before it (and against basis, rows selected earlier); ties keep the first."""
    rest = rows.astype(float).copy()
    if basis is not None and len(basis):
        q = np.linalg.qr(basis.T)[0]
        rest -= (rest @ q) @ q.T
    out: list[int] = []
    norms = (rest**2).sum(axis=1)
    while len(out) < min(limit, len(rows)):
        at = int(norms.argmax())
        if norms[at] <= TINY:
            break
        q = rest[at] / np.sqrt(norms[at])
        out.append(at)
        rest -= np.outer(rest @ q, q)
        norms = (rest**2).sum(axis=1)
        norms[out] = -1
    return out


def _nominate(table: pa.Table, limit: int, basis: dict[str, np.ndarray]) -> pa.Table:
    """Lists of the table's groups (column part) meet in pairs until one is left."""
    field = table["field"][0].as_py()
    rows = sorted(zip(table["part"].to_pylist(), table["place"].to_pylist(), table["value"].to_pylist()))
    lists: dict[int, list[str]] = {}
    for part, _, value in rows:
        lists.setdefault(part, []).append(value)

    def pivot(values: list[str]) -> list[str]:
        return [values[i] for i in pivots(features(values), limit, basis.get(field))]

    waiting = [pivot(v) for _, v in sorted(lists.items())]
    while len(waiting) > 1:
        waiting = [pivot(sorted(waiting[i] + waiting[i + 1])) if i + 1 < len(waiting) else waiting[i] for i in range(0, len(waiting), 2)]
    best = waiting[0]
    return pa.table({"field": pa.array([field] * len(best), pa.string()), "part": pa.array([0] * len(best), pa.int64()), "place": pa.array(range(len(best)), pa.int64()), "value": pa.array(best, pa.string())})


LIST = "field string, part bigint, place bigint, value string"


def _tournament(candidates: DataFrame, blocks: int, limit: int, basis: dict[str, np.ndarray]) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(basis)

    def reduce_by(group: int):
        def run(table: pa.Table) -> pa.Table:
            out = _nominate(table, limit, shared.value)
            return out.set_column(1, "part", pa.array([table["part"][0].as_py() // group] * out.num_rows, pa.int64()))

        return run

    level = candidates.select("field", F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("part"), F.lit(0).cast("bigint").alias("place"), "value")
    # the work of a block lies in its pivots, not its bytes, so partitions must not be merged by size
    level = level.repartition(4 * blocks, "field", "part").groupBy("field", "part").applyInArrow(reduce_by(1), LIST)
    while blocks > 1:
        level = level.groupBy("field", F.expr(f"div(part, {FAN})")).applyInArrow(reduce_by(FAN), LIST)
        blocks = -(-blocks // FAN)
    return level


def select_varied(df: DataFrame, requests: DataFrame, fields: list[str]) -> DataFrame:
    """(request_id, field_name, rank, value): for each request the first subset_size records of its
    field's selection, which is found once for the largest request. Requests are a small table."""
    spark = df.sparkSession
    asked = [r for r in requests.select("request_id", "field_name", "subset_size").limit(10_001).collect() if r[1] in fields and r[2] and r[2] > 0]
    if len(asked) > 10_000:
        raise ValueError("more than 10,000 requests")
    wanted = {f: max(r[2] for r in asked if r[1] == f) for f in {r[1] for r in asked}}
    schema = "request_id int, field_name string, rank int, value string"
    if not wanted:
        return spark.createDataFrame([], schema)
    values = compounds.distinct_values(df, sorted(wanted)).select("field", "value")
    largest = values.groupBy("field").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-largest // BLOCK_ROWS))
    shape = "field string, rank int, value string"
    selected, count, open_fields = None, dict.fromkeys(wanted, 0), set(wanted)
    # the driver holds the last rows of each field's selection and those that aren't in the table yet
    tail: dict[str, list[str]] = {f: [] for f in wanted}
    pending: list[tuple[str, int, str]] = []
    while open_fields:
        # a round's span is whole once it has WIDTH rows; the rows of the last half span carry over,
        # so that the next round begins away from them
        basis = {f: features(tail[f]) for f in open_fields if tail[f]}
        left = values.where(F.col("field").isin(sorted(open_fields)))
        for done in (selected, spark.createDataFrame(pending, shape) if pending else None):
            left = left.join(done.select("field", "value"), ["field", "value"], "left_anti") if done is not None else left
        limit = min(WIDTH, max(wanted[f] - count[f] for f in open_fields))
        won = _won(left, blocks, limit, basis)
        again = sorted(f for f in open_fields if f not in won and f in basis)
        if again:
            # what is left of these lies in the span of the carried rows: take it without them
            won |= _won(left.where(F.col("field").isin(again)), blocks, limit, {})
        for f in sorted(open_fields):
            new = won.get(f, [])[: wanted[f] - count[f]]
            pending += [(f, count[f] + i + 1, v) for i, v in enumerate(new)]
            count[f], tail[f] = count[f] + len(new), (tail[f] + new)[-(WIDTH // 2) :]
            if not new or count[f] >= wanted[f]:
                open_fields.discard(f)
        if len(pending) > PENDING_ROWS or not open_fields:
            more = spark.createDataFrame(pending, shape)
            selected, pending = cut(more if selected is None else selected.unionByName(more)), []
    named = spark.createDataFrame([(r[0], r[1], r[2]) for r in asked], "request_id int, field_name string, subset_size int")
    out = selected.join(F.broadcast(named), (F.col("field") == F.col("field_name")) & (F.col("rank") <= F.col("subset_size")))
    return out.select("request_id", "field_name", "rank", "value")


def _won(left: DataFrame, blocks: int, limit: int, basis: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """The winners of one tournament by field, in their order: no more than the feature width of each."""
    out: dict[str, list[str]] = {}
    for r in sorted(_tournament(left, blocks, limit, basis).collect(), key=lambda r: (r["field"], r["place"])):
        out.setdefault(r["field"], []).append(r["value"])
    return out
