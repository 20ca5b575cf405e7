"""Row positions, running totals and the n smallest hashes without a single-task window.

A global order is made by a range-partitioned sort that is checkpointed; the rows of one partition
then only need that partition's offset, which is joined by its number from a table of one row a partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.session import cut

_PLACE = (1 << 33) - 1
#: bits of the lower half of a hash
_HALF = 16
#: rows of a bucket that are ordered without a second histogram
BUCKET_ROWS = 100_000


def _ordered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df sorted, with _part and _seq (place within the partition), checkpointed."""
    numbered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(numbered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_seq", F.col("_at").bitwiseAND(F.lit(_PLACE))).drop("_at"))


def _with_offsets(held: DataFrame, sums: list, columns: list[str], kind: str) -> DataFrame:
    """held with _before_<column>: the sums of the partitions before each row's. One short row a
    partition of the sort is broadcast."""
    zero = 0.0 if kind == "double" else 0
    rows, total = [], [zero] * len(columns)
    for r in sorted(sums, key=lambda r: r["_part"]):
        rows.append((r["_part"], *total))
        total = [t + (r[c] or zero) for t, c in zip(total, columns)]
    table = held.sparkSession.createDataFrame(rows, "_part bigint, " + ", ".join(f"`_before_{c}` {kind}" for c in columns))
    return held.join(F.broadcast(table), "_part")


def dense_positions(df: DataFrame, order: list[str | Column], name: str = "row_id") -> DataFrame:
    """df with its 0-based position in the given order (which should be total). Give it only the columns
    that are needed: all of them are sorted and checkpointed."""
    held = _ordered(df, order)
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
    placed = _with_offsets(held, counts, ["n"], "bigint")
    return placed.withColumn(name, F.col("_seq") + F.col("_before_n")).select(*(c for c in df.columns if c != name), name)


def running_totals(df: DataFrame, order: list[str | Column], columns: list[str], prefix: str = "cum_") -> DataFrame:
    """df with the running total (own row included) of each column in the given order; columns are
    cast to double. Whole numbers are exact up to 2^53."""
    held = _ordered(df, order)
    sums = held.groupBy("_part").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).collect()
    within = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with_offsets(held, sums, columns, "double")
    own = lambda c: F.coalesce(F.sum(F.col(c).cast("double")).over(within), F.lit(0.0))
    return out.select(*df.columns, *((own(c) + F.col(f"_before_{c}")).alias(prefix + c) for c in columns))


@dataclass(frozen=True)
class Cut:
    """The n smallest rows by (hash, key) are those of inside()."""

    hash: int
    key: object

    def inside(self, hashed: Column, key: str) -> Column:
        return (hashed < F.lit(self.hash)) | ((hashed == F.lit(self.hash)) & (F.col(key) <= F.lit(self.key)))


def smallest(df: DataFrame, hashes: list[Column], key: str, n: int) -> list[Cut | None]:
    """For each hash (in [0, 2^32)) the cut below which the n smallest rows lie (all where there are no
    more), None where there are none. No sort: a histogram of the upper half of each hash (at most
    65,536 counts) says in which bucket the cut lies; the bucket's rows are ordered on their own, after a
    second histogram by the lower half where they are more than BUCKET_ROWS."""
    if n <= 0:
        return [None] * len(hashes)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), h.alias("h")) for i, h in enumerate(hashes))))
    flat = df.select(key, each.alias("x")).select(key, "x.i", "x.h")
    low: dict[int, int] = {}
    left: dict[int, int] = {}
    size: dict[int, int] = {}

    def narrow(rows: DataFrame, shift: int) -> None:
        counts = rows.groupBy("i", F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        of, bucket, count = (counts[c].to_numpy() for c in ("i", "b", "n"))
        for i in np.unique(of).tolist():
            mine = np.flatnonzero(of == i)
            mine = mine[np.argsort(bucket[mine])]
            ends = np.cumsum(count[mine])
            left[i] = min(left.get(i, n), int(ends[-1]))
            at = int(np.searchsorted(ends, left[i]))
            low[i], size[i] = int(bucket[mine[at]]), int(count[mine[at]])
            left[i] -= int(ends[at]) - size[i]

    def held(which: dict[int, int], shift: int) -> DataFrame:
        mine = F.lit(False)
        for i, at in which.items():
            mine = mine | ((F.col("i") == i) & (F.shiftright("h", shift) == at))
        return flat.where(mine)

    narrow(flat, _HALF)
    wide = {i: at for i, at in low.items() if size[i] > BUCKET_ROWS}
    fine = {i: at for i, at in low.items() if i not in wide}
    if wide:
        narrow(held(wide, _HALF), 0)
    out: list[Cut | None] = [None] * len(hashes)
    if fine:
        # at most BUCKET_ROWS rows a hash
        last = held(fine, _HALF).select("i", "h", F.col(key).alias("key")).toArrow().sort_by([("i", "ascending"), ("h", "ascending"), ("key", "ascending")])
        first = np.searchsorted(last["i"].to_numpy(), sorted(fine))
        for i, start in zip(sorted(fine), first.tolist()):
            row = last.slice(start + left[i] - 1, 1).to_pylist()[0]
            out[i] = Cut(row["h"], row["key"])
    for i in wide:
        ties = held({i: low[i]}, 0).select(key).orderBy(key).limit(left[i]).collect()
        out[i] = Cut(low[i], ties[-1][0])
    return out
