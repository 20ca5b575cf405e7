"""Filling fixed-capacity containers with items of varying length (p8).

Best fit in decreasing order of size, under conflicts. Open bins are ordered by residual capacity
(one list for each residual, and an integer bitmap of the residuals in use that answers "the next
residual of at least s"); each bin carries a bitmap of the sources and one of the duplicate
clusters that it holds. The search for an item starts at its tightest bin and goes on to looser
ones until a compatible bin is found: one without the item's source and cluster. As few containers
as possible is the first aim, so a conflict never opens a container: where no open bin is
compatible, the tightest bin without the item's cluster is taken, else the tightest that fits.

Distribution: items are dealt to shards of about shard_items by a hash of their key, so no source,
cluster or size can make a shard large; each shard is packed alone, and the bins that it leaves
less than CLOSED_AT full are opened again and packed together in a tree of FAN shards a node,
which repeats until one node is left. A node gets at most FAN times the open rest of a shard.

Defined results: an item larger than the capacity fills whole containers with pieces of exactly
the capacity and leaves one smaller piece; no other item is cut. Items of size 0 (empty and null
texts) take a place in a container without using capacity. Null or non-positive capacities are
dropped; an empty table has no rows. Each item gets one row a piece and kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.session import cut

SHARD_ITEMS = 8_000
#: bins at least this full are final; the others are packed again with those of other shards
CLOSED_AT = 0.985
FAN = 8


class Bins:
    """Open bins by residual capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: dict[int, list[int]] = {}
        self.used = 0  # bit r: a bin of residual r is open
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _next(self, residual: int) -> int:
        above = self.used >> residual
        return residual + (above & -above).bit_length() - 1 if above else -1

    def place(self, size: int, source: int, cluster: int) -> int:
        found, tier = -1, 0
        residual = self._next(size)
        while residual >= 0 and tier < 3:
            for b in self.at[residual]:
                fits = 1 if self.clusters[b] >> cluster & 1 else 2 if self.sources[b] >> source & 1 else 3
                if fits > tier:
                    found, tier = b, fits
                    if fits == 3:
                        break
            residual = self._next(residual + 1)
        if found < 0:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            rest = self.at[self.residual[found]]
            rest.remove(found)
            if not rest:
                self.used ^= 1 << self.residual[found]
        self.residual[found] -= size
        self.sources[found] |= 1 << source
        self.clusters[found] |= 1 << cluster
        left = self.residual[found]
        if not self.used >> left & 1:
            self.used |= 1 << left
            self.at[left] = []
        self.at[left].append(found)
        return found


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, residual of each bin). Ties of size are taken in the given order."""
    bins, out = Bins(capacity), np.empty(len(sizes), np.int64)
    source = np.unique(sources, return_inverse=True)[1]
    cluster = np.unique(clusters, return_inverse=True)[1]
    # a cluster met once can't conflict: all those share one bit that is never set
    alone = np.bincount(cluster, minlength=1)[cluster] == 1
    cluster = np.unique(np.where(alone, -1, cluster), return_inverse=True)[1] + 1
    single = int(cluster[alone][0]) if alone.any() else -1
    bins_place = bins.place
    zero_bin = -1
    for i in np.argsort(-sizes, kind="stable").tolist():
        if sizes[i] == 0 and bins.residual:  # uses no capacity: it goes where it meets no search
            zero_bin = 0 if zero_bin < 0 else zero_bin
            out[i] = zero_bin
            continue
        c = int(cluster[i])
        b = out[i] = bins_place(int(sizes[i]), int(source[i]), c)
        if c == single:
            bins.clusters[b] &= ~(1 << c)
    return out, np.array(bins.residual, np.int64)


def containers(df: DataFrame, kinds: DataFrame, key: str = "doc_id", size: str = "n_tokens", source: str = "source", cluster: str = "cluster", kind: str = "container_kind", capacity: str = "capacity_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(kind, container_id, key, piece, piece_size) of every item and kind.

    df: key, size, source, cluster; keys needn't be unique. kinds: a small table of capacities."""
    spark = df.sparkSession
    wanted = [(r[0], int(r[1])) for r in kinds.select(kind, capacity).distinct().limit(1001).collect() if r[1] is not None and r[1] > 0]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    schema = "kind string, shard bigint, box bigint, key string, piece bigint, size bigint, source bigint, cluster bigint, final boolean"
    caps = dict(sorted(wanted))
    items = cut(
        df.select(
            F.col(key).cast("string").alias("key"),
            F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
            F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"),
            F.xxhash64(F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string")))).alias("cluster"),
            F.monotonically_increasing_id().alias("item"),
        )
    )
    total = items.count()
    shards = max(1, -(-total // shard_items))
    offered = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("cap")) for k, c in caps.items())) if caps else F.from_json(F.lit("[]"), "array<struct<kind:string,cap:bigint>>")
    whole = items.withColumn("k", F.explode(offered)).select("key", "size", "source", "cluster", "item", "k.kind", "k.cap")
    # pieces of exactly the capacity are final at once; each is a container of its own
    full = whole.where(F.col("size") > F.col("cap")).select(
        "kind", F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("box"), "key",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("div(size, cap) - 1"))).alias("piece"),
        F.col("cap").alias("size"), "item",
    )
    rest = whole.withColumn("piece", F.when(F.col("size") > F.col("cap"), F.expr("div(size, cap)")).otherwise(F.lit(0)).cast("bigint")).withColumn(
        "left", F.when(F.col("size") > F.col("cap"), F.col("size") % F.col("cap")).otherwise(F.col("size"))
    )
    rest = rest.where((F.col("left") > 0) | (F.col("size") <= F.col("cap"))).select(
        "kind", F.pmod(F.xxhash64("key", "size"), F.lit(shards)).alias("shard"), F.lit(0).cast("bigint").alias("box"),
        "key", "piece", F.col("left").alias("size"), "source", "cluster",
    )

    def fill(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "piece"], kind="stable").reset_index(drop=True)
            cap = caps[pdf["kind"].iloc[0]]
            box, left = pack(pdf["size"].to_numpy(), pdf["source"].to_numpy(), pdf["cluster"].to_numpy(), cap)
            done = left <= (1 - CLOSED_AT) * cap
            return pdf.assign(box=box, final=done[box] | last)[["kind", "shard", "box", "key", "piece", "size", "source", "cluster", "final"]]

        return run

    parts, level = [], 0
    while True:
        last = shards == 1
        packed = cut(rest.groupBy("kind", "shard").applyInPandas(fill(last), schema))
        name = F.concat_ws("-", F.lit(f"{level}"), F.col("shard").cast("string"), F.col("box").cast("string"))
        parts.append(packed.where("final").select("kind", name.alias("container_id"), "key", "piece", "size"))
        if last:
            break
        rest = packed.where("not final").drop("final").withColumn("shard", F.expr(f"div(shard, {FAN})"))
        shards, level = -(-shards // FAN), level + 1
    out = full.select("kind", F.concat_ws("-", F.lit("f"), F.col("item").cast("string"), F.col("piece").cast("string")).alias("container_id"), "key", "piece", "size")
    for part in parts:
        out = out.unionByName(part)
    return out.select(
        F.col("kind").alias(kind), "container_id", F.col("key").cast(df.schema[key].dataType).alias(key),
        "piece", F.col("size").alias("piece_size"),
    )
