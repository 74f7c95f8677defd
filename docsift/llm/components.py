"""Connected components of an edge table, without gathering edges anywhere.

Union-find within each partition first turns its edges into a forest. Then large-star and small-star steps alternate
until nothing changes; every step is a combinable minimum and a join on the node, so a hub is no task's burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import stash


class UnionFind:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while (up := p.get(x, x)) != root:
            p[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    found = UnionFind()

    def flush() -> pa.RecordBatch:
        nodes = [x for x in found.parent if found.find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([found.find(x) for x in nodes], pa.int64())], names=["u", "v"])
        found.parent.clear()
        return out

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.union(u, v)
        if len(found.parent) > most:
            yield flush()
    if found.parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, component): the smallest node reachable, for nodes with an edge."""
    e = edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct()
    e, mark = stash(e, "edges"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stash(small, "edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = (now.n, now.h)
