"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node and a join; a node with very many links is only ever aggregated or
joined, never gathered. Before that, tasks replace the links they hold, about LOCAL each, by a spanning forest,
as long as that halves them: a large group of copies has far more links than it needs. Once at most LOCAL links are left, one task finishes them: the answer is the
same, the least node of each component, and the bound does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import discard, settle

LOCAL = 200_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours get linked to the node's least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # a > b: the smaller neighbours of a
        both = edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = both.join(least, "a")
    out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of a partition: node, least node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "component"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same components: each node of the partition to the least one it hangs together with."""
    for b in _finish(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """Links a, b (long) to node, component (its least node), for every node that has a link."""
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0] > local > 0:
        before, count = edges, last[0]
        edges = settle(before.coalesce(-(-count // local)).mapInArrow(_forest, "a long, b long").filter("a <> b").distinct())
        discard(before)
        last = mark(edges)
        if 2 * last[0] > count:
            break
    while last[0] > local:
        before, edges = edges, settle(_stars(_stars(edges, True), False))
        discard(before)
        now = mark(edges)
        if now == last:  # stable: every edge leads from a node to its component
            out = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
            discard(edges)
            return out
        last = now
    out = settle(edges.coalesce(1).mapInArrow(_finish, "node long, component long"))
    discard(edges)
    return out
