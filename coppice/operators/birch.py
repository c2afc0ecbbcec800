"""BIRCH: compress items into small clustering features, then merge those bottom-up.

A feature is (count, sum, sum of squares), so features can be united without their items. Items are absorbed
block by block, then the features of two blocks are united under the same radius rule, level by level, until a scope has one
list. Blocks follow from a scope's own size and ids: a scope's features do not depend on what is beside it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import blocks as bl
from coppice.operators.linkage import cut_tree, dendrogram, find_roots
from coppice.session import cut

RADIUS = 0.5
BLOCK_ROWS = 2048
#: Features that a list may hold; beyond that the radius grows until it fits, as BIRCH rebuilds a full tree.
MAX_FEATURES = 1 << 15
GROWTH = 1.2
#: Parts whose distances to the features that are there are one matrix product.
AT_ONCE = 128
#: For rounding in that product, as a share of the squared lengths; what is that near is measured again.
SLACK = 1e-10

_FEATURE = "n double, total array<double>, squares double"


class Features:
    """A list of features that absorbs others; of equally near features the earliest wins."""

    def __init__(self, dim: int, radius: float) -> None:
        self.radius, self.names, self.m = radius, [], 0
        self.n, self.squares, self.total, self.centre = np.zeros(16), np.zeros(16), np.zeros((16, dim)), np.zeros((16, dim))

    def absorb(self, parts: list[tuple[int, float, np.ndarray, float]], most: int) -> list[int] | None:
        """The names of the features that took the parts in, in their order; None as soon as there are more than ``most``.

        A product gives the distances of some parts to all features; those that may be the nearest, and those that have
        changed since, are measured anew for each part, so the result is that of measuring all of them.
        """
        out = []
        for lo in range(0, len(parts), AT_ONCE):
            some = parts[lo : lo + AT_ONCE]
            x, m = np.stack([total / n for _, n, total, _ in some]), self.m
            xx, cc = (x * x).sum(axis=1), (self.centre[:m] * self.centre[:m]).sum(axis=1)
            d = (-2.0 * x) @ self.centre[:m].T
            d += cc
            d += xx[:, None]
            slack = SLACK * (xx + cc.max(initial=0.0))
            changed: set[int] = set()
            for part, v, row, more in zip(some, x, d, slack):
                least = row.min(initial=np.inf)
                near = np.flatnonzero(np.isnan(row)) if np.isnan(least) else np.flatnonzero(row <= least + more) if least < np.inf else []
                at = self._take(part, v, np.sort(np.array([*changed.union(near)], np.int64)))
                out.append(self.names[at])
                if at not in changed:
                    changed.add(at)
                    if at < m:
                        d[:, at] = np.inf
            if self.m > most:
                return None
        return out

    def _take(self, part: tuple[int, float, np.ndarray, float], v: np.ndarray, candidates: np.ndarray) -> int:
        """The place of the feature that took the part in: the nearest of the candidates, or a new one."""
        name, n, total, squares = part
        if len(candidates):
            c = int(candidates[((self.centre[candidates] - v) ** 2).sum(axis=1).argmin()])
            size, both, sq = self.n[c] + n, self.total[c] + total, self.squares[c] + squares
            mean = both / size
            if max(sq / size - mean @ mean, 0.0) <= self.radius * self.radius:
                self.n[c], self.total[c], self.squares[c], self.centre[c] = size, both, sq, mean
                return c
        m = self.m
        if m == len(self.n):
            self.n, self.squares = (np.concatenate([v, np.zeros(m)]) for v in (self.n, self.squares))
            self.total, self.centre = (np.concatenate([v, np.zeros_like(v)]) for v in (self.total, self.centre))
        self.n[m], self.total[m], self.squares[m], self.centre[m] = n, total, squares, total / n
        self.names.append(name)
        self.m += 1
        return m


def unite(parts: Iterable[tuple[int, float, np.ndarray, float]], dim: int, radius: float, most: int) -> tuple[Features, dict[int, int]]:
    """Absorb parts in order; if more than ``most`` features are left, once more with a larger radius."""
    parts = list(parts)
    while True:
        out = Features(dim, radius)
        into = out.absorb(parts, most)
        if into is not None:
            return out, {p[0]: name for p, name in zip(parts, into)}
        radius *= GROWTH


def features(items: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """``(id, scope, feature)``, the feature every item is absorbed in, named after its first item, and the
    features ``(scope, id, n, total, squares)``."""
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    rows = items.select("id", F.col("vec").cast("array<double>").alias("vec"), scope.cast("int").alias("scope"))
    # a power of two, so that blocks pair up level by level
    sizes = rows.groupBy("scope").agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.count("*") / BLOCK_ROWS, F.lit(1.0))))).cast("long").alias("blocks"))
    sizes = cut(sizes)
    most = MAX_FEATURES
    out = f"scope int, block long, blocks long, name long, up long, {_FEATURE}"

    def frame(pdf: pd.DataFrame, got: Features, into: dict[int, int]) -> pd.DataFrame:
        kept = {name: i for i, name in enumerate(got.names)}
        at = [kept.get(name, -1) for name in into]
        table = pd.DataFrame({"name": list(into), "up": list(into.values())})
        table["n"] = [got.n[i] if i >= 0 else None for i in at]
        table["total"] = [got.total[i] if i >= 0 else None for i in at]
        table["squares"] = [got.squares[i] if i >= 0 else None for i in at]
        return table.assign(scope=int(pdf["scope"].iloc[0]), block=int(pdf["block"].iloc[0]), blocks=int(pdf["blocks"].iloc[0]))

    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = bl.matrix(pdf["vec"])
        got, into = unite(((i, 1.0, v, float(v @ v)) for i, v in zip(pdf["id"].tolist(), x)), x.shape[1], radius, most)
        return frame(pdf, got, into)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["half", "name"])
        x = bl.matrix(pdf["total"])
        got, into = unite(zip(pdf["name"].tolist(), pdf["n"].tolist(), x, pdf["squares"].tolist()), x.shape[1], radius, most)
        return frame(pdf, got, into)

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    level = cut(rows.join(sizes, "scope").select("id", "vec", "scope", "blocks", block).groupBy("scope", "block").applyInPandas(absorb, out))
    pointers = level.select("scope", F.col("name").alias("node"), "up")
    while level.filter("blocks > 1").take(1):
        live = level.filter("n is not null").drop("up")
        done = live.filter("blocks = 1").withColumn("up", F.col("name")).select(*level.columns)
        paired = live.filter("blocks > 1").withColumn("half", F.col("block") % 2).withColumn("block", F.floor(F.col("block") / 2)).withColumn("blocks", F.floor(F.col("blocks") / 2))
        united = cut(paired.groupBy("scope", "block").applyInPandas(merge, out))
        moved = united.filter("name <> up").select("scope", F.col("name").alias("node"), F.col("up").alias("_to"))
        # a name is absorbed once; until then it points to itself
        pointers = cut(pointers.join(moved, ["scope", "node"], "left").select("scope", "node", F.coalesce("_to", "up").alias("up")))
        level = cut(done.unionByName(united))
    found = find_roots(pointers, ["scope"]).select(F.col("node").alias("id"), "scope", F.col("up").alias("feature"))
    return found, cut(level.filter("n is not null").select("scope", F.col("name").alias("id"), "n", "total", "squares"))


def birch(items: DataFrame, ks: list[int], radius: float = RADIUS) -> DataFrame:
    """``(id, scope, k, cluster)``: Ward merging of the features, weighted by their items."""
    found, summed = features(items, radius)
    summed = summed.select("scope", "id", F.transform("total", lambda v: v / F.col("n")).alias("vec"), F.col("n").alias("w"))
    merged = cut_tree(summed, dendrogram(summed, "ward"), ks)
    return found.join(merged.withColumnRenamed("id", "feature"), ["feature", "scope"]).select("id", "scope", "k", "cluster")
