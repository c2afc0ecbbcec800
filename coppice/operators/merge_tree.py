"""The single-linkage merge tree of a spanning tree, without gathering the tree anywhere.

Edges of one length merge together, so a merge has two or more parts and the result does not depend on the order
of ties. The edges are cut into weight bands and contracted band by band: a unit (at first a whole
spanning tree) is halved at its median length; the components of its short edges become units of
their own, and its long edges become a unit whose nodes are those components. Each round halves
all large units at once and handles every edge once, so the rounds are the logarithm of the edges over
``UNIT_EDGES``. Units below that are bundled and settled by tasks; a large unit of one length is a single merge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.linkage import find_roots
from coppice.session import cut

UNIT_EDGES = 1 << 16

_ENDS = ["a", "a_size", "a_w", "b", "b_size", "b_w"]


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, up)``: every node's smallest connected node, by hooking and pointer doubling."""
    left = cut(edges.select(*keys, "a", "b"))
    label = None
    while left.take(1):
        both = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        roots = find_roots(hooks, keys)
        if label is None:
            label = roots
        else:
            to = roots.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
            label = cut(label.join(to, [*keys, "up"], "left").select(*keys, "node", F.coalesce("_up", "up").alias("up")))
        for side in ("a", "b"):
            to = roots.select(*keys, F.col("node").alias(side), F.col("up").alias("_up"))
            left = left.join(to, [*keys, side]).withColumn(side, F.col("_up")).drop("_up")
        left = cut(left.filter("a <> b").distinct())
    return label


def _ends(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of every unit: ``(keys, node, size, born)``, the length at which a node was formed (null: an item)."""
    side = lambda s: F.struct(F.col(s).alias("node"), F.col(f"{s}_size").alias("size"), F.col(f"{s}_w").alias("born"))
    return edges.select(*keys, F.explode(F.array(side("a"), side("b"))).alias("e")).select(*keys, "e.*").dropDuplicates([*keys, "node"])


def _settle(edges: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Merge the units of a bundle in one task, shortest edges first."""
    total = edges.count()
    kinds = dict(edges.dtypes)
    names = [*keys, "child", "child_w", "size", "parent", "parent_w"]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "child long, child_w double, size long, parent long, parent_w double"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", kind="stable")
        unit = pd.factorize(pdf["_unit"])[0]
        m = len(pdf)
        spots = pd.MultiIndex.from_arrays([np.concatenate([unit, unit]), np.concatenate([pdf["a"], pdf["b"]])])
        code, _ = pd.factorize(spots)
        n = int(code.max()) + 1
        first = np.empty(n, np.int64)
        first[code[::-1]] = np.arange(2 * m)[::-1]
        rep = np.concatenate([pdf["a"], pdf["b"]])[first].tolist()
        size = np.concatenate([pdf["a_size"], pdf["b_size"]])[first].tolist()
        born = np.concatenate([pdf["a_w"].to_numpy(float), pdf["b_w"].to_numpy(float)])[first].tolist()
        up, out_of = list(range(n)), []
        a, b, w = code[:m].tolist(), code[m:].tolist(), pdf["w"].tolist()
        edge_keys = [pdf[k].tolist() for k in keys]

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        at = 0
        while at < m:
            to = at + 1
            while to < m and w[to] == w[at]:
                to += 1
            parts = {root(x): i for i in range(at, to) for x in (a[i], b[i])}
            was = [(r, i, rep[r], born[r], size[r]) for r, i in parts.items()]
            for i in range(at, to):
                x, y = root(a[i]), root(b[i])
                if x != y:
                    if size[x] < size[y]:
                        x, y = y, x
                    up[y], size[x], rep[x] = x, size[x] + size[y], min(rep[x], rep[y])
            for r, i, name, formed, n_items in was:
                top = root(r)
                out_of.append((*[k[i] for k in edge_keys], name, formed, n_items, rep[top], w[at]))
            for r, *_ in was:
                born[root(r)] = w[at]
            at = to
        out = pd.DataFrame(out_of, columns=names)
        out["child_w"] = out["child_w"].astype(object).where(out["child_w"].notna(), None)
        return out

    bundle = F.pmod(F.xxhash64(*keys, "unit"), F.lit(max(1, math.ceil(total / limit)))).alias("_bundle")
    rows = edges.select("*", bundle, F.concat_ws("|", *keys, "unit").alias("_unit")).drop("unit")
    return rows.groupBy("_bundle").applyInPandas(settle, schema)


def merge_tree(edges: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """``(keys, child, child_w, size, parent, parent_w)``: the merge that every part goes into.

    ``edges(keys, a, b, w)`` holds one spanning tree for every value of ``keys``. A part is named by its
    smallest item and the length at which it was formed, null for an item; the last merge has no row.
    """
    limit = limit or UNIT_EDGES
    one, none = F.lit(1).cast("long"), F.lit(None).cast("double")
    left = cut(edges.select(*keys, F.lit("").alias("unit"), "w", F.col("a").cast("long").alias("a"), one.alias("a_size"), none.alias("a_w"),
                            F.col("b").cast("long").alias("b"), one.alias("b_size"), none.alias("b_w")))
    own = [*keys, "unit"]
    found = None

    def add(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    while True:
        stats = cut(left.groupBy(*own).agg(F.count("*").alias("_n"), F.min("w").alias("_low"), F.max("w").alias("_high"), F.percentile_approx("w", 0.5).alias("_mid")))
        sized = left.join(stats, own)
        small = cut(sized.filter(F.col("_n") <= limit).select(*left.columns))
        add(_settle(small, keys, limit))
        large = sized.filter(F.col("_n") > limit)
        if not stats.filter(F.col("_n") > limit).take(1):
            break
        flat = _ends(large.filter("_low = _high"), [*own, "w"])
        least = flat.groupBy(*own).agg(F.min("node").alias("parent"))
        add(cut(flat.join(least, own).select(*keys, F.col("node").alias("child"), F.col("born").alias("child_w"), "size", "parent", F.col("w").alias("parent_w"))))
        short = (F.col("w") <= F.col("_mid")) & (F.col("w") < F.col("_high"))
        halves = cut(large.filter("_low < _high").select(*left.columns, short.alias("short")))
        low = halves.filter("short").drop("short")
        roots = components(low, own)
        if roots is None:
            break
        parts = _ends(low, own).join(roots, [*own, "node"]).groupBy(*own, "up").agg(F.sum("size").alias("size"))
        formed = low.join(roots.withColumnRenamed("node", "a"), [*own, "a"]).groupBy(*own, "up").agg(F.max("w").alias("born"))
        joined = cut(parts.join(formed, [*own, "up"]).join(roots, [*own, "up"]))
        below = low.join(roots.withColumnRenamed("node", "a"), [*own, "a"]).withColumn("unit", F.concat("unit", F.lit("/"), F.col("up"))).select(*left.columns)
        above = halves.filter("not short").drop("short")
        for s in ("a", "b"):
            to = joined.select(*own, F.col("node").alias(s), "up", "size", "born")
            rest = [c for c in left.columns if c not in (s, f"{s}_size", f"{s}_w")]
            above = above.join(to, [*own, s], "left").select(
                *rest, F.coalesce("up", s).alias(s), F.coalesce("size", f"{s}_size").alias(f"{s}_size"), F.coalesce("born", f"{s}_w").alias(f"{s}_w"))
        above = above.withColumn("unit", F.concat("unit", F.lit("/h"))).select(*left.columns)
        left = cut(below.unionByName(above))
    return cut(found)
