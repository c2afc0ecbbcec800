"""Density clustering (HDBSCAN) for several minimum sizes and all scopes at once.

1. core distances from a nearest-neighbour pass over distance tiles;
2. the minimum spanning tree of the mutual reachability distances, by Boruvka rounds whose
   cheapest outgoing edges again come from the tiles, for the items that must look again;
3. the exact merge tree of every spanning tree, contracted band by band (:mod:`merge_tree`);
4. the condensed tree, cluster stabilities and the excess-of-mass choice, as joins over the
   merges that reach the minimum size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.operators import blocks as bl
from coppice.operators.linkage import find_roots
from coppice.operators.merge_tree import merge_tree
from coppice.operators.vector_metrics import nearest_centroid
from coppice.functions import vectors as vx
from coppice.session import cut, number_rows

DIGITS = 10
SMALL_TREE = 1 << 16  # condensed clusters that one task may settle
NOISE = -1


def core_distances(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``(id, core)``: per size the distance to that many nearest items, the item itself included."""
    most = max(sizes)

    def nearest(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        d = bl.euclidean(bl.matrix(lp["vec"]), bl.matrix(rp["vec"]))
        d[lp["id"].to_numpy()[:, None] == rp["id"].to_numpy()[None, :]] = 0.0
        m = min(most, d.shape[1])
        return pd.DataFrame({"id": lp["id"], "near": list(np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1))})

    near = bl.over_tiles(rows, rows, nearest, "id long, near array<double>")
    merged = near.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select("id", F.array(*[F.round(F.coalesce(F.get("near", F.lit(s - 1)), F.lit(float("inf"))), DIGITS) for s in sizes]).alias("core"))


def _outside(looking: DataFrame, state: DataFrame, n_sizes: int) -> DataFrame:
    """``(j, id, w, to)``: the cheapest edge out of its component for every item and size number in its list ``js``.

    A task keeps the best of a block of items over all blocks that it meets, so an item has a row for each part of the table.
    """
    mine, others = bl.packed(looking, bl.TILE_ROWS), bl.packed(state, bl.TILE_ROWS)

    def best(lp: pd.DataFrame, rp: pd.DataFrame, held: dict[int, tuple]) -> None:
        rid, rc, rk = rp["id"].to_numpy(), np.stack(rp["comps"].to_numpy()), bl.matrix(rp["core"])
        lc, lk = np.stack(lp["comps"].to_numpy()), bl.matrix(lp["core"])
        d = np.round(bl.euclidean(bl.matrix(lp["vec"]), bl.matrix(rp["vec"])), DIGITS)
        for j in range(n_sizes):
            at = held[j][0]
            if not len(at):
                continue
            m = np.maximum(d if len(at) == len(lp) else d[at], rk[:, j][None, :])
            np.maximum(m, lk[at, j][:, None], out=m)
            m[lc[at, j][:, None] == rc[:, j][None, :]] = np.inf
            to = m.argmin(1)
            w, to = m[np.arange(len(at)), to], rid[to]
            _, low, near = held[j]
            nearer = (w < low) | ((w == low) & (to < near))
            low[nearer], near[nearer] = w[nearer], to[nearer]

    def run(batches):
        key, lp, held = None, None, {}

        def out() -> pa.RecordBatch:
            found = [pd.DataFrame({"j": j, "id": lp["id"].to_numpy()[at], "w": low, "to": near})[np.isfinite(low)] for j, (at, low, near) in held.items()]
            return pa.RecordBatch.from_pandas(pd.concat(found), shape, preserve_index=False)

        for b in batches:
            for i, met in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if met != key:
                    if lp is not None:
                        yield out()
                    key, lp = met, bl.unpacked(b.column(2), i).to_pandas()
                    wants = [np.flatnonzero([j in js for js in lp["js"]]) for j in range(n_sizes)]
                    held = {j: (at, np.full(len(at), np.inf), np.zeros(len(at), np.int64)) for j, at in enumerate(wants)}
                best(lp, bl.unpacked(b.column(3), i).to_pandas().sort_values("id"), held)
        if lp is not None:
            yield out()

    schema = "j int, id long, w double, to long"
    shape = to_arrow_schema(StructType.fromDDL(schema))
    found = bl.block_pairs(mine, others).mapInArrow(run, schema)
    return found.groupBy("j", "id").agg(F.min(F.struct("w", "to")).alias("b")).select("j", "id", "b.w", "b.to")


def spanning_tree(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``(scope, j, lo, hi, w)``: minimum spanning tree per scope and size number.

    An item's cheapest edge stays the cheapest while it leads out of the component, and its length bounds what replaces it,
    so an item looks again only if its edge has come to lie inside and no edge known to leave its component is shorter.
    """
    bl.shared_dir(rows.sparkSession)
    base = cut(rows.join(core_distances(rows, sizes), "id"))
    comps = cut(base.select("scope", "id", F.posexplode(F.array(*[F.col("id") for _ in sizes])).alias("j", "comp")))
    known, edges = None, None
    while True:
        parts = cut(comps.groupBy("scope", "j").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("scope", "j"))
        if parts.isEmpty():
            break
        left = comps.join(parts, ["scope", "j"], "left_semi")
        if known is None:
            need, keep = left.select("j", "id"), None
        else:
            end = comps.select("j", F.col("id").alias("to"), F.col("comp").alias("other"))
            placed = cut(known.join(left.select("j", "id", "comp"), ["j", "id"]).join(end, ["j", "to"]))
            shortest = placed.filter("comp <> other").groupBy("j", "comp").agg(F.min("w").alias("_w"))
            again = (F.col("comp") == F.col("other")) & (F.col("_w").isNull() | (F.col("w") <= F.col("_w")))
            placed = placed.join(shortest, ["j", "comp"], "left").withColumn("again", again)
            need, keep = placed.filter("again").select("j", "id"), placed.filter("not again").select("j", "id", "w", "to")
        state = cut(base.join(comps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "comp"))).alias("cs")).select(
            "id", F.transform("cs", lambda s: s["comp"]).alias("comps")), "id"))
        looking = cut(state.join(need.groupBy("id").agg(F.collect_list("j").alias("js")), "id"))
        found = cut(_outside(looking, state, len(sizes)))
        known = found if keep is None else cut(keep.unionByName(found))
        there = comps.select("j", F.col("id").alias("to"), F.col("comp").alias("other"))
        leaving = known.join(comps.select("j", "id", "comp"), ["j", "id"]).join(there, ["j", "to"]).filter("comp <> other")
        first = F.min(F.struct("w", F.least("id", "to").alias("lo"), F.greatest("id", "to").alias("hi"), "other")).alias("b")
        best = cut(leaving.groupBy("j", "comp").agg(first).select("j", "comp", "b.other", "b.w", "b.lo", "b.hi"))
        if best.isEmpty():  # a scope with fewer items than a size has no edges for it
            break
        chosen = best.select("j", "lo", "hi", "w").distinct()
        edges = chosen if edges is None else edges.unionByName(chosen)
        back = best.select("j", F.col("comp").alias("other"), F.col("other").alias("_back"))
        pointers = best.join(back, ["j", "other"], "left").select(
            "j", F.col("comp").alias("node"),
            F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("up"))
        # a finished scope has no pointers, and nothing points to it
        roots = find_roots(pointers, ["j"]).select("j", F.col("node").alias("comp"), F.col("up").alias("root"))
        comps = cut(comps.join(roots, ["j", "comp"], "left").select("scope", "id", "j", F.coalesce("root", "comp").alias("comp")))
    scopes = base.select(F.col("id").alias("lo"), "scope")
    if edges is None:
        return scopes.select("scope", F.lit(0).alias("j"), "lo", F.col("lo").alias("hi"), F.lit(0.0).alias("w")).limit(0)
    return cut(edges.join(scopes, "lo").select("scope", "j", "lo", "hi", "w"))


def hdbscan(items: DataFrame, sizes: list[int]) -> DataFrame:
    """``(id, scope, k, cluster)`` with ``k`` the minimum size and ``-1`` for noise.

    As many neighbours make an item dense as the minimum size asks for. A scope of which nothing
    but the whole is dense enough is noise altogether. Edges of equal length count as one step of
    the tree, so results do not depend on the order of ties.
    """
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    rows = cut(items.select("id", "vec", scope.alias("scope")))
    keys = ["scope", "j"]
    tree = spanning_tree(rows, sizes)
    every = rows.select("id", "scope", F.posexplode(F.array(*[F.lit(s) for s in sizes])).alias("j", "k"))
    if tree.isEmpty():
        return every.select("id", "scope", "k", F.lit(NOISE).alias("cluster"))
    merges = merge_tree(tree.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b"), "w"), keys)
    name = lambda c, w: F.when(F.col(w).isNotNull(), F.concat_ws(":", c, w))
    none = F.lit(None).cast("double")
    tops = tree.groupBy(*keys).agg(F.min(F.least("lo", "hi")).alias("child"), F.max("w").alias("child_w"), (F.count("*") + 1).alias("size"))
    tops = tops.select(*keys, "child", "child_w", "size", F.lit(None).cast("long").alias("parent"), none.alias("parent_w"))
    nodes = cut(merges.filter("child_w is not null").unionByName(tops).select(
        *keys, name("child", "child_w").alias("comp"), name("parent", "parent_w").alias("parent"), F.col("size").alias("n"), F.col("child_w").alias("eps"), F.col("parent_w").alias("next_eps")))
    size_of = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("j") + 1)
    linked = nodes.filter(F.col("n") >= size_of)
    kids = linked.filter("parent is not null").groupBy(*keys, "parent").agg(F.count("*").alias("kids"))
    only = F.coalesce(F.col("kids") == 1, F.lit(False))
    chain = linked.join(kids, [*keys, "parent"], "left").select(
        *keys, F.col("comp").alias("node"), F.when(only, F.col("parent")).otherwise(F.col("comp")).alias("up"))
    heads = cut(find_roots(chain, keys).select(*keys, F.col("node").alias("comp"), F.col("up").alias("head")))
    inv = lambda c: 1.0 / F.greatest(c, F.lit(1e-12))
    placed = cut(linked.join(heads, [*keys, "comp"]).select(
        *keys, "comp", "head", "parent", (F.col("n") * (inv(F.col("eps")) - inv(F.coalesce("next_eps", "eps")))).alias("mass")))
    mass = placed.groupBy(*keys, "head").agg(F.sum("mass").alias("mass"))
    starts = placed.filter("comp = head").select(*keys, "head", "parent")
    owner = placed.select(*keys, F.col("comp").alias("parent"), F.col("head").alias("above"))
    clusters = cut(mass.join(starts, [*keys, "head"]).join(owner, [*keys, "parent"], "left").select(*keys, "head", "above", "mass"))
    chosen = _choose(clusters, keys)
    # an item belongs to the first merge on its way up that is large enough
    climb = nodes.select(*keys, F.col("comp").alias("node"), F.when(F.col("n") >= size_of, F.col("comp")).otherwise(F.coalesce("parent", "comp")).alias("up"))
    dense = find_roots(climb, keys).join(heads.withColumnRenamed("comp", "up"), [*keys, "up"]).join(chosen, [*keys, "head"]).select(*keys, "node", "cluster_head")
    first = merges.filter("child_w is null").select(*keys, F.col("child").alias("id"), name("parent", "parent_w").alias("node"))
    inside = cut(first.join(dense, [*keys, "node"]).select(*keys, "id", "cluster_head"))
    numbers = inside.groupBy(*keys, "cluster_head").agg(F.min("id").alias("low")).withColumn(
        "cluster", F.row_number().over(W.partitionBy(*keys).orderBy("low")) - 1)
    found = inside.join(cut(numbers.drop("low")), [*keys, "cluster_head"]).select("id", "scope", "j", "cluster")
    return every.join(found, ["id", "scope", "j"], "left").select("id", "scope", "k", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def _choose(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, head, cluster_head)``: the chosen cluster that each cluster's items end up in.

    Condensed trees of at most ``SMALL_TREE`` clusters are settled by a task each, larger ones round by
    round, with equal results.
    """
    sized = cut(clusters.join(clusters.groupBy(*keys).agg((F.count("*") <= SMALL_TREE).alias("_small")), keys))
    large = sized.filter("not _small").drop("_small")
    done = sized.filter("_small").drop("_small").groupBy(*keys).applyInPandas(_settle_tree, "scope int, j int, head string, cluster_head string")
    if large.take(1):
        done = done.unionByName(_topmost(large, _excess_of_mass(large, keys), keys))
    return cut(done)


def _settle_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    above, mass = dict(zip(pdf["head"], pdf["above"])), dict(zip(pdf["head"], pdf["mass"]))
    kids: dict[str | None, list[str]] = {}
    for head, up in above.items():
        kids.setdefault(up if isinstance(up, str) else None, []).append(head)
    order = list(kids.get(None, []))
    for head in order:  # parents first; the list grows while it is read
        order += kids.get(head, [])
    value, chosen, out = {}, {}, {}
    for head in reversed(order):
        below = sum(value[c] for c in kids.get(head, []))
        value[head], chosen[head] = max(mass[head], below), mass[head] >= below
    for head in order:
        up = above[head] if isinstance(above[head], str) else None
        out[head] = out.get(up) or (head if chosen[head] and up is not None else None)
    rows = [(h, c) for h, c in out.items() if c is not None]
    return pd.DataFrame(rows, columns=["head", "cluster_head"]).assign(scope=int(pdf["scope"].iloc[0]), j=int(pdf["j"].iloc[0]))


def _topmost(clusters: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, head, cluster_head)``: the topmost chosen cluster on every cluster's way up; none, no row.

    Pointer doubling: a row knows the topmost chosen cluster of the stretch it has seen, and takes
    over what the end of that stretch knows.
    """
    p = clusters.join(chosen.withColumn("_hit", F.lit(True)), [*keys, "head"], "left").select(
        *keys, "head", F.coalesce("above", "head").alias("up"), F.when(F.col("_hit"), F.col("head")).alias("cluster_head"))
    while True:
        ahead = p.select(*keys, F.col("head").alias("up"), F.col("up").alias("_up"), F.col("cluster_head").alias("_top"))
        p = cut(p.join(ahead, [*keys, "up"]).select(
            *keys, "head", F.col("_up").alias("up"), F.coalesce("_top", "cluster_head").alias("cluster_head"), (F.col("up") != F.col("_up")).alias("_moved")))
        if not p.filter("_moved").take(1):
            return p.filter("cluster_head is not null").select(*keys, "head", "cluster_head")
        p = p.drop("_moved")


def _excess_of_mass(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters at least as stable as the best choice below them; never the whole scope.

    Values rise from the leaves of the condensed tree, one rung of it per round. A chosen cluster
    below another chosen one stays in the list; items take their topmost cluster.
    """
    waiting = clusters
    done = None
    while waiting.take(1):
        held = waiting.select(*keys, F.col("above").alias("head")).distinct()
        ready = waiting.join(held, [*keys, "head"], "left_anti")
        if done is not None:
            below = done.groupBy(*keys, F.col("above").alias("head")).agg(F.sum("value").alias("below"))
            ready = ready.join(below, [*keys, "head"], "left")
        else:
            ready = ready.withColumn("below", F.lit(None).cast("double"))
        below = F.coalesce("below", F.lit(0.0))
        ready = cut(ready.select("*", F.greatest(F.col("mass"), below).alias("value"), (F.col("mass") >= below).alias("chosen")).drop("below"))
        waiting = cut(waiting.join(ready.select(*keys, "head"), [*keys, "head"], "left_anti"))
        done = ready if done is None else cut(done.unionByName(ready))
    return done.filter("chosen and above is not null").select(*keys, "head")


def fold_noise(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Move noise to the nearest cluster mean; a labelling that is all noise is left out."""
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    vectors = items.select("id", "vec", scope.alias("scope"))
    labels = cut(labels)
    configs = number_rows(labels.select("scope", "k").distinct(), ["scope", "k"], "config").withColumn("config", F.col("config").cast("int"))
    rows = cut(labels.join(configs, ["scope", "k"]).join(vectors, ["id", "scope"]))
    means = rows.filter(F.col("cluster") != NOISE).groupBy("config", "cluster").agg(vx.mean_vector(F.col("vec")).alias("vec"))
    groups = means.select(F.col("cluster").cast("long").alias("gid"), "vec", F.col("config").alias("scope"))
    noise = cut(number_rows(rows.filter(F.col("cluster") == NOISE).drop("scope"), ["config", "id"], "_no"))
    near = nearest_centroid(noise.select(F.col("_no").alias("id"), "vec", F.col("config").alias("scope")), groups)
    moved = noise.withColumnRenamed("id", "item").join(near.select(F.col("id").alias("_no"), "gid"), "_no").join(configs, ["config", "k"]).select(
        F.col("item").alias("id"), "scope", "k", F.col("gid").cast("int").alias("cluster"))
    return rows.filter(F.col("cluster") != NOISE).select("id", "scope", "k", "cluster").unionByName(moved)


def hdbscan_sweep(items: DataFrame, sizes: list[int]) -> DataFrame:
    return fold_noise(items, hdbscan(items, sizes))
