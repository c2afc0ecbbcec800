"""Centroids and separation metrics of labelled vectors.

``vectors(item_id, features array<double>)``; ``assignments(item_id, config_id, cluster)`` gives any
number of labellings of the same items. All metrics come back per configuration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import vectors as vx
from coppice.operators import blocks as bl
from coppice.session import cut, number_rows

CLUSTER_SLICE = 4096
BLOCK_ITEMS = 2048  # items that a task compares with as many others
FEW = 64  # clusters of a block whose sums are one matrix product
SUMS_HELD = 4096  # sums to clusters met in part that a task keeps
# What an undefined clustering scores.
UNDEFINED = {"silhouette": -1.0, "calinski_harabasz": 0.0, "davies_bouldin": 999.0}


def centroids(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, centroid)``."""
    return labelled.groupBy(*keys).agg(F.count("*").alias("n"), vx.mean_vector(F.col("features")).alias("centroid"))


def own_centroid_distance(labelled: DataFrame, keys: list[str], metric: str = "euclidean") -> DataFrame:
    """Every item with its distance to its own group's centroid."""
    measure = vx.euclidean if metric == "euclidean" else vx.cosine_distance
    joined = labelled.join(cut(centroids(labelled, keys)), keys)
    return joined.select(*labelled.columns, "n", measure(F.col("features"), F.col("centroid")).alias("distance"))


def median_distance(labelled: DataFrame, keys: list[str], metric: str = "cosine") -> DataFrame:
    """``(keys, n, median_distance)`` by position in a distributed sort, so no group is gathered."""
    far = own_centroid_distance(labelled, keys, metric).select(*keys, "item_id", "distance", "n")
    ranked = number_rows(far, ["distance", "item_id"], "_no", within=keys)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = ranked.filter((F.col("_no") == low) | (F.col("_no") == high))
    return middle.groupBy(*keys, "n").agg(F.avg("distance").alias("median_distance"))


def nearest_centroid(items: DataFrame, groups: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, gid, cost)`` of the closest group; see :func:`blocks.best_group` for the columns."""
    return bl.best_group(items, groups, bl.EUCLIDEAN if metric == "euclidean" else bl.COSINE)


def closest_groups(groups: DataFrame) -> DataFrame:
    """``(gid, other, similarity)``: every group's most similar other group by cosine.

    ``groups(gid, vec[, scope])``; with ``scope`` only siblings are compared. The most similar
    pair overall, or per scope, is the maximum of this table: no list of pairs is needed.
    """
    rows = groups.withColumn("id", F.col("gid")).withColumn("own", F.col("gid"))
    near = bl.best_group(rows, groups, bl.COSINE)
    return near.select(F.col("id").alias("gid"), F.col("gid").alias("other"), (1.0 - F.col("cost")).alias("similarity"))


def cluster_numbers(assignments: DataFrame) -> DataFrame:
    """``(config_id, cluster, size, g)``: every cluster of every configuration numbered from 0."""
    sizes = assignments.groupBy("config_id", "cluster").agg(F.count("*").alias("size"))
    return number_rows(sizes, ["config_id", "cluster"], "g").withColumn("g", F.col("g") - 1)


_SUMS = "scope long, block long, c long, kind int, g long, size long, id array<long>, v array<double>"
_OWN, _BEST, _MINE, _PART = range(4)  # kinds of rows: own clusters, nearest whole cluster, sum to the own one, sum to a part of one


class _Block:
    """What the items of one block have to the clusters, as other blocks come by.

    A cluster is settled once all of its members have been met; one that is not is kept as a sum. At most
    ``SUMS_HELD`` sums are kept, so the memory is bounded whatever the number of clusters.
    """

    def __init__(self, key: tuple[int, int], rows: pa.RecordBatch) -> None:
        self.key, self.id, self.x = key, rows.column("id").to_numpy(), _vectors(rows)
        self.own, self.best, self.mine, self.parts = {}, {}, {}, {}
        row, c, g, _ = _labels(rows)
        for k in np.unique(c).tolist():
            self.own[k] = np.full(len(self.id), -1)
            self.own[k][row[c == k]] = g[c == k]

    def settle(self, c: int, g: np.ndarray, size: np.ndarray, sums: np.ndarray, at: slice = slice(None)) -> None:
        """Clusters with the sums of distances to all of their members."""
        n = len(self.id)
        best, mine = self.best.setdefault(c, np.full(n, np.inf)), self.mine.setdefault(c, np.zeros(n))
        hit = self.own[c][at][:, None] == g[None, :] if c in self.own else np.zeros(sums.shape, bool)
        mine[at] += np.where(hit, sums, 0.0).sum(axis=1)
        best[at] = np.minimum(best[at], np.where(hit, np.inf, sums / size[None, :]).min(axis=1))

    def meet(self, rows: pa.RecordBatch, tile_rows: int) -> Iterator[pa.RecordBatch]:
        ids, y = rows.column("id").to_numpy(), _vectors(rows)
        row, config, label, full = _labels(rows)
        groups = []
        for c in np.unique(config).tolist():
            at = np.flatnonzero(config == c)
            at = at[np.argsort(label[at], kind="stable")]
            start = np.flatnonzero(np.r_[True, label[at][1:] != label[at][:-1]])
            groups.append((c, row[at], start, label[at][start], full[at][start], np.diff(np.r_[start, len(at)])))
        for lo in range(0, len(self.id), tile_rows):
            part = slice(lo, min(lo + tile_rows, len(self.id)))
            d = bl.euclidean(self.x[part], y)
            d[self.id[part][:, None] == ids[None, :]] = 0.0
            for c, order, start, g, size, n in groups:
                if len(start) <= FEW:
                    member = np.zeros((len(ids), len(start)))
                    member[order, np.repeat(np.arange(len(start)), n)] = 1.0
                    sums = d @ member
                else:
                    sums = np.add.reduceat(d[:, order], start, axis=1)
                whole = n == size
                if whole.any():
                    self.settle(c, g[whole], size[whole], sums[:, whole], part)
                for j in np.flatnonzero(~whole).tolist():
                    held = self.parts.setdefault(int(g[j]), [c, int(size[j]), 0, np.zeros(len(self.id))])
                    held[3][part] += sums[:, j]
        for c, _, _, g, size, n in groups:
            for j in np.flatnonzero(n != size).tolist():
                held = self.parts[int(g[j])]
                held[2] += int(n[j])
                if held[2] == held[1]:
                    self.settle(c, g[j : j + 1], size[j : j + 1], held[3][:, None])
                    del self.parts[int(g[j])]
        if len(self.parts) > SUMS_HELD:
            yield from self.rows([(c, _PART, g, size, v) for g, (c, size, _, v) in self.parts.items()])
            self.parts = {}

    def rows(self, out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(out), 256):
            c, kind, g, size, v = zip(*out[lo : lo + 256])
            ids = [self.id if k == _OWN else None for k in kind]
            cols = [[self.key[0]] * len(c), [self.key[1]] * len(c), c, kind, g, size, ids, v]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _SHAPE)], schema=_SHAPE)

    def close(self) -> Iterator[pa.RecordBatch]:
        out = [(c, _OWN, 0, 0, own.astype(float)) for c, own in self.own.items()]
        out += [(c, _BEST, 0, 0, v) for c, v in self.best.items()] + [(c, _MINE, 0, 0, v) for c, v in self.mine.items()]
        yield from self.rows(out + [(c, _PART, g, size, v) for g, (c, size, _, v) in self.parts.items()])


def _vectors(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("features").flatten().to_numpy().reshape(rows.num_rows, -1)


def _labels(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, configuration, cluster and size of the cluster for every label of a block."""
    col = rows.column("labels")
    each, flat = col.value_lengths().to_numpy(), col.flatten()
    return np.repeat(np.arange(len(each)), each), *[flat.field(k).to_numpy() for k in ("c", "g", "size")]


_SHAPE = pa.schema([("scope", pa.int64()), ("block", pa.int64()), ("c", pa.int64()), ("kind", pa.int32()), ("g", pa.int64()), ("size", pa.int64()), ("id", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SUMS`` in order of block, configuration, kind and cluster to one row per item and configuration."""
    key = ids = own = None
    best = mine = total = g = size = None

    def fold() -> None:
        if total is not None:
            mine[own == g] += total[own == g]
            np.minimum(best, np.where(own == g, np.inf, total / size), out=best)

    def done() -> pa.RecordBatch:
        fold()
        at = own >= 0
        b = best[at]
        cols = [ids[at], np.full(at.sum(), key[2]), own[at].astype(np.int64), mine[at], pa.array(b, pa.float64(), mask=~np.isfinite(b))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["item_id", "c", "g", "total", "b"])

    for batch in batches:
        heads = zip(*[batch.column(k).to_pylist() for k in ("scope", "block", "c")])
        kinds, names, sizes = (batch.column(k).to_pylist() for k in ("kind", "g", "size"))
        for i, head in enumerate(heads):
            v = batch.column("v")[i].values.to_numpy(zero_copy_only=False)
            if head != key:
                if own is not None:
                    yield done()
                key, own, total, g = head, None, None, None
            if kinds[i] == _OWN:
                if own is None:
                    ids, own = batch.column("id")[i].values.to_numpy(), v.copy()
                    best, mine = np.full(len(own), np.inf), np.zeros(len(own))
            elif own is None:  # no item of the block is labelled in this configuration
                continue
            elif kinds[i] == _BEST:
                np.minimum(best, v, out=best)
            elif kinds[i] == _MINE:
                mine += v
            else:
                if names[i] != g:
                    fold()
                    g, size, total = names[i], sizes[i], np.zeros(len(own))
                total += v
    if own is not None:
        yield done()


def silhouette_values(vectors: DataFrame, assignments: DataFrame, tile_rows: int = bl.TILE_ROWS) -> DataFrame:
    """``(item_id, config_id, a, b, s)``: exact euclidean silhouette of every item.

    One pass over the pairs of blocks serves all configurations. A task keeps, for the block it is at, the nearest
    cluster that it has met as a whole and one sum for each cluster that it has met in part; items of small clusters
    share blocks, so most of these are met as a whole. What leaves a task is a few numbers per item and
    configuration and those sums, not one per pair of blocks. ``vectors`` may carry a ``scope``; configurations then
    label the items of one scope and only those are compared. ``tile_rows`` bounds the rows that a matrix of distances has.
    """
    kind = dict(assignments.dtypes)["config_id"]
    numbers = cut(cluster_numbers(assignments))
    configs = cut(numbers.groupBy("config_id").agg(F.min("g").alias("c")))
    label = F.struct("size", "g", "c")
    wide = (
        assignments.join(cut(numbers.join(configs, "config_id")), ["config_id", "cluster"])
        .groupBy("item_id").agg(F.array_sort(F.collect_list(label)).alias("labels"))
    )
    scope = F.col("scope") if "scope" in vectors.columns else F.lit(0)
    rows = vectors.join(wide, "item_id").select(F.col("item_id").cast("long").alias("id"), scope.cast("long").alias("scope"), F.col("features").cast("array<double>").alias("features"), "labels")
    blocks = bl.packed(rows, BLOCK_ITEMS, [F.col("labels")[0], "id"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if held is None or held.key != key:
                    if held is not None:
                        yield from held.close()
                    held = _Block(key, bl.unpacked(b.column(2), i))
                yield from held.meet(bl.unpacked(b.column(3), i), tile_rows)
        if held is not None:
            yield from held.close()

    found = bl.block_pairs(blocks, blocks).mapInArrow(sums, _SUMS)
    placed = found.repartition("scope", "block").sortWithinPartitions("scope", "block", "c", "kind", "g")
    totals = placed.mapInArrow(_finished, "item_id long, c long, g long, total double, b double")
    sized = totals.join(numbers.select("g", "size"), "g").join(configs, "c")
    a = F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)).otherwise(0.0)
    top = F.greatest("a", "b")
    s = F.when((F.col("size") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return sized.withColumn("a", a).select("item_id", F.col("config_id").cast(kind).alias("config_id"), "a", "b", F.coalesce(s, F.lit(0.0)).alias("s"))


def silhouette_exact(vectors: DataFrame, assignments: DataFrame, tile_rows: int = bl.TILE_ROWS) -> DataFrame:
    """``(config_id, silhouette)``: mean euclidean silhouette."""
    return silhouette_values(vectors, assignments, tile_rows).groupBy("config_id").agg(F.avg("s").alias("silhouette"))


def silhouette_fast(vectors: DataFrame, assignments: DataFrame, measure: str = "squaredEuclidean") -> DataFrame:
    """``(config_id, silhouette)`` on squared euclidean or cosine distance, linear in the items.

    A different number from the euclidean one; rankings must not mix the two. The mean distance of an item to a
    cluster follows from the cluster's count, sum and sum of squares, so all labellings take one aggregation and one
    pass: items meet the clusters in tiles, a labelling's clusters together, and a tile returns one sum per labelling.
    The few labellings with more than ``CLUSTER_SLICE`` clusters look for the nearest cluster instead. A labelling
    with a single cluster is undefined.
    """
    if measure not in ("squaredEuclidean", "cosine"):
        raise ValueError(f"unknown distance measure: {measure}")
    size = vx.norm(F.col("features"))
    unit = F.when(size > 0, F.transform("features", lambda v: v / size)).otherwise(F.col("features"))
    x = unit if measure == "cosine" else F.col("features")
    numbers = cut(cluster_numbers(assignments))
    labelled = cut(assignments.join(numbers.select("config_id", "cluster", "g"), ["config_id", "cluster"]).select("item_id", "g"))
    items = cut(vectors.select("item_id", x.cast("array<double>").alias("features")))
    configs = numbers.groupBy("config_id").agg(F.min("g").alias("scope"), F.count("*").alias("k"))
    sums = labelled.join(items, "item_id").groupBy("g").agg(vx.mean_vector(F.col("features")).alias("vec"), F.avg(vx.dot(F.col("features"), F.col("features"))).alias("w"))
    if measure == "cosine":  # half the squared distance of unit vectors; a zero vector is one away from anything
        sums = sums.withColumn("w", F.lit(1.0))
    clusters = cut(sums.join(numbers.join(configs, "config_id").select("g", "scope", "k", F.col("size").cast("double").alias("size")), "g"))
    cost = MEAN_SQUARED if measure == "squaredEuclidean" else MEAN_COSINE
    few = cut(clusters.filter(F.col("k") <= CLUSTER_SLICE))
    wide = labelled.join(few.select("g"), "g").groupBy("item_id").agg(F.array_sort(F.collect_list("g")).alias("labels"))
    left = items.join(wide, "item_id").select(F.col("item_id").alias("id"), "features", "labels")
    right = few.select(F.col("g").alias("id"), "vec", "w", "size", F.col("scope").alias("config"), F.col("scope").alias("block_key"))

    def tile(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values(["config", "id"])
        g, config, size = rp["id"].to_numpy(), rp["config"].to_numpy(), rp["size"].to_numpy()
        start = np.flatnonzero(np.r_[True, config[1:] != config[:-1]])
        of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(config)]))
        d = cost.value(bl.matrix(lp["features"]), None, bl.matrix(rp["vec"]), rp["w"].to_numpy()[None, :])
        row = np.repeat(np.arange(len(lp)), [len(v) for v in lp["labels"]])
        lab = np.concatenate(lp["labels"].to_numpy())
        col = np.minimum(np.searchsorted(g, lab), len(g) - 1)
        row, col = row[g[col] == lab], col[g[col] == lab]
        own, other = d[row, col] * size[col] / np.maximum(size[col] - 1, 1), d
        other[row, col] = np.inf
        b = np.minimum.reduceat(other, start, axis=1)[row, of[col]]
        top = np.maximum(own, b)
        s = np.where((size[col] > 1) & (top > 0), (b - own) / np.where(top > 0, top, 1.0), 0.0)
        return pd.DataFrame({"scope": config[start], "s": np.bincount(of[col], np.where(np.isfinite(b), s, np.nan), len(start)), "n": np.bincount(of[col], minlength=len(start))})

    total = bl.over_tiles(left, right, tile, "scope long, s double, n long")
    many = clusters.filter(F.col("k") > CLUSTER_SLICE)
    if many.take(1):
        rows = cut(number_rows(labelled.join(many.select("g", F.col("vec").alias("mean"), F.col("w").alias("q"), "size", "scope"), "g").join(items, "item_id"), ["scope", "item_id"], "id"))
        near = bl.best_group(rows.select("id", F.col("features").alias("vec"), F.lit(1.0).alias("w"), F.col("g").alias("own"), "scope"),
                             many.select(F.col("g").alias("gid"), "vec", "w", "scope"), cost)
        inner = vx.dot(F.col("features"), F.col("mean"))
        mean = F.greatest(F.lit(0.0), vx.dot(F.col("features"), F.col("features")) - 2 * inner + F.col("q")) if measure == "squaredEuclidean" else 1.0 - inner
        a, b = mean * F.col("size") / F.greatest(F.col("size") - 1, F.lit(1.0)), F.col("cost")
        top = F.greatest(a, b)
        s = F.when((F.col("size") > 1) & (top > 0), (b - a) / top).otherwise(0.0)
        total = total.unionByName(rows.join(near.select("id", "cost"), "id").select("scope", s.alias("s"), F.lit(1).cast("long").alias("n")))
    mean = total.groupBy("scope").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    return configs.join(mean, "scope").select("config_id", F.coalesce(F.nanvl("silhouette", F.lit(None)), F.lit(UNDEFINED["silhouette"])).alias("silhouette"))


def _mean_squared_floor(x, xw, p, r, lo, hi):
    return bl.outside(x, p, r) ** 2 + np.maximum(lo - (np.linalg.norm(p, axis=1)[None, :] + r) ** 2, 0.0)


# Mean distance to the members of a cluster from its mean and its mean square.
MEAN_SQUARED = bl.Cost(lambda x, xw, y, yw: np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + yw, 0.0), _mean_squared_floor)
MEAN_COSINE = bl.Cost(lambda x, xw, y, yw: 1.0 - x @ y.T, lambda x, xw, p, r, lo, hi: 1.0 - x @ p.T - np.linalg.norm(x, axis=1, keepdims=True) * r)


def silhouette(vectors: DataFrame, assignments: DataFrame, kind: str = "euclidean") -> DataFrame:
    """``(config_id, silhouette, silhouette_kind)``: the kind the caller names, at every size.

    "euclidean" is exact and meets every item with every other; "squared" is linear in the items.
    """
    if kind not in ("euclidean", "squared"):
        raise ValueError(f"unknown silhouette kind: {kind}")
    got = silhouette_exact(vectors, assignments) if kind == "euclidean" else silhouette_fast(vectors, assignments)
    return got.withColumn("silhouette_kind", F.lit(kind))


def _cluster_sums(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    x = F.col("features")
    return assignments.join(vectors, "item_id").groupBy("config_id", "cluster").agg(
        F.count("*").alias("n"), vx.sum_vector(x).alias("total"), F.sum(vx.dot(x, x)).alias("squares"))


def calinski_harabasz(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """``(config_id, calinski_harabasz)`` from one aggregation: counts, sums and sums of squares."""
    per = _cluster_sums(vectors, assignments).withColumn("spread", vx.dot(F.col("total"), F.col("total")) / F.col("n"))
    whole = per.groupBy("config_id").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("spread").alias("spread"),
        F.sum("squares").alias("squares"), vx.sum_vector(F.col("total")).alias("total"))
    between = F.col("spread") - vx.dot(F.col("total"), F.col("total")) / F.col("n")
    inside = F.col("squares") - F.col("spread")
    value = F.when(inside <= 0, 1.0).otherwise(between * (F.col("n") - F.col("k")) / (inside * (F.col("k") - 1)))
    ok = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    return whole.select("config_id", F.when(ok, value).otherwise(UNDEFINED["calinski_harabasz"]).alias("calinski_harabasz"))


def _davies_cost(x, xw, y, yw):
    d = bl.euclidean(x, y)
    return -np.divide(xw + yw, d, out=np.zeros_like(d), where=d > 0)


def _davies_floor(x, xw, p, r, lo, hi):
    d = bl.outside(x, p, r)
    return -np.divide(xw + hi, d, out=np.full_like(d, np.inf), where=d > 0)


DAVIES = bl.Cost(_davies_cost, _davies_floor)


def davies_bouldin(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """``(config_id, davies_bouldin)``: mean over clusters of the worst (s_i + s_j) / d_ij."""
    numbers = cut(cluster_numbers(assignments))
    config = numbers.groupBy("config_id").agg(
        F.min("g").alias("scope"), F.count("*").alias("k"), F.sum("size").alias("n"))
    labelled = assignments.join(vectors, "item_id").select("item_id", "config_id", "cluster", "features")
    spread = own_centroid_distance(labelled, ["config_id", "cluster"]).groupBy("config_id", "cluster").agg(
        F.avg("distance").alias("w"))
    groups = cut(
        centroids(labelled, ["config_id", "cluster"]).join(spread, ["config_id", "cluster"])
        .join(numbers.select("config_id", "cluster", "g"), ["config_id", "cluster"])
        .join(config.select("config_id", "scope"), "config_id")
        .select(F.col("g").alias("gid"), F.col("centroid").alias("vec"), "w", "scope"))
    rows = groups.withColumn("id", F.col("gid")).withColumn("own", F.col("gid"))
    worst = bl.best_group(rows, groups, DAVIES).select(F.col("id").alias("g"), (-F.col("cost")).alias("worst"))
    mean = numbers.join(worst, "g").groupBy("config_id").agg(F.avg("worst").alias("value"))
    ok = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    return config.join(mean, "config_id", "left").select(
        "config_id", F.when(ok, F.col("value")).otherwise(UNDEFINED["davies_bouldin"]).alias("davies_bouldin"))


def internal_metrics(vectors: DataFrame, assignments: DataFrame, n: int) -> DataFrame:
    """``(config_id, silhouette, silhouette_kind, calinski_harabasz, davies_bouldin)``."""
    ok = assignments.groupBy("config_id").agg(F.countDistinct("cluster").alias("k")).withColumn(
        "ok", (F.col("k") >= 2) & (F.col("k") < n))
    usable = assignments.join(ok.filter("ok").select("config_id"), "config_id", "left_semi")
    return (
        ok.select("config_id")
        .join(silhouette(vectors, usable), "config_id", "left")
        .join(calinski_harabasz(vectors, assignments), "config_id")
        .join(davies_bouldin(vectors, assignments), "config_id")
        .fillna(UNDEFINED["silhouette"], subset=["silhouette"])
    )
