"""Clusterings described by a few centres: k-means and Gaussian mixtures, many fits at a time.

A sweep over k, restarts and groups would read the items once per fit and iteration. Here one pass
advances all fits together: the centres of every fit go out with the tasks, each task returns one
partial sum per centre, and the driver only ever holds centres. Starts come from passes over all rows too. ``items(id, vec[, scope])``;
scopes are clustered independently of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import vectors as vx
from coppice.operators import blocks as bl
from coppice.session import cut

SEED = 42
KMEANS_STARTS, KMEANS_ITERATIONS, KMEANS_TOL = 10, 100, 1e-4
GMM_STARTS, GMM_ITERATIONS, GMM_TOL, GMM_RIDGE = 3, 50, 1e-3, 1e-6
GMM_BYTES = 128 << 20  # factors of the mixtures that advance together
TREE_FAN = 16
START_ROUNDS = 2


def _scoped(items: DataFrame) -> DataFrame:
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    return items.select("id", "vec", scope.alias("scope"))


def _pass(items: DataFrame, models: list[dict], work: Callable) -> pd.DataFrame:
    """One pass over the items for all ``models``; ``work(x, model)`` gives one row of sums per centre."""
    by_scope: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        by_scope.setdefault(m["scope"], []).append(i)

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for scope, part in pdf.groupby("scope"):
                x = bl.matrix(part["vec"])
                for i in by_scope.get(scope, []):
                    for c, row in enumerate(work(x, models[i])):
                        key = (i, c)
                        sums[key] = sums[key] + row if key in sums else row
        if sums:
            yield pd.DataFrame({"model": [k[0] for k in sums], "centre": [k[1] for k in sums], "sums": list(sums.values())})

    out = items.mapInPandas(partial, "model int, centre int, sums array<double>")
    return out.groupBy("model", "centre").agg(vx.sum_vector(F.col("sums")).alias("sums")).toPandas()


def _label(items: DataFrame, models: list[dict], assign: Callable) -> DataFrame:
    """``(id, scope, k, cluster)`` under the chosen model of every scope and k."""
    by_scope: dict[int, list[dict]] = {}
    for m in models:
        by_scope.setdefault(m["scope"], []).append(m)

    def label(batches):
        for pdf in batches:
            for scope, part in pdf.groupby("scope"):
                x = bl.matrix(part["vec"])
                for m in by_scope.get(scope, []):
                    yield pd.DataFrame({"id": part["id"], "scope": scope, "k": m["k"], "cluster": assign(x, m)})

    return items.mapInPandas(label, "id long, scope int, k int, cluster int")


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A repeatable number in (0, 1) for every id."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + SEED) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _drawn(items: DataFrame, sets: list[dict], turn: int) -> pd.DataFrame:
    """``(set, key, vec)``: for every set as many rows as it draws, with chances in proportion to their squared distance
    from the set's centres. Keys race (exponential with that rate), so one pass needs no total and a task returns no more
    rows than a set draws."""
    by_scope: dict[int, list[int]] = {}
    for i, m in enumerate(sets):
        by_scope.setdefault(m["scope"], []).append(i)

    def race(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for scope, part in pdf.groupby("scope"):
                x, ids = bl.matrix(part["vec"]), part["id"].to_numpy()
                for i in by_scope.get(scope, []):
                    d = _nearest(x, sets[i])[1]
                    far = np.flatnonzero(d > 1e-12 * (x * x).sum(1))
                    key = -np.log(_uniform(ids[far], 1000 * i + turn)) / d[far]
                    keys, rows = np.concatenate([best[i][0], key]) if i in best else key, np.concatenate([best[i][1], x[far]]) if i in best else x[far]
                    first = np.argsort(keys, kind="stable")[: sets[i]["draws"]]
                    best[i] = (keys[first], rows[first])
        for i, (keys, rows) in best.items():
            if len(keys):
                yield pd.DataFrame({"set": i, "key": keys, "vec": list(rows), "draws": sets[i]["draws"]})

    found = items.mapInPandas(race, "set int, key double, vec array<double>, draws int")
    order = W.partitionBy("set").orderBy("key")
    return found.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("draws")).select("set", "key", "vec").toPandas().sort_values(["set", "key"])


def _spread_out(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """Starting centres drawn from weighted candidates with probability proportional to weight times squared distance."""
    at = [rng.choice(len(x), p=weight / weight.sum())]
    near = bl.squared(x, x[at])[:, 0]
    while len(at) < k:
        mass = weight * near
        p = mass / mass.sum() if mass.sum() > 0 else weight / weight.sum()
        at.append(rng.choice(len(x), p=p))
        near = np.minimum(near, bl.squared(x, x[at[-1:]])[:, 0])
    return x[at]


def _starts(items: DataFrame, ks: list[int], starts: int, dims: Callable[[int], int | None]) -> tuple[list[dict], dict]:
    """Starting models by oversampling passes over all rows, for every k, start and scope at once.

    A set of candidates belongs to a scope, a start and a width, and serves every k of that width: it begins
    with one row, and ``START_ROUNDS`` passes draw twice the largest k more, far rows first. A last
    pass counts the rows nearest to each candidate; the k centres are drawn from the weighted candidates.
    """
    first = [F.min_by("vec", F.struct(F.xxhash64("id", F.lit(SEED + s)), F.col("id"))).alias(f"v{s}") for s in range(starts)]
    squares = F.transform("vec", lambda v: v * v)
    stats = items.groupBy("scope").agg(F.count("*").alias("n"), vx.sum_vector(F.col("vec")).alias("total"), vx.sum_vector(squares).alias("squares"), *first).collect()
    sizes = {r["scope"]: r["n"] for r in stats}
    sets, still = [], {}
    for r in sorted(stats, key=lambda r: r["scope"]):
        fits: dict[int | None, list[int]] = {}
        for k in ks:
            if k < r["n"]:
                fits.setdefault(dims(k), []).append(k)
        mean = np.array(r["total"]) / r["n"]
        var = np.maximum(np.array(r["squares"]) / r["n"] - mean * mean, 0.0)
        for width, own in fits.items():
            still[r["scope"], width] = KMEANS_TOL * max(float(var[:width].mean()), 1e-12)
            for s in range(starts):
                sets.append({"scope": r["scope"], "start": s, "width": width, "ks": own, "draws": 2 * max(own), "centres": np.array([r[f"v{s}"]], float)[:, :width]})
    for turn in range(START_ROUNDS if sets else 0):
        got = _drawn(items, sets, turn)
        for i, part in got.groupby("set"):
            sets[i]["centres"] = np.concatenate([sets[i]["centres"], bl.matrix(part["vec"])[:, : sets[i]["width"]]])
    if not sets:
        return [], sizes
    held = [np.zeros(len(m["centres"])) for m in sets]
    got = _pass(items, sets, lambda x, m: np.bincount(_nearest(x, m)[0], minlength=len(m["centres"]))[:, None].astype(float))
    for i, c, sums in zip(got["model"], got["centre"], got["sums"]):
        held[i][c] += sums[0]
    models = []
    for m, weight in zip(sets, held):
        for k in m["ks"]:
            centres = _spread_out(m["centres"], weight, k, np.random.RandomState(SEED + m["start"]))
            models.append({"scope": int(m["scope"]), "k": k, "start": m["start"], "centres": centres, "cost": np.inf, "still": still[m["scope"], m["width"]]})
    return sorted(models, key=lambda m: (m["scope"], m["k"], m["start"])), sizes


def _nearest(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    d = bl.squared(x[:, :m["centres"].shape[1]], m["centres"])
    return d.argmin(1), d.min(1)


def _kmeans_work(x: np.ndarray, m: dict) -> np.ndarray:
    """Per centre: count, cost, sum of vectors."""
    lab, d = _nearest(x, m)
    dim = m["centres"].shape[1]
    hot = np.zeros((m["k"], len(x)))
    hot[lab, np.arange(len(x))] = 1.0
    return np.hstack([hot.sum(1, keepdims=True), hot @ d[:, None], hot @ x[:, :dim]])


def kmeans_models(items: DataFrame, ks: list[int], starts: int = KMEANS_STARTS, iterations: int = KMEANS_ITERATIONS,
                  dims: Callable[[int], int | None] = lambda k: None) -> list[dict]:
    """Fitted models of every scope, k and start. ``dims(k)`` limits a fit to leading coordinates."""
    models, _ = _starts(items, ks, starts, dims)
    live = models
    for _ in range(iterations):
        if not live:
            break
        got = _pass(items, live, _kmeans_work)
        cost = np.zeros(len(live))
        new = [m["centres"].copy() for m in live]
        for i, c, sums in zip(got["model"], got["centre"], got["sums"]):
            cost[i] += sums[1]
            if sums[0] > 0:
                new[i][c] = np.asarray(sums[2:]) / sums[0]
        still = []
        for m, centres, total in zip(live, new, cost):
            moved = ((centres - m["centres"]) ** 2).sum()
            m["centres"], m["cost"] = centres, total
            if moved > m["still"]:
                still.append(m)
        live = still
    return models


def _best(models: list[dict], n: int = 1) -> list[dict]:
    groups: dict[tuple, list[dict]] = {}
    for m in models:
        groups.setdefault((m["scope"], m["k"]), []).append(m)
    return [m for g in groups.values() for m in sorted(g, key=lambda m: (m["cost"], m["start"]))[:n]]


def kmeans_sweep(items: DataFrame, ks: list[int], starts: int = KMEANS_STARTS, iterations: int = KMEANS_ITERATIONS,
                 dims: Callable[[int], int | None] = lambda k: None) -> DataFrame:
    """``(id, scope, k, cluster)`` of the cheapest of ``starts`` fits for every scope and k."""
    rows = cut(_scoped(items))
    return _label(rows, _best(kmeans_models(rows, ks, starts, iterations, dims)), lambda x, m: _nearest(x, m)[0])


def reduce_dims(items: DataFrame, dims: int) -> DataFrame:
    """Project the vectors on their leading principal components."""
    rows = items.withColumn("_v", array_to_vector("vec"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(rows)
    return model.transform(rows).withColumn("vec", vector_to_array("_p")).drop("_v", "_p")


def _unpack(packed: np.ndarray, d: int) -> np.ndarray:
    """Upper triangular matrices from their packed rows."""
    out = np.zeros((len(packed), d, d))
    out[:, *np.triu_indices(d)] = packed
    return out


def _log_density(x: np.ndarray, m: dict) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), m["k"]))
    for c, packed in enumerate(m["factors"]):
        factor = _unpack(packed[None], d)[0]
        z = (x - m["centres"][c]) @ factor
        out[:, c] = m["log_weights"][c] - 0.5 * (z * z).sum(1) + np.log(np.diag(factor)).sum()
    return out - 0.5 * d * np.log(2 * np.pi)


def _gmm_work(x: np.ndarray, m: dict) -> np.ndarray:
    """Per component: weight, log-likelihood share, weighted sums of offsets from its centre and of their packed products."""
    if m["factors"] is None:
        share = np.zeros((len(x), m["k"]))
        share[np.arange(len(x)), _nearest(x, m)[0]] = 1.0
        fit = np.zeros(len(x))
    else:
        logs = _log_density(x, m)
        top = logs.max(1, keepdims=True)
        fit = (top + np.log(np.exp(logs - top).sum(1, keepdims=True)))[:, 0]
        share = np.exp(logs - fit[:, None])
    d = x.shape[1]
    upper = np.triu_indices(d)
    out = np.empty((m["k"], 2 + d + len(upper[0])))
    out[:, 0], out[:, 1] = share.sum(0), share.T @ fit
    for c in range(m["k"]):
        y = x - m["centres"][c]
        weighted = y * share[:, c : c + 1]
        out[c, 2 : 2 + d] = weighted.sum(0)
        out[c, 2 + d :] = (weighted.T @ y)[upper]
    return out


def _factored(row: np.ndarray, d: int) -> np.ndarray:
    """Weight, fit, the centre's move and the packed factor P of the inverse covariance P P' from a component's sums."""
    n = row[0] + 1e-10
    move = row[2 : 2 + d] / n
    half = _unpack(row[None, 2 + d :], d)[0] / n
    cov = half + np.triu(half, 1).T - np.outer(move, move)
    values, vectors = np.linalg.eigh(cov)
    root = np.linalg.cholesky((vectors * np.maximum(values, 0.0)) @ vectors.T + GMM_RIDGE * np.eye(d))
    return np.concatenate([[n, row[1]], move, np.linalg.inv(root).T[np.triu_indices(d)]])


_PARTS = "model int, centre int, part int, sums binary"


def _moments(items: DataFrame, models: list[dict], d: int) -> pd.DataFrame:
    """``(model, centre, sums)``: a pass over the items, its sums added ``TREE_FAN`` at a time and factored in tasks."""
    by_scope: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        by_scope.setdefault(m["scope"], []).append(i)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for scope, part in pdf.groupby("scope"):
                x = bl.matrix(part["vec"])
                for i in by_scope.get(scope, []):
                    rows = _gmm_work(x, models[i])
                    sums[i] = sums[i] + rows if i in sums else rows
        at = TaskContext.get().partitionId()
        for i, rows in sums.items():
            yield pd.DataFrame({"model": i, "centre": range(len(rows)), "part": at, "sums": [r.tobytes() for r in rows]})

    def added(pdf: pd.DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(b) for b in pdf.sort_values("part")["sums"]], axis=0)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(sums=[added(pdf).tobytes()])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(sums=[_factored(added(pdf), d).tobytes()])

    parts, n = items.mapInPandas(partial, _PARTS), items.rdd.getNumPartitions()
    while n > TREE_FAN:
        parts = parts.withColumn("part", F.floor(F.col("part") / TREE_FAN).cast("int")).groupBy("model", "centre", "part").applyInPandas(join, _PARTS)
        n = -(-n // TREE_FAN)
    return parts.groupBy("model", "centre").applyInPandas(settle, _PARTS).select("model", "centre", "sums").toPandas()


def _advance(m: dict, rows: pd.DataFrame, d: int) -> None:
    """One step of a fit from its factored sums."""
    s = np.zeros((m["k"], 2 + d + d * (d + 1) // 2))
    s[rows["centre"].to_numpy()] = [np.frombuffer(b) for b in rows["sums"]]
    n, fit, started = s[:, 0], s[:, 1].sum(), m["factors"] is not None
    m["centres"], m["log_weights"], m["factors"] = m["centres"] + s[:, 2 : 2 + d], np.log(n / n.sum()), s[:, 2 + d :]
    cost = -fit / n.sum() if started else np.inf
    m["converged"] = bool(started and abs(m["cost"] - cost) < GMM_TOL)
    m["cost"] = cost


def _turns(models: list[dict], d: int, limit: int) -> list[list[dict]]:
    """Fits that advance together: their factors stay below ``limit`` bytes, or they are the starts of one scope and k."""
    groups: dict[tuple, list[dict]] = {}
    for m in models:
        groups.setdefault((m["scope"], m["k"]), []).append(m)
    turns, held = [], limit + 1
    for (_, k), fits in groups.items():
        size = 8 * k * len(fits) * (2 + d + d * (d + 1) // 2)
        if held + size > limit:
            turns.append([])
            held = 0
        turns[-1].extend(fits)
        held += size
    return turns


def gmm_sweep(items: DataFrame, ks: list[int], starts: int = GMM_STARTS, iterations: int = GMM_ITERATIONS, dims: int | None = None,
              turn_bytes: int = GMM_BYTES) -> DataFrame:
    """``(id, scope, k, cluster, converged)`` by full-covariance mixtures started from k-means.

    Covariances have the full width of the vectors; only a caller who passes ``dims`` gets a projection on that many
    principal components. Second moments are packed triangles of offsets from a component's centre. Tasks
    add and factor them, so the driver holds the factors of the fits that advance together, ``turn_bytes`` at most
    unless the starts of one scope and k are larger. ``converged`` is false for a fit that ``iterations`` ended.
    """
    first = items.select("vec").first()
    width = len(first[0]) if first else 1
    d = min(dims or width, width)
    rows = cut(_scoped(reduce_dims(_scoped(items), d) if d < width else items))
    models = _best(kmeans_models(rows, ks, starts), starts)
    for m in models:
        m.update(factors=None, log_weights=None, cost=np.inf, converged=False)
    out = None
    for fits in _turns(models, d, turn_bytes):
        live = fits
        for _ in range(iterations):
            if not live:
                break
            got = _moments(rows, live, d)
            for i, part in got.groupby("model"):
                _advance(live[i], part, d)
            live = [m for m in live if not m["converged"]]
        labels = cut(_label_fits(rows, _best(fits)))
        out = out.unionByName(labels) if out is not None else labels
        for m in fits:
            m["factors"] = None
    return out if out is not None else _label_fits(rows, [])


def _label_fits(rows: DataFrame, models: list[dict]) -> DataFrame:
    done = F.lit(False)
    for m in models:
        if m["converged"]:
            done = done | ((F.col("scope") == m["scope"]) & (F.col("k") == m["k"]))
    return _label(rows, models, lambda x, m: _log_density(x, m).argmax(1)).withColumn("converged", done)


def kmeans(items: DataFrame, k: int, starts: int = KMEANS_STARTS, seed: int = SEED) -> DataFrame:
    """``(id, k, cluster)``: a single k-means by the library estimator, the cheapest of several seeds."""
    rows = cut(items.select("id", array_to_vector("vec").alias("features")))
    fits = [KMeans(k=k, seed=seed + s, initMode="k-means||", predictionCol="cluster").fit(rows) for s in range(starts)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return best.transform(rows).select("id", F.lit(k).alias("k"), "cluster")


def gmm(items: DataFrame, k: int, starts: int = GMM_STARTS, dims: int | None = None) -> DataFrame:
    """``(id, k, cluster, converged)``: a single mixture."""
    return gmm_sweep(items.select("id", "vec"), [k], starts, dims=dims).select("id", "k", "cluster", "converged")
