"""Spectral clustering on affinities that are never stored.

The leading eigenvectors of D^-1/2 A D^-1/2, with A = exp(-gamma d^2), come from a restarted block Krylov iteration:
a pass brings every two blocks of items of a scope together once, makes their tile of A from the items' vectors and
multiplies it with the newest columns of the basis, so what is written grows with the items and not with their
square, and what is shuffled is a sum for every block and part of the table. Small matrices per scope (basis against basis) reach the driver. A scope leaves the iteration when
the residuals of its wanted eigenvectors are below a tolerance. K-means on the leading k coordinates gives the
clusters, all k at once.

Memory of a task: a tile, a few blocks of BLOCK_ROWS items and _FLUSH bytes of sums. The work of a pass is the square
of a scope's items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import blocks as bl
from coppice.operators.centers import SEED, kmeans_sweep
from coppice.session import cut

GAMMA = 1.0
EXTRA = 8
TOLERANCE = 1e-6
ROUNDS = 200  # a scope that is not below the tolerance by then is an error
BLOCK_ROWS = 512
PART_BLOCKS = 64  # blocks in a part of a table of more than MIN_PARTS parts
BASIS_BLOCKS = 6  # the basis is restarted beyond so many times the wanted columns
_FLUSH = 32 << 20
_STATE = "scope int, block int, blocks int, ids binary, root binary, q binary, aq binary"


def _shaped(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b).reshape(n, -1)


def _blocks(items: DataFrame) -> DataFrame:
    """``(scope, block, blocks, ids, x)``: one row per block of items, in order of their ids."""
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    rows = cut(items.select("id", scope.cast("int").alias("scope"), "vec"))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = rows.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pdf.iloc[:1][["scope", "block", "blocks"]].assign(ids=[pdf["id"].to_numpy(np.int64).tobytes()], x=[bl.matrix(pdf["vec"]).tobytes()])

    return cut(placed.groupBy("scope", "block").applyInPandas(pack, "scope int, block int, blocks int, ids binary, x binary"))


def _multiply(blocks: DataFrame, state: DataFrame, column: str, gamma: float) -> DataFrame:
    """``(scope, block, product)``: the affinity times ``column``, a matrix per block.

    A product of a table with itself: a task reads one part on either side, and of the two ways to meet of a pair of
    blocks one is kept, so that every block is the left one of about half its pairs.
    """
    side = blocks.join(state.select("scope", "block", F.col(column).alias("col")), ["scope", "block"]).select(
        "scope", "block", (F.length("ids") / 8).cast("int").alias("n"), "x", "col")
    side = cut(side)
    parts = min(max(bl.MIN_PARTS, -(-(held := side.count()) // PART_BLOCKS)), held)
    if parts > 1:
        side = cut(side.repartition(parts))
    other = side.select(*[F.col(c).alias(f"_{c}") for c in side.columns])
    i, j = F.col("block"), F.col("_block")
    met = side.join(other, (F.abs(F.col("scope") - F.col("_scope")) < 1) & ((i == j) | ((i < j) == ((i + j) % 2 == 0)))).select(
        "scope", "block", "n", "x", "col", F.col("_block").alias("other"), F.col("_n").alias("m"), F.col("_x").alias("y"), F.col("_col").alias("far"))
    schema = "scope int, block int, product binary"

    def work(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"scope": [k[0] for k in sums], "block": [k[1] for k in sums], "product": [v.tobytes() for v in sums.values()]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.exp(-gamma * bl.squared(_shaped(r.x, r.n), _shaped(r.y, r.m)))
                parts = [(r.block, a @ _shaped(r.far, r.m))]
                if r.block != r.other:
                    parts.append((r.other, a.T @ _shaped(r.col, r.n)))
                for block, p in parts:
                    key = (r.scope, block)
                    held += 0 if key in sums else p.nbytes
                    sums[key] = sums[key] + p if key in sums else p
                if held > _FLUSH:
                    yield out()
                    sums, held = {}, 0
        if sums:
            yield out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(pdf["product"])  # in one order, whatever order they arrive in
        return pdf.iloc[:1].assign(product=[np.sum([np.frombuffer(b) for b in parts], axis=0).tobytes()])

    return met.mapInPandas(work, schema).groupBy("scope", "block").applyInPandas(add, schema)


def _each(state: DataFrame, fn: Callable, schema: str = _STATE) -> DataFrame:
    """``fn(row)`` for every block; it gives the columns that change."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame([{**r._asdict(), **fn(r)}])[names]

    return state.mapInPandas(run, schema)


def _gram(state: DataFrame, pairs: Callable) -> dict[int, list[np.ndarray]]:
    """Per scope the products left' right of ``pairs(row)``, summed inside the tasks."""
    def partial(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                got = [a.T @ b for a, b in pairs(r)]
                sums[r.scope] = [x + y for x, y in zip(sums[r.scope], got)] if r.scope in sums else got
        for scope, got in sums.items():
            for k, g in enumerate(got):
                yield pd.DataFrame({"scope": [scope], "k": [k], "wide": [g.shape[1]], "g": [g.tobytes()]})

    schema = "scope int, k int, wide int, g binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(g=[np.sum([np.frombuffer(b) for b in sorted(pdf["g"])], axis=0).tobytes()])

    out: dict[int, dict[int, np.ndarray]] = {}
    for r in state.mapInPandas(partial, schema).groupBy("scope", "k").applyInPandas(add, schema).collect():
        out.setdefault(r["scope"], {})[r["k"]] = np.frombuffer(r["g"]).reshape(-1, r["wide"])
    return {s: [got[k] for k in sorted(got)] for s, got in out.items()}


def _whitening(g: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """W with W' g W = 1, without directions that g hardly holds."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > values.max() * least
    return vectors[:, keep] / np.sqrt(values[keep])


def _ritz(g: np.ndarray, h: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading values, their coefficients in the basis, and the lengths of their residuals."""
    w = _whitening(g)
    values, vectors = np.linalg.eigh(w.T @ (h + h.T) @ w / 2)
    order = np.argsort(-values, kind="stable")[:width]
    values, y = values[order], w @ vectors[:, order]
    square = np.einsum("ij,ik,kj->j", y, b, y) - 2 * values * np.einsum("ij,ik,kj->j", y, h, y) + values**2 * np.einsum("ij,ik,kj->j", y, g, y)
    return values, y, np.sqrt(np.maximum(square, 0.0))


def embedding(items: DataFrame, dims: int, gamma: float = GAMMA, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``(id, scope, vec, residual)``: the ``dims`` leading eigenvectors, rescaled by the item degrees.

    ``residual`` is the length of the worst residual of the scope's wanted eigenvectors (of unit length; the greatest
    eigenvalue is 1), at most ``tolerance``. A scope of fewer items than ``dims`` has zeros in the columns beyond.
    """
    return _iterate(_blocks(items), dims, gamma, tolerance, rounds)


def _iterate(blocks: DataFrame, dims: int, gamma: float, tolerance: float, rounds: int) -> DataFrame:
    width, keys = dims + EXTRA, ["scope", "block"]

    def ones(r) -> dict:
        return {"q": np.ones(len(r.ids) // 8).tobytes()}

    bare = blocks.select(*keys, "blocks", "ids", F.lit(b"").alias("root"), F.lit(b"").alias("q"), F.lit(b"").alias("aq"))
    one = cut(_each(bare, ones))
    degree = _multiply(blocks, one, "q", gamma).withColumnRenamed("product", "degree")

    def begin(r) -> dict:
        """The root of the degrees is the first eigenvector; the other columns are random, the same for a block every time."""
        root = np.sqrt(np.frombuffer(r.degree))
        other = np.random.default_rng([SEED, r.scope & 0xFFFFFFFF, r.block]).normal(size=(len(root), width - 1))
        return {"root": root.tobytes(), "q": np.column_stack([root, other]).tobytes(), "aq": b""}

    state = cut(_each(one.join(degree, keys), begin))
    # per scope: columns of the basis with a known image, and the fix that makes the newest columns orthonormal
    known = {s: 0 for s in _scopes(state)}
    done = None
    for _ in range(rounds):
        if not known:
            return done if done is not None else _finished(state, {}, dims)
        fix = {}
        for s, (c, g) in _gram(state, lambda r: _newest(r, known)).items():
            fix[s] = (c, _whitening(g - c.T @ c, 1e-10))

        def orthonormal(r) -> dict:
            n = len(r.ids) // 8
            q, root = _shaped(r.q, n), np.frombuffer(r.root)
            old, new = q[:, : known[r.scope]], q[:, known[r.scope] :]
            c, w = fix[r.scope]
            new = (new - old @ c) @ w
            return {"q": np.hstack([old, new]).tobytes(), "fresh": (new / root[:, None]).tobytes()}

        state = cut(_each(state, orthonormal, _STATE + ", fresh binary"))
        image = _multiply(blocks, state, "fresh", gamma)

        def extend(r) -> dict:
            n = len(r.ids) // 8
            got = _shaped(r.product, n) / np.frombuffer(r.root)[:, None]
            return {"aq": (np.hstack([_shaped(r.aq, n), got]) if len(r.aq) else got).tobytes()}

        state = cut(_each(state.join(image, keys), extend))
        turn, ready = {}, {}
        for s, (g, h, b) in _gram(state, _products).items():
            values, y, residual = _ritz(g, h, b, width)
            if residual[:dims].max() <= tolerance:
                ready[s] = (y[:, :dims], float(residual[:dims].max()))
                continue
            open_ = np.flatnonzero(residual > tolerance / 10)
            turn[s] = (values, y, residual, open_, len(g) + len(open_) > BASIS_BLOCKS * width)
        if ready:
            found = cut(_finished(state, ready, dims))
            done = found if done is None else done.unionByName(found)
            state = state.filter(F.col("scope").isin([int(s) for s in turn]))

        def grow(r) -> dict:
            """The basis, or the eigenvectors found so far, and the residuals that are left."""
            n = len(r.ids) // 8
            q, aq = _shaped(r.q, n), _shaped(r.aq, n)
            values, y, residual, open_, restart = turn[r.scope]
            x, ax = q @ y, aq @ y
            rest = (ax[:, open_] - x[:, open_] * values[open_]) / residual[open_]
            q, aq = (x, ax) if restart else (q, aq)
            return {"q": np.hstack([q, rest]).tobytes(), "aq": aq.tobytes()}

        known = {s: (t[1].shape[1] if t[4] else t[1].shape[0]) for s, t in turn.items()}
        if turn:
            state = cut(_each(state, grow))
    if known:
        raise np.linalg.LinAlgError(f"spectral: residuals of scopes {sorted(known)[:10]} above {tolerance} after {rounds} rounds")
    return done


def _scopes(state: DataFrame) -> list[int]:
    return [r["scope"] for r in state.select("scope").distinct().collect()]


def _newest(r, known: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    q = _shaped(r.q, len(r.ids) // 8)
    old, new = q[:, : known[r.scope]], q[:, known[r.scope] :]
    return [(old, new), (new, new)]


def _products(r) -> list[tuple[np.ndarray, np.ndarray]]:
    n = len(r.ids) // 8
    q, aq = _shaped(r.q, n), _shaped(r.aq, n)
    return [(q, q), (q, aq), (aq, aq)]


def _finished(state: DataFrame, ready: dict[int, tuple[np.ndarray, float]], dims: int) -> DataFrame:
    """The items of finished scopes with their coordinates."""
    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.scope in ready:
                    y, residual = ready[r.scope]
                    ids = np.frombuffer(r.ids, np.int64)
                    v = np.zeros((len(ids), dims))
                    v[:, : y.shape[1]] = _shaped(r.q, len(ids)) @ y / np.frombuffer(r.root)[:, None]
                    yield pd.DataFrame({"id": ids, "scope": r.scope, "vec": list(v), "residual": residual})

    return state.mapInPandas(rows, "id long, scope int, vec array<double>, residual double")


def spectral_sweep(items: DataFrame, ks: list[int], gamma: float = GAMMA, starts: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """``(id, scope, k, cluster)`` for every k by k-means on the k leading eigenvectors."""
    return kmeans_sweep(embedding(items, max(ks), gamma, tolerance).drop("residual"), ks, starts, dims=lambda k: k)
