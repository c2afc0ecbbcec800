"""Embedding whitening from a blockwise QR of centred rows and a bidiagonal qd solver.

Components become integers x = floor(SCALE * c) + OFFSET. The fit list holds every distinct x vector once; n is
its length, S its sums, both exact. Tasks reduce the centred rows (n * x - S) / n, subtracted as integers, to
a triangle by QR, block after block; triangles are stacked and reduced again in three shrinking levels, so a task
holds one block and one triangle whatever the number of rows. The last triangle has as many rows as a
vector has components and is solved by ``bidiagonal.right_singular``: R'R is n times the covariance.

A third of all rows may be one vector: equal vectors are put together before anything is shuffled, and
the result needs no join, since every row is whitened where it is read.

Defined cases: vectors that are null, hold a null or non-finite component, or have another length than
most are dropped; repeated rows count once in the fit and come back each; null ids stay null; directions
without variance are not components, so fewer than ``components`` (none for one distinct vector) may come back; a deviation
beyond 64 bits is null; components whose integer arithmetic would pass 64 bits raise ValueError; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.bidiagonal import right_singular
from coppice.llm.common import discard, ready, settle
from coppice.llm.vectors import common_length, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows reduced together with the triangle so far.
BLOCK = 4096
#: Groups of triangles, level by level.
LEVELS = (64, 8, 1)


@dataclass(frozen=True)
class Fit:
    """What whitening needs: n, sums, directions as columns, their eigenvalues and the trace of the covariance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def integers(vec: Column) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gaps(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    if len(x) and n * max(int(x.max()), -int(x.min())) + int(np.abs(sums).max()) >= 2**63:
        raise ValueError("components are too large for 64 bits")
    return x * np.int64(n) - sums


def deviations(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row as Python integers or 64-bit ones; null beyond 64 bits."""
    most = max(int(d.max()), -int(d.min())) if d.size else 0
    if most * most * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in d.tolist())
    return [e if e < 2**63 else None for e in exact]


def _sums(rows: DataFrame, of: str, cells: int, kind: str, make) -> dict[int, float]:
    """Add arrays of ``cells`` numbers that tasks make from their rows; Spark adds them cell by cell."""
    name = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = make(b.column(0))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total.reshape(-1), name)], names=["cell", "s"])

    part = rows.select(of).mapInArrow(run, f"cell long, s {kind}")
    return {r["cell"]: r["s"] for r in part.groupBy("cell").agg(F.sum("s").alias("s")).collect()}


def reduce_rows(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """The triangle of all rows, a block at a time."""
    r = np.zeros((0, dim))
    for x in blocks:
        for at in range(0, len(x), BLOCK):
            r = np.linalg.qr(np.concatenate([r, x[at : at + BLOCK]]), mode="r")
    return r


def triangle(fit_rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit list."""
    dim = len(sums)

    def task() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    def out(r: np.ndarray, t: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t] * len(r), pa.int64()), pa.array([x.tobytes() for x in r], pa.binary())], names=["t", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield out(reduce_rows((gaps(matrix(b.column(0), dim), n, sums) / n for b in batches if b.num_rows), dim), task())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = [], []

        def blocks() -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows:
                    at.append(b.column(0)[0].as_py())
                    rows.append(b.num_rows)
                    yield np.frombuffer(b"".join(b.column(1).to_pylist()), float).reshape(-1, dim)

        r = reduce_rows(blocks(), dim)
        if rows:
            yield out(r, at[0])

    got = fit_rows.select("x").mapInArrow(first, "t long, r binary")
    for groups in LEVELS:
        got = got.withColumn("t", F.pmod("t", F.lit(groups))).repartition(groups, "t").mapInArrow(again, "t long, r binary")
    rows = [np.frombuffer(bytes(x["r"]), float) for x in got.collect()]  # one triangle: as many rows as components at most
    r = np.zeros((dim, dim))
    if rows:
        last = np.linalg.qr(np.array(rows), mode="r")
        r[: len(last)] = last
    return r


def fit(fit_rows: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """Fit to ``x`` of distinct rows."""
    got = _sums(fit_rows, "x", dim + 1, "long", lambda c: np.append(matrix(c, dim).sum(axis=0), len(c)))
    n, sums = int(got.get(dim, 0)), np.array([got.get(i, 0) for i in range(dim)], np.int64)
    if not n:
        return Fit(0, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    r = triangle(fit_rows, n, sums)
    sigma, directions = right_singular(r, components)
    return Fit(n, sums, directions, sigma**2 / n, float((r * r).sum()) / n)


def project(d: np.ndarray, model: Fit) -> np.ndarray:
    """Whitened components of rows given by their gaps."""
    return (d / model.n) @ model.directions / np.sqrt(model.eigenvalues)


def identity_error(fit_rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance, centred first, minus the identity."""
    k, n, dim = len(model.eigenvalues), model.n, len(model.sums)
    if not k:
        return 0.0
    w = lambda c: project(gaps(matrix(c, dim), n, model.sums), model)
    mean = np.array([v for _, v in sorted(_sums(fit_rows, "x", k, "double", lambda c: w(c).sum(axis=0)).items())]) / n

    def products(c: pa.Array) -> np.ndarray:
        z = w(c) - mean
        return z.T @ z

    cov = np.array([v for _, v in sorted(_sums(fit_rows, "x", k * k, "double", products).items())]).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def apply(rows: DataFrame, model: Fit, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = gaps(matrix(b.column(1), dim), model.n, model.sums)
                w = project(d, model)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(d), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    got = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.array().cast("array<double>")
    return got.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    ready(vectors.sparkSession)
    dim = common_length(vectors, vec_col)
    vec = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v")).filter(usable(F.col("v"), dim) & F.lit(dim > 0))
    rows = rows.select("vec_id", integers(F.col("v")).alias("x"))
    fit_rows = settle(rows.select("x").distinct())
    model = fit(fit_rows, max(1, dim), components)
    out = apply(rows, model, identity_error(fit_rows, model))
    discard(fit_rows)
    return out
