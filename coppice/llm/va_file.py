"""Exact top-k search with vector-approximation files.

Components become integers floor(scale * x). Every dimension is cut into 2**BITS cells between its
least and greatest value, and a written table holds one cell number per component: the approximation
file. A scan of that file bounds the inner product of a query and a vector from both sides. A vector
whose upper bound is below the k-th greatest lower bound cannot be in the result. Exact vectors are
then read in the order of their bounds, best first, in two rounds, until no unread vector's bound
reaches the k-th exact score: the result is certain.

Queries go to the tasks in blocks of at most QUERIES; rows stay where they are, and a task gives
back only candidates that its own threshold leaves. Equal vectors are one candidate.

Defined cases: vectors that are null or hold a null or non-finite component, or have another length
than most, take no part; fewer rows than k give all; ties go to the smaller id; repeated rows count
once; an empty table gives no row; vectors whose inner products may pass 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ready, settle, top_per_key
from coppice.llm.vectors import classes, common_length, expand, matrix, usable

BITS = 6
QUERIES = 2048
SCALE = 256
FINEST = float(1 << 54)  # the greatest size of a component whose integer fits in 63 bits


def _pack_ints(df: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) and np.abs(flat).max() > FINEST:
                raise OverflowError(f"components above {FINEST:g} in size have no exact integers here")
            ints = np.floor(SCALE * flat.reshape(b.num_rows, dim)).astype("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in ints], pa.binary())], names=["vec_id", "v"])

    return df.mapInArrow(run, "vec_id long, v binary")


def _edges(members: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension; one row per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0).to_pylist(), dim, "<i8")
                a, z = x.min(axis=0), x.max(axis=0)
                lo, hi = (a, z) if lo is None else (np.minimum(lo, a), np.maximum(hi, z))
        if lo is not None:
            yield pa.RecordBatch.from_pydict({"lo": [lo.tobytes()], "hi": [hi.tobytes()]}, schema=pa.schema([("lo", pa.binary()), ("hi", pa.binary())]))

    got = members.select("v").mapInArrow(run, "lo binary, hi binary").collect()
    return np.min([np.frombuffer(r["lo"], "<i8") for r in got], axis=0), np.max([np.frombuffer(r["hi"], "<i8") for r in got], axis=0)


def cell_bounds(lo: np.ndarray, hi: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """First and last value of every cell, a row per dimension."""
    cells = 1 << bits
    width = np.maximum(1, -(-(hi - lo + 1) // cells))
    first = lo[:, None] + width[:, None] * np.arange(cells)
    return first, first + width[:, None] - 1


def bounds(q: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and coded vectors."""
    d = np.arange(codes.shape[1])
    low, high = first[d, codes].astype(np.float64), last[d, codes].astype(np.float64)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    slack = 1e-9 * (np.abs(q).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-9
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score long: the ``k`` greatest integer inner products of each query."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"), is_query.alias("q")).filter("vec_id is not null")
    dim = common_length(rows, "x")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim:
        return none
    good = rows.filter(usable(F.col("x"), dim))
    members = classes(_pack_ints(good.select("vec_id", "x"), dim), k + 1)
    queries = settle(_pack_ints(good.filter("q").select("vec_id", "x"), dim).dropDuplicates(["vec_id"]))
    lo, hi = _edges(members, dim)
    size = max(abs(int(lo.min())), abs(int(hi.max())))
    if size * size * dim >= 1 << 63:
        raise OverflowError("inner products of these vectors may not fit in 64 bits")
    first, last = cell_bounds(lo, hi)
    width = last[:, 0] - first[:, 0] + 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1).to_pylist(), dim, "<i8")
            codes = ((x - lo) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["class_id", "code"])

    approx = settle(members.select("class_id", "v").mapInArrow(code, "class_id long, code binary"))
    n = queries.count()
    if not n:
        return none
    blocks, found = -(-n // QUERIES), []
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toPandas()
        if len(own):
            sent = spark.sparkContext.broadcast((own["vec_id"].to_numpy(np.int64), matrix(own["v"].tolist(), dim, "<i8")))
            found.append(_search_block(approx, members, sent, first, last, k + 1, dim))
    return expand(reduce(DataFrame.unionByName, found), members, k)


def _search_block(approx: DataFrame, members: DataFrame, sent, first: np.ndarray, last: np.ndarray, k: int, dim: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        kth = np.full((len(ids), k), -np.inf)  # the greatest lower bounds so far, ascending
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, dim)
                low, high = bounds(q, codes, first, last)
                both = np.concatenate([kth, low], axis=1)
                kth = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
                i, j = np.nonzero(high >= kth[:, :1])
                names = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(names[j]), pa.array(low[i, j]), pa.array(high[i, j])], schema=schema)

    seen = settle(approx.mapInArrow(scan, "query_id long, class_id long, lower double, upper double"))
    floor = top_per_key(seen.select("query_id", "class_id", "lower"), "query_id", [F.desc("lower"), F.col("class_id")], k).groupBy("query_id").agg(F.min("lower").alias("floor"), F.count("*").alias("n"))
    left = settle(seen.join(floor, "query_id").filter((F.col("upper") >= F.col("floor")) | (F.col("n") < k)).select("query_id", "class_id", "upper"))
    ranked = top_per_key(left, "query_id", [F.desc("upper"), F.col("class_id")], 2 * k)
    near = settle(_exact(ranked.select("query_id", "class_id"), members, sent, dim))
    certain = top_per_key(near, "query_id", [F.desc("score"), F.col("class_id")], k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    rest = left.join(near.select("query_id", "class_id"), ["query_id", "class_id"], "left_anti").join(certain, "query_id").filter((F.col("upper") >= F.col("kth")) | (F.col("n") < k))
    return top_per_key(near.unionByName(_exact(rest.select("query_id", "class_id"), members, sent, dim)), "query_id", [F.desc("score"), F.col("class_id")], k).drop("rank")


def _exact(pairs: DataFrame, members: DataFrame, sent, dim: int) -> DataFrame:
    """Read the exact vectors of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        order = np.argsort(ids)
        for b in batches:
            if b.num_rows:
                names = b.column(0).to_numpy(zero_copy_only=False)
                x = matrix(b.column(2).to_pylist(), dim, "<i8")
                s = np.einsum("ij,ij->i", q[order[np.searchsorted(ids[order], names)]], x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "class_id", "score"])

    return pairs.join(members.select("class_id", "v"), "class_id").select("query_id", "class_id", "v").mapInArrow(run, "query_id long, class_id long, score long")
