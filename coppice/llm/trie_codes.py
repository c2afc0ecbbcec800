"""Vector codes: product quantisation whose assignments walk a trie over the distinct parts.

Components become integers floor(SCALE * x); a vector is cut into PARTS equal consecutive parts, and each
position has a codebook that starts as that part of the vectors with the ENTRIES smallest ids.
``assign`` sorts the distinct parts of a block of rows lexicographically, which is a trie whose level d holds
the distinct prefixes of d + 1 components. A depth-first traversal carries one vector of accumulated
squared distances, to every entry, from a prefix to its extensions, so a shared prefix is paid once;
a leaf takes the least entry, and its weight (the rows that have it) goes to that entry's sums.
Nodes are visited in runs of at most RUN siblings and cousins, which bounds the stack's memory.

Rows stay where they are: a round is one pass in which every task returns at most PARTS * ENTRIES sums, and
Spark adds those. Codebooks have PARTS * ENTRIES rows at most at any size of table; they alone
travel to the tasks. Everything is integer arithmetic, so results do not depend on how rows are split.

Defined cases: vectors that are null, hold a null or non-finite component, or have another length than most are
dropped; fewer than ENTRIES rows give shorter codebooks; equal ids among the first are ordered by their vectors, null ids come last;
repeated rows count as often as they come; null labels are one label; an empty table gives no row.
A length that PARTS does not divide, and components so large that an error might pass 64 bits, raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ready, settle
from coppice.llm.vectors import common_length, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distinct parts make one trie; trie nodes whose distances are held together.
BLOCK, RUN = 32768, 2048


def integers(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column, a row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != dim * len(column):
        raise ValueError(f"expected {dim} components a vector")
    got = np.floor(scale * flat)
    if len(got) and np.abs(got).max() >= limit(dim):
        raise ValueError("a component is too large for errors of 64 bits")
    return got.astype(np.int64).reshape(-1, dim)


def limit(dim: int) -> float:
    """Below this, dim squared differences add up to less than 2**63."""
    return float(2**30 / np.sqrt(max(1, dim)))


def walk(parts: np.ndarray, book: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every part; ``parts`` are distinct and sorted lexicographically."""
    n, width = parts.shape
    best, error = np.empty(n, np.int64), np.empty(n, np.int64)
    if not n:
        return best, error
    # opens[d][i]: row i begins a new prefix of d + 1 components
    differs = np.ones((n, width), bool)
    np.cumsum(parts[1:] != parts[:-1], axis=1, out=(seen := np.empty((n - 1, width), np.int64)))
    differs[1:] = seen > 0
    opens = [np.flatnonzero(differs[:, d]) for d in range(width)]
    # a stack entry: a run of nodes of one level, by their first rows, the row after them, their distances
    stack = [(0, np.array([0]), n, np.zeros((1, len(book)), np.int64))]
    while stack:
        level, firsts, end, sums = stack.pop()
        lo, hi = np.searchsorted(opens[level], [firsts[0], end])
        children = opens[level][lo:hi]
        if len(children) > run:  # the later ones wait below on the stack
            stop = children[run]
            back = np.searchsorted(firsts, stop, "right") - 1
            stack.append((level, np.concatenate([[stop], firsts[back + 1 :]]), end, sums[back:]))
            children, end = children[:run], stop
        parent = np.searchsorted(firsts, children, "right") - 1
        grown = sums[parent] + (parts[children, level][:, None] - book[None, :, level]) ** 2
        if level + 1 < width:
            stack.append((level + 1, children, end, grown))
        else:
            best[children] = grown.argmin(axis=1)
            error[children] = grown[np.arange(len(children)), best[children]]
    return best, error


def assign(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each position: distinct parts, their weights, which one each row has, nearest entry and distance of each."""
    width = books.shape[2]
    for p, book in enumerate(books):
        parts, inverse, weight = np.unique(x[:, p * width : (p + 1) * width], axis=0, return_inverse=True, return_counts=True)
        yield p, parts, weight, inverse.reshape(-1), *walk(parts, book)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """Record batches put together, so that a trie spans more rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    dim = common_length(vectors, vec_col)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    return rows.filter(usable(F.col("v"), dim) & F.lit(dim > 0))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """positions x entries x width: the parts of the vectors with the smallest ids."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0]["v"])
    if dim % parts or not dim:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    x = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim)
    return np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry becomes the componentwise floor of the mean of its parts; unused ones stay."""
    positions, entries, width = books.shape
    out = pa.schema([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for t in _blocks(batches):
            x = integers(t.column("v").combine_chunks(), positions * width)
            for p, parts, weight, _, best, _ in assign(x, books):
                np.add.at(counts[p], best, weight)
                np.add.at(sums[p], best, parts * weight[:, None])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], schema=out)

    part = rows.select("v").mapInArrow(run, "p int, e int, n long, s array<long>")
    total = part.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(width)])
    books = books.copy()
    for r in total.collect():  # at most positions * entries rows
        books[r["p"], r["e"]] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_books(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""
    positions, _, width = books.shape
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            x = integers(t.column("v").combine_chunks(), positions * width)
            codes, errors = np.empty((len(x), positions), np.uint8), np.zeros(len(x), np.int64)
            for p, _, _, which, best, error in assign(x, books):
                codes[:, p] = best[which]
                errors += error[which]
            text = [c.tobytes().hex() for c in codes]
            yield from pa.table({"vec_id": t.column("vec_id"), "label": t.column("label"), "code": pa.array(text, pa.string()), "error": pa.array(errors)}).to_batches()

    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The encoded rows, written to the shared folder, and the codebooks."""
    if entries > 256:
        raise ValueError("an index must fit in two hex digits")
    ready(vectors.sparkSession)
    rows = kept_vectors(vectors, id_col, vec_col, label_col)
    books = train(rows, parts, entries, rounds)
    return settle(encode(rows, books)), books


def digest(vectors: DataFrame) -> DataFrame:
    """Codes and errors with the error of each label; sums are taken before rows and labels meet."""
    coded, books = compress(vectors)
    sums = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    # a short list of labels is broadcast by its known size, a long one meets the rows by hash, split where one label is hot
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
