"""Repeated passages by longest-previous-factor arrays.

A byte goes if some string of MIN_BYTES bytes that covers it also starts earlier in the table: in a
document with a smaller id, or earlier in the same one. The first place of every passage stays.

Equal strings pick equal anchors: of the GRAM-byte pieces in a window of MIN_BYTES bytes, the one
with the least hash, the leftmost of several. Neighbouring windows mostly pick the same place, so a
text has an anchor about every 35 bytes. Only anchors whose hash occurs twice in the table go on, each
with its context: the bytes of all windows that picked it.

Equal contexts of an anchor need no comparison: all but the first place are repeats. What is left,
one place for each distinct context, is compared in tasks. A task holds the contexts of some anchors
as one text, sorts its suffixes, and takes the previous and next smaller place in suffix order: they
give each window's longest previous factor, and MIN_BYTES of it mean that the window is a repeat. An
anchor with more than CROWD distinct contexts is not gathered; there the first place of each window's
hash is an ordinary aggregation and the windows join it.

Defined cases: a null or empty text, and one shorter than MIN_BYTES, loses nothing; rows with equal
id and text are one document and get the same result each; of different texts with one id the order
is that of a hash; a null id comes before all others; matches never cross documents; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import discard, mix64, ready, settle, slices, utf8

MIN_BYTES = 100
GRAM = 32
#: Distinct contexts of an anchor that are compared in one task, at most.
CROWD = 8192
#: Contexts that a task compares, about.
BUCKET = 3072
#: Bytes that are looked at together; a longer text goes in pieces (the places are packed in 24 bits).
PIECE = 1 << 19


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of every run of ``gram`` bytes (a power of two), by doubling."""
    h = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[raw]
    k = 1
    while k < gram:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        h ^= h >> np.uint64(29)
        k *= 2
    return mix64(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other: text number, anchor hash, first and last window, anchor.

    Windows and anchors count from the start of their text.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < size or not len(starts):
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(raw)
    low = np.uint64((1 << 24) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = (sliding_least(packed, size - GRAM + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(best)]
    ok = np.arange(len(best)) + size <= ends[text]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none.astype(np.uint64), none, none, none
    a, t = best[at], text[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    t = t[first]
    return t, h[a[first]], at[first] - starts[t], at[last] - starts[t], a[first] - starts[t]


def _anchor_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a slice of texts; long texts in pieces that overlap by a window."""
    group: list[int] = []
    size = 0
    plan: list[tuple[list[int], int]] = []
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            plan += [([i], lo) for lo in range(0, len(t) - MIN_BYTES + 1, PIECE)]
            continue
        if size + len(t) > PIECE and group:
            plan.append((group, 0))
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        plan.append((group, 0))
    for ids, lo in plan:
        parts = [texts[i][lo : lo + PIECE + MIN_BYTES - 1] for i in ids]
        ends = np.cumsum([len(p) for p in parts])
        t, h, first, last, at = anchors(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, ends[:-1]], ends)
        yield np.array(ids)[t] if len(t) else t, h, first + lo, last + lo, at + lo


def ranks(text: np.ndarray, size: int, graded: bool = True) -> list[tuple[int, np.ndarray]]:
    """Ranks of all places by their first 8, 16, ... and ``size`` bytes (places near the end as if zeros followed).

    Without ``graded`` only the ranks by ``size`` bytes are kept.
    """
    pad = np.r_[text, np.zeros(size + 8, np.uint8)].astype(np.uint64)
    key = np.zeros(len(text) + size, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | pad[k : k + len(key)]
    out, have = [], 8
    r = np.unique(key, return_inverse=True)[1].astype(np.uint32)
    del pad, key
    out.append((8, r))
    while have < size:
        step = min(have, size - have)
        other = np.r_[r[step:], np.zeros(step, r.dtype)]
        r = np.unique((r.astype(np.uint64) << np.uint64(32)) | other.astype(np.uint64), return_inverse=True)[1].astype(np.uint32)
        have += step
        out = [*out, (have, r)] if graded else [(have, r)]
    return out


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 for none."""
    prev = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero((prev >= 0) & (x[prev] > x))
    while len(open_):
        prev[open_] = prev[prev[open_]]
        open_ = open_[(prev[open_] >= 0)]
        open_ = open_[x[prev[open_]] > x[open_]]
    return prev


def longest_previous(text: np.ndarray, place: np.ndarray, order: np.ndarray, size: int, graded: bool = True) -> np.ndarray:
    """LPF, up to ``size``: of each place, the longest string there that also starts at a place of smaller order.

    Without ``graded`` lengths below ``size`` are given as 0, which saves the ranks by shorter strings.

    The places are sorted as suffixes; going from a place up or down that order, matches only get
    shorter, so the nearest places of smaller order on both sides hold the longest earlier match.
    """
    levels = ranks(text, size, graded)
    full = levels[-1][1][place]
    by = np.lexsort((order, full))
    o = order[by]
    before, after = nearest_smaller(o), len(o) - 1 - nearest_smaller(o[::-1])[::-1]
    out = np.zeros(len(place), np.int64)
    for other in (before, np.where(after >= len(o), -1, after)):
        has = np.flatnonzero(other >= 0)
        a, b = place[by[has]].copy(), place[by[other[has]]].copy()
        same = levels[-1][1][a] == levels[-1][1][b]
        length = np.where(same, size, 0)
        rest = np.flatnonzero(~same) if graded else np.zeros(0, np.int64)
        a, b, got = a[rest], b[rest], np.zeros(len(rest), np.int64)
        padded = np.r_[text, np.zeros(size + 8, np.uint8)]
        for step, r in reversed([x for x in levels if x[0] in (8, 16, 32, 64)]):
            hit = (got + step <= size) & (r[np.minimum(a + got, len(r) - 1)] == r[np.minimum(b + got, len(r) - 1)])
            got += np.where(hit, step, 0)
        for _ in range(8):
            got += (got < size) & (padded[a + got] == padded[b + got])
        length[rest] = np.minimum(got, size - 1)
        out[by[has]] = np.maximum(out[by[has]], length)
    return out


def repeated_windows(contexts: list[bytes], size: int = MIN_BYTES) -> list[tuple[int, int, int]]:
    """Of contexts in the order of their places: context number, first byte, end of each run of repeats."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(contexts), np.uint8)
    count = np.maximum(0, lengths - size + 1)
    place = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    which = np.repeat(np.arange(len(contexts)), count)
    hit = np.flatnonzero(longest_previous(text, place, which, size, graded=False) >= size)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.r_[True, (np.diff(place[hit]) > 1) | (np.diff(which[hit]) > 0)])
    last = np.r_[cut[1:], len(hit)] - 1
    w = which[hit[cut]]
    return list(zip(w.tolist(), (place[hit[cut]] - starts[w]).tolist(), (place[hit[last]] - starts[w] + size).tolist()))


_KEY = ["doc_id", "th"]


def _keyed_bytes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, th, text: th tells different texts with one id apart, and is 0 where no id comes twice."""
    name, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    twice = docs.select(name).groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return docs.select(name, (F.hash(text) if twice else F.lit(0)).alias("th"), text.alias("text"), *more)


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["th"] == b["_th"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th and spans (array of struct start, end): the bytes of each document that are repeats."""
    ready(docs.sparkSession)
    rows = _keyed_bytes(docs, id_col, text_col)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for _, h, *_ in _anchor_rows(utf8(b.column(0))):
                u, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = utf8(b.column(2))
            for t, h, first, last, at in _anchor_rows(raw):
                marks = [xxhash.xxh3_64_intdigest(raw[i][a : z + MIN_BYTES], m) for i, a, z, m in zip(t.tolist(), first.tolist(), last.tolist(), (at - first).tolist())]
                k = pa.array(t)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(marks, np.uint64).view(np.int64)), b.column(0).take(k), b.column(1).take(k), *[pa.array(x.astype(np.int32)) for x in (first, last)]], names=["h", "mark", *_KEY, "first", "last"])

    twice = settle(rows.select("text").mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    hits = settle(rows.mapInArrow(places, "h long, mark long, doc_id long, th int, first int, last int").join(twice, "h"))
    where = F.struct("doc_id", "th", "first")
    distinct = settle(hits.groupBy("h", "mark").agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("w")))
    later = hits.join(distinct.select("h", "mark", F.struct("w.doc_id", "w.th", "w.first").alias("w")), ["h", "mark"]).filter(where > F.col("w"))
    spans = [settle(later.select(*_KEY, F.col("first").alias("start"), (F.col("last") + MIN_BYTES).alias("end")))]
    discard(twice, hits)
    crowd = settle(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))

    # one place of each context of an anchor that has several: their bytes
    wanted = distinct.join(crowd, "h").select("h", "w.*", (F.col("n") > CROWD).alias("crowded"))
    lists = wanted.groupBy(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("h", "first", "last", "crowded")).alias("hits"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, lists = utf8(b.column(2)), b.column(3)
            flat, off = lists.flatten(), np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(b.num_rows), off)
            h, first, last, crowded = (flat.field(k) for k in range(4))
            for lo in range(0, len(row), 65_536):
                r, f, z = row[lo : lo + 65_536], first.slice(lo, 65_536), last.slice(lo, 65_536)
                ctx = [raw[i][x : y + MIN_BYTES] for i, x, y in zip(r.tolist(), f.to_pylist(), z.to_pylist())]
                k = pa.array(r)
                yield pa.RecordBatch.from_arrays([h.slice(lo, 65_536), crowded.slice(lo, 65_536), b.column(0).take(k), b.column(1).take(k), f, pa.array(ctx, pa.binary())], names=["h", "crowded", *_KEY, "first", "ctx"])

    lists = settle(lists)
    contexts = settle(rows.join(lists, _same_key(rows, lists)).select(*_KEY, "text", "hits").mapInArrow(cut_out, "h long, crowded boolean, doc_id long, th int, first int, ctx binary"))
    discard(lists, distinct)
    some = contexts.filter("not crowded")
    buckets = max(1, -(-some.count() // BUCKET))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        place = ["known", "doc_id", "th", "first"]
        pdf = pdf.drop_duplicates(place).sort_values(place, kind="stable", ignore_index=True)  # rows that came twice are one
        got = repeated_windows([bytes(c) for c in pdf["ctx"]])
        i = np.array([g[0] for g in got], np.int64)
        base = pdf["first"].to_numpy()[i] if len(i) else np.zeros(0, np.int32)
        return pd.DataFrame({"known": pdf["known"].to_numpy()[i], "doc_id": pdf["doc_id"].to_numpy()[i], "th": pdf["th"].to_numpy()[i], "start": base + np.array([g[1] for g in got], np.int32), "end": base + np.array([g[2] for g in got], np.int32)})

    flat = some.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "th", "first", "ctx")
    near = flat.groupBy("bucket").applyInPandas(compare, "known boolean, doc_id long, th int, start int, end int")
    spans.append(near.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "th", "start", "end"))
    windows = None
    if crowd.filter(f"n > {CROWD}").limit(1).count():
        windows = _windows(contexts.filter("crowded").select(*_KEY, "first", "ctx"))
        spans.append(_later_windows(windows))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    out = settle(every.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(contexts, crowd, windows, spans[0])
    return out


def _windows(contexts: DataFrame) -> DataFrame:
    """mark (a hash of the bytes), doc_id, th, start of every window of anchors with very many contexts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                b = big.slice(lo, 4096)
                ctx = b.column(3).to_pylist()
                n = np.array([len(c) - MIN_BYTES + 1 for c in ctx])
                mark = [xxhash.xxh3_128_digest(c[k : k + MIN_BYTES]) for c, m in zip(ctx, n.tolist()) for k in range(m)]
                row = np.repeat(np.arange(len(ctx)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                k = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(mark, pa.binary()), b.column(0).take(k), b.column(1).take(k), pa.array((b.column(2).to_numpy(zero_copy_only=False)[row] + step).astype(np.int32))], names=["mark", *_KEY, "start"])

    return settle(contexts.mapInArrow(windows, "mark binary, doc_id long, th int, start int"))


def _later_windows(every: DataFrame) -> DataFrame:
    """Runs of windows whose bytes also start at an earlier place."""
    place = F.struct("doc_id", "th", "start")
    firsts = every.groupBy("mark").agg(F.min(place).alias("w"))
    later = every.join(firsts, "mark").filter(place > F.col("w"))
    run = F.col("start") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("start"))
    return later.select(*_KEY, "start").distinct().withColumn("run", run).groupBy(*_KEY, "run").agg(F.min("start").alias("start"), (F.max("start") + MIN_BYTES).cast("int").alias("end")).drop("run")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = repeats(docs, id_col, text_col).select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "spans")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("_none"))
    rows = _keyed_bytes(docs, id_col, text_col, rest.alias("_row"))
    return rows.join(spans, _same_key(rows, spans), "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for name, raw, spans in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
                cut = united([(s["start"], s["end"]) for s in spans or []])
                rows.append((name, len(raw), sum(z - a for a, z in cut), len(cut), hashlib.sha256(kept(raw, cut)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _with_spans(docs.select(id_col, text_col), id_col, text_col).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in cut:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole UTF-8 characters."""
    out = []
    for a, z in cut:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with repeated passages cut out of the text; a null text stays null."""

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            raw = t.encode("utf-8", "surrogatepass")
            cut = united([(x["start"], x["end"]) for x in s])
            out.append(kept(raw, whole_characters(raw, cut)).decode("utf-8", "replace"))
        return pd.Series(out)

    rows = _with_spans(docs, id_col, text_col)
    changed = F.when(F.col("_row._none"), F.lit(None)).when(F.col("spans").isNull(), F.col("text")).otherwise(strip("text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))))
    return rows.withColumn("_new", changed).select(*[F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
