"""Best-fit packing of token pieces with a swap-based local search.

Whole texts are tokenised where they lie; only a short row per piece moves on. Pieces are dealt by
hash into groups of about GROUP; each group is packed by itself, so a table of any size packs in
parallel and a group wastes less than one sequence. In a group, pieces go largest first into the
fullest sequence that takes them. Then the emptiest sequence gives away what it holds: a piece
moves, one piece is exchanged for a smaller one, or two for one, always so that the other sequence
becomes fuller. Each exchange raises the sum of squared fills, so the search ends; it stops when
the free room left could not take the emptiest sequence.

Defined cases: a null or empty text is its end id alone; an empty table gives no row; repeated rows
are packed each; a text longer than a sequence is cut into whole pieces and a shorter last one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import SLICE_BYTES, keyed, ready, settle, slices
from coppice.llm.tokens import REMEMBER, encoder

#: Pieces packed together in one task.
GROUP = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, kind: str = "word", id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBER, at_once: int = SLICE_BYTES) -> DataFrame:
    """The pieces of every text: ids by the tokenizer, then ``end_id``, cut every ``capacity`` ids.

    A worker keeps about twice ``remember`` bytes of words with their ids and handles ``at_once`` bytes of text at a time.
    """
    spark = docs.sparkSession
    ready(spark)
    js = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(js.value, kind, remember)
        for b in slices(batches, most=at_once):
            rows: list[tuple] = []
            for name, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    one = ids[k : k + 4 * capacity]
                    rows.append((name, k // (4 * capacity), k // 4, len(one) // 4, zlib.crc32(one)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return keyed(docs, id_col, text_col).mapInArrow(cut_up, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: largest first, into the fullest bin that takes it."""
    bins, room, made = np.empty(len(sizes), np.int64), [], 0  # room: (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, at = room.pop(k)
        else:
            free, at, made = capacity, made, made + 1
        bins[i] = at
        if free > size:
            insort(room, (free - size, at))
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the emptiest bins into the room that others have."""
    bins, sizes = bins.copy(), sizes.astype(np.int64)
    fill = np.bincount(bins, sizes, minlength=bins.max() + 1).astype(np.int64)
    done = np.zeros(len(fill), bool)
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        room = int((capacity - fill[open_bins]).sum())
        left = [b for b in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist() if not done[b]]
        if not left or int(fill[open_bins].min()) > room - (capacity - int(fill[open_bins].min())):
            return bins
        donor = left[0]
        while fill[donor] and _give(donor, sizes, bins, fill, capacity):
            pass
        done[donor] = True


def _give(donor: int, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """One exchange that takes most from ``donor``; False if none does."""
    own = np.flatnonzero(bins == donor)
    free = capacity - fill
    free[donor] = 0
    free[fill == 0] = 0
    takers = np.flatnonzero(free > 0)
    if not len(takers):
        return False
    own = own[np.argsort(-sizes[own], kind="stable")]
    for x in own:  # a piece moves, into the fullest bin that takes it
        fits = takers[free[takers] >= sizes[x]]
        if len(fits):
            to = fits[np.argmin(free[fits])]
            _move([x], to, sizes, bins, fill)
            return True
    other = np.flatnonzero(free[bins] > 0)
    give = [(int(sizes[x]), [x]) for x in own] + [(int(sizes[x] + sizes[y]), [x, y]) for i, x in enumerate(own) for y in own[i + 1 :]]
    best, trade = 0, None
    for total, out in give:  # one for one, two for one
        gain = total - sizes[other]
        ok = (gain > best) & (gain <= free[bins[other]]) & (fill[bins[other]] + gain > fill[donor])
        if ok.any():
            k = int(np.argmax(np.where(ok, gain, 0)))
            best, trade = int(gain[k]), (out, other[k])
    if trade is None:
        return False
    out, back = trade
    to = bins[back]
    _move(out, to, sizes, bins, fill)
    _move([back], donor, sizes, bins, fill)
    return True


def _move(items: list, to: int, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray) -> None:
    for i in items:
        fill[bins[i]] -= sizes[i]
        fill[to] += sizes[i]
        bins[i] = to


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to rows of doc_id, piece and length."""
    pieces = settle(pieces)
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group))
    schema = f"_none boolean, {PIECES}, sequence_id long, offset long"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # groupby-apply hands rows over in any order: sorted, so that a second run packs alike
        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable", na_position="first", ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.r_[True, np.diff(bins[order]) > 0]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        return pdf.assign(sequence_id=key[0] * (1 << 32) + bins, offset=offset)[[c.split()[0] for c in schema.split(", ")]]

    short = pieces.filter(F.col("length") < capacity).withColumn("_group", F.pmod(key, F.lit(groups)))
    short = short.withColumns({"_none": F.isnull("doc_id"), "doc_id": F.coalesce("doc_id", F.lit(0))})  # pandas has no null integers
    packed = short.groupBy("_group").applyInPandas(one, schema)
    packed = packed.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id"))).drop("_none")
    whole = pieces.filter(F.col("length") >= capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
