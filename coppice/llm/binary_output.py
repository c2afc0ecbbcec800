"""Token-id output in patched frame-of-reference blocks.

Documents are sorted by id across the cluster and tokenised whole; each sorted partition becomes a
run of shard files. A shard is one self-contained image: a header, the documents' ids and token
counts, an index of blocks, then the blocks. A block holds BLOCK ids: their minimum is subtracted,
the differences are packed at the width that WIDTH_SHARE of them need, and the high bits of the
others follow as exceptions. The index has each block's start, so any block can be read alone.

Images are rows of a Parquet table in the shared folder: Spark's committed writes survive lost
executors and need no file system but its own.

Defined cases: a null text is empty; an empty text is its end id alone; null ids come first;
repeated rows are written each; an empty table gives no shard. A document is never split between
shards, so a very long one makes a larger shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import keyed, ready, release, slices
from coppice.llm.tokens import encoder
from coppice.session import cut

BLOCK = 256
WIDTH_SHARE = 0.9
SHARD_IDS = 1 << 20
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sHHqqq")  # magic, version, ids per block, documents, ids, bytes before the blocks


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 32 * width bytes."""
    out = np.zeros((BLOCK * width // 64 + 1, len(v)), np.uint64)
    cols = np.ascontiguousarray(v.T)
    for j in range(BLOCK):
        word, off = divmod(j * width, 64)
        out[word] |= cols[j] << np.uint64(off)
        if off + width > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - off)
    return np.ascontiguousarray(out[:-1].T).astype("<u8").view(np.uint8).reshape(len(v), -1)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").reshape(len(raw), -1).T)
    out = np.empty((BLOCK, raw.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, off = divmod(j * width, 64)
        x = words[word] >> np.uint64(off)
        if off + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - off))
        out[j] = x & mask
    return out.T


def encode_blocks(ids: np.ndarray) -> bytes:
    """The index and the blocks of a run of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint64)
    v[:n] = ids
    if n < len(v):
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint64)
    d = v - low[:, None]
    need = np.sort(_bits(d), axis=1)
    width = need[:, int(np.ceil(WIDTH_SHARE * BLOCK)) - 1] if blocks else np.zeros(0, np.int64)
    high = d >> width[:, None].astype(np.uint64)
    row, col = np.nonzero(high)
    count = np.bincount(row, minlength=blocks)
    size = BLOCK // 8 * width + 5 * count
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(start[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        low_bits = d[at] & np.uint64((1 << int(w)) - 1)
        out[start[at][:, None] + np.arange(BLOCK // 8 * w)] = _pack(low_bits, int(w))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]  # exceptions: all positions of a block, then all high bits
    base, k = start[:-1] + BLOCK // 8 * width, np.arange(len(row)) - first[row]
    out[base[row] + k] = col.astype(np.uint8)
    where = (base + count)[row] + 4 * k
    out[where[:, None] + np.arange(4)] = high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    index = start[:-1].astype("<i8").tobytes() + low.astype("<u4").tobytes() + count.astype("<u2").tobytes() + width.astype("u1").tobytes()
    return struct.pack("<qq", blocks, int(start[-1])) + index + out.tobytes()


def decode_blocks(raw: bytes, n: int) -> np.ndarray:
    blocks, _ = struct.unpack_from("<qq", raw)
    at, parts = 16, []
    for kind in ("<i8", "<u4", "<u2", "u1"):
        parts.append(np.frombuffer(raw, kind, blocks, at))
        at += blocks * np.dtype(kind).itemsize
    start, low, count, width = parts
    body, width, count = np.frombuffer(raw, np.uint8, offset=at), width.astype(np.int64), count.astype(np.int64)
    d = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        d[rows] = _unpack(body[start[rows][:, None] + np.arange(BLOCK // 8 * w)], int(w))
    row = np.repeat(np.arange(blocks), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    base = start + BLOCK // 8 * width
    col = body[base[row] + k]
    where = (base + count)[row] + 4 * k
    high = np.ascontiguousarray(body[where[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.uint64)
    d[row, col] |= high << width[row].astype(np.uint64)
    return (d + low[:, None].astype(np.uint64)).ravel()[:n].astype("<u4")


def encode_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file: header, documents, block index, blocks."""
    counts = np.array([len(x) // 4 for x in ids], "<i8")
    known = np.array([x is not None for x in doc_ids], "u1")
    names = np.array([x or 0 for x in doc_ids], "<i8")
    docs = names.tobytes() + known.tobytes() + counts.tobytes()
    body = encode_blocks(np.frombuffer(b"".join(ids), "<u4"))
    return HEAD.pack(MAGIC, 1, BLOCK, len(ids), int(counts.sum()), HEAD.size + len(docs)) + docs + body


def decode_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts, and all ids one document after the other."""
    magic, _, block, docs, n, body = HEAD.unpack_from(raw)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token shard")
    names = np.frombuffer(raw, "<i8", docs, HEAD.size)
    known = np.frombuffer(raw, "u1", docs, HEAD.size + 8 * docs)
    counts = np.frombuffer(raw, "<i8", docs, HEAD.size + 9 * docs)
    return [int(x) if k else None for x, k in zip(names, known)], counts, decode_blocks(raw[body:], n)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Tokenise whole texts and write them as shards in ascending id order.

    Returns the written table: part long, shard long (both ascending with the ids), before long
    (ids of the part's earlier shards), n_ids long, image binary.
    """
    spark = docs.sparkSession
    ready(spark)
    js = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, names, ids, size, shard, before = encoder(js.value, kind), TaskContext.get().partitionId(), [], [], 0, 0, 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "before": [before], "n_ids": [size], "image": [encode_shard(names, ids)]}, schema=SCHEMA)

        for b in slices(batches):
            for name, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                names.append(name)
                ids.append(x + end)
                size += len(ids[-1]) // 4
                if size >= SHARD_IDS:
                    yield image()
                    names, ids, shard, before, size = [], [], shard + 1, before + size, 0
        if names:
            yield image()

    SCHEMA = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
    rows = keyed(docs, id_col, text_col)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = cut(placed.mapInArrow(write, "part long, shard long, before long, n_ids long, image binary"))
    release(spark)
    return out


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids binary (little-endian unsigned 32-bit).

    Only one token count per sorted partition reaches the driver.
    """
    starts, total = {}, 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part] = total
        total += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                names, counts, ids = decode_shard(image.as_py())
                raw, cuts = ids.tobytes(), np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array(cuts[:-1] + starts[part] + before, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([raw[4 * lo : 4 * hi] for lo, hi in zip(cuts, cuts[1:])], pa.binary()),
                ], schema=schema)

    return shards.select("part", "before", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """The crc32 of each document's ids in place of the ids."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


