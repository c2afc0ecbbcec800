"""Helpers that several operators share: rows, folds, scratch tables and cleaning up after a phase."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.session import scratch_path, shared_dir

#: Texts handled at a time inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")) % of


def fold_of(key: object, of: int) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % of


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names doc_id and text: other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def one_text_an_id(rows: DataFrame) -> DataFrame:
    """doc_id and text: of rows that share an id the one whose text has the least hash, equal texts being one.

    The partial aggregation leaves one row an id and task, so however many rows share an id, few are sent.
    """
    text = F.struct(F.xxhash64("text").alias("h"), "text")
    return rows.groupBy("doc_id").agg(F.min(text).alias("t")).select("doc_id", "t.text")


#: Paths of the tables that ``settle`` wrote, by the frame that reads them.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder, read it back and let go of the shuffles that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    release(spark)
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables that ``settle`` wrote, once nothing will read them again."""
    for df in frames:
        path = _WRITTEN.pop(df, None) if df is not None else None
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM notices that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ready(spark: SparkSession) -> None:
    """Give the package to the Python workers before a job needs it."""
    shared_dir(spark)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, however long the texts are."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if size.sum() <= most:
            if b.num_rows:
                yield b
            continue
        group = np.cumsum(size) // most
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A column of texts as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def lower_words(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8; other letters stay as they are."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int, salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each key; salted, so that no task gets more than ``salts * k`` rows of a hot key at the end."""
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(salts)))
    part = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)
