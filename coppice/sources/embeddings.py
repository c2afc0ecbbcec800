"""Item texts to vectors: a caller's model, or an offline default, with a table of known vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.operators.naming import call_in_batches

EmbedFn = Callable[[list[str]], list[list[float]]]
KEY = ["item_id", "model", "variant", "text_hash"]


def hashed_tfidf(texts: DataFrame, dims: int = 256) -> DataFrame:
    """``texts`` with ``features``: hashed term weights of unit length, computed in the JVM."""
    words = RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+").transform(texts.fillna("", subset=["text"]))
    counts = HashingTF(inputCol="_w", outputCol="_c", numFeatures=dims).transform(words)
    weights = IDF(inputCol="_c", outputCol="_t").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_t", outputCol="_u").transform(weights)
    return unit.withColumn("features", vector_to_array("_u")).drop("_w", "_c", "_t", "_u")


def embed_items(texts: DataFrame, fn: EmbedFn | None = None, batch: int = cfg.EMBED_BATCH, max_chars: int | None = None,
                dims: int = 256) -> DataFrame:
    """``texts`` (with a ``text`` column) plus ``features array<double>``.

    Whole texts are read, ``batch`` to a call; ``max_chars`` is for a model that takes no more.
    Without a model, the offline default.
    """
    short = texts if max_chars is None else texts.withColumn("text", F.substring("text", 1, max_chars))
    if fn is None:
        return hashed_tfidf(short, dims)
    return call_in_batches(short, "text", "features", "array<double>", fn, batch)


def embed_missing(spark: SparkSession, texts: DataFrame, path: str, model: str, fn: EmbedFn | None = None, **kw) -> DataFrame:
    """``(item_id, model, variant, text_hash, features)`` for all texts, computing only unknown ones.

    ``texts(item_id, variant, text)``. Vectors are kept in a table partitioned by model and variant
    and found again by item and text, so a changed text is embedded anew. The offline default
    weighs terms by the texts at hand, so its vectors of two runs do not compare: a model is required.
    """
    if fn is None:
        raise ValueError("vectors are kept for a model function only")
    wanted = texts.withColumn("model", F.lit(model)).withColumn("text_hash", F.xxhash64("text"))
    kept = _stored(spark, path)
    new = wanted if kept is None else wanted.join(kept.select(*KEY), KEY, "left_anti")
    made = embed_items(new, fn, **kw).select(*KEY, "features")
    made.write.mode("append").partitionBy("model", "variant").parquet(path)
    return _stored(spark, path).join(wanted.select(*KEY), KEY, "left_semi").select(*KEY, "features")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    schema = "item_id long, text_hash long, features array<double>, model string, variant string"
    return spark.read.schema(schema).parquet(path)
