"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet in the shared folder and reads it back
for the next, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import mixing, near_dedup, packing, quality, suffix_dedup
from coppice.llm.common import settle, table

#: Documents that score below this go.
QUALITY = 0.3
#: Near-duplicates share ``PARTS`` of ``OF`` of their shingles of ``WORDS`` words.
WORDS, PARTS, OF = 5, 80, 100
#: Bytes of words with their ids that a worker of the last stage keeps (about twice), and of text that it handles at a time:
#: it comes after four stages that leave the executor's heap at its full size.
REMEMBER, AT_ONCE = 24 << 20, 2 << 20


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores at least QUALITY."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns)
    # the operator's own doc_id comes first, the score last, the input's columns between
    places = [f"_{i}" for i in range(len(scored.columns))]
    flat = scored.toDF(*places).filter(F.col(places[-1]) >= QUALITY)
    return flat.select(*[F.col(p).alias(c) for p, c in zip(places[1:], docs.columns)])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = near_dedup.near_duplicates(docs, WORDS, PARTS, OF)
    ids = settle(found.filter("kept").select(F.col("doc_id").alias("_id")).distinct())
    left = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])  # rows that came twice
    return left


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; the first place keeps them."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.Mix(docs).rows_with_copies().select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 4096."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBER, at_once=AT_ONCE))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("repeat_filter", repeat_filter),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None  # a fitted model and hashed choices; the tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
