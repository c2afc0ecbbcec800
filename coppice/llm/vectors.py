"""Vectors as packed binary, and classes of equal vectors, for the two searches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import settle, top_per_key


def usable(vec: Column, dim: int | None = None) -> Column:
    """No null, no missing or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    ok = vec.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return ok if dim is None else ok & (F.size(vec) == dim)


def common_length(df: DataFrame, col: str) -> int:
    """The commonest length of the usable vectors; 0 for none."""
    got = df.filter(usable(F.col(col))).groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(got["d"]) if got else 0


def classes(rows: DataFrame, members: int) -> DataFrame:
    """One row per distinct vector ``v``: class_id (smallest vec_id), v, ids (the ``members`` smallest).

    More than that many equal vectors cannot all be in a result, so a vector that a third of all
    rows share costs no more than any other. Repeated rows (same id, same vector) count once.
    """
    once = rows.dropDuplicates(["vec_id", "v"])
    few = top_per_key(once, "v", [F.col("vec_id").asc()], members)
    return settle(few.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")))


def matrix(packed, dim: int, kind: str = "<f8") -> np.ndarray:
    raw = b"".join(bytes(x) for x in packed)
    return np.frombuffer(raw, kind).reshape(len(packed), dim)


def expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query_id, class_id, score to query_id, rank, vec_id, score: the query's own row left out, ties to the smaller id."""
    from pyspark.sql import Window

    rows = found.join(members.select("class_id", "ids"), "class_id").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
