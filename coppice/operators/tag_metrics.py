"""Tag overlap inside clusters, exact and without comparing items pair by pair.

For sets A and B, Jaccard similarity is a sum over the non-empty sets S they both contain:

    J(A, B) = sum over S of 1 / C(|A| + |B| - 1, |S|)

so the sum of J over all pairs of a cluster only needs, for every S, how many of the cluster's
items of each size contain S. Those counts are one ordinary group-by: linear in the items, combined
before the shuffle, and indifferent to how many items share a tag. An item with t tags yields 2^t
subsets, so sets above ``MAX_SUBSET_TAGS`` are compared in bounded tiles instead, equally exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import tags as tg
from coppice.session import cut

MAX_SUBSET_TAGS = 10
TILE_SETS = 1024


def tag_columns(items: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus one parsed tag array per scored field, named after its metric."""
    return items.select(*keep, *[tg.PARSERS[syntax](F.col(c)).alias(m) for m, (c, syntax, _) in cfg.TAG_METRICS.items()])


def distinct_sets(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """``(keys, tags sorted, m)``: equal tag sets of a group folded into one row with a count."""
    sets = df.select(*keys, F.array_sort(F.col(tags)).alias("tags")).filter(F.size("tags") > 0)
    return sets.groupBy(*keys, "tags").agg(F.count("*").alias("m"))


def subset_counts(sets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, subset, by_size)``: how many items of each size contain the subset."""
    each = sets.select(*keys, "m", F.size("tags").alias("a"), F.explode(tg.subsets(F.col("tags"))).alias("subset"))
    counts = each.filter(F.size("subset") > 0).groupBy(*keys, "subset", "a").agg(F.sum("m").alias("m"))
    return counts.groupBy(*keys, "subset").agg(
        F.collect_list(F.struct("a", F.col("m").cast("double").alias("m"))).alias("by_size"))


def _choose(n: Column, k: Column) -> Column:
    return F.factorial(n) / (F.factorial(k) * F.factorial(n - k))


def _ordered_pair_sum(by_size: Column, size: Column) -> Column:
    """Sum of m_a * m_b / C(a + b - 1, size) over all ordered size pairs."""
    def row(acc: Column, x: Column) -> Column:
        inner = F.aggregate(by_size, F.lit(0.0), lambda t, y: t + y["m"] / _choose(x["a"] + y["a"] - 1, size))
        return acc + x["m"] * inner

    return F.aggregate(by_size, F.lit(0.0), row)


def _small_set_sum(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of Jaccard over unordered pairs of items whose sets are small."""
    subsets = subset_counts(sets, keys)
    ordered = subsets.groupBy(*keys).agg(F.sum(_ordered_pair_sum(F.col("by_size"), F.size("subset"))).alias("ordered"))
    selves = sets.groupBy(*keys).agg(F.sum("m").alias("items"))
    return ordered.join(selves, keys).select(*keys, ((F.col("ordered") - F.col("items")) / 2).alias("total"))


def _large_pairs(sets: DataFrame, keys: list[str], measure: Callable, fields: str) -> DataFrame:
    """What ``measure`` makes of the pairs in which at least one set is large.

    Large sets on the left meet all sets of their group on the right, in tiles of at most about
    ``TILE_SETS`` rows a side. ``measure`` gets the shared tags, the sizes of both sides and twice the item pairs of each
    pair of sets, which counts a pair of large sets from either side and a set with itself.
    """
    large = F.size("tags") > MAX_SUBSET_TAGS
    blocks = sets.groupBy(*keys).agg(F.ceil(F.count("*") / TILE_SETS).cast("int").alias("_b"))
    hot = sets.filter(large).select(*keys).distinct()
    rows = sets.join(hot, keys, "left_semi").join(blocks, keys)
    mine = F.pmod(F.xxhash64("tags"), F.col("_b")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    left = rows.filter(large).select(*keys, "tags", "m", mine.alias("_i"), every.alias("_j"))
    right = rows.select(*keys, "tags", "m", mine.alias("_j"), every.alias("_i"))
    tile = [*keys, "_i", "_j"]
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def overlap(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({c: [] for c in [*keys, *names]})
        vocab = {t: i for i, t in enumerate(sorted({t for s in lp["tags"] for t in s}))}

        def hot_rows(pdf):
            out = np.zeros((len(pdf), len(vocab)))
            for r, s in enumerate(pdf["tags"]):
                out[r, [vocab[t] for t in s if t in vocab]] = 1.0
            return out, pdf["tags"].map(len).to_numpy(), pdf["m"].to_numpy()

        (x, a, m), (y, b, n) = hot_rows(lp), hot_rows(rp)
        twice = m[:, None] * n[None, :] * np.where(b > MAX_SUBSET_TAGS, 1, 2)[None, :]
        got = measure(np.rint(x @ y.T).astype(int), a[:, None], b[None, :], twice)
        return got.assign(**{k: lp[k].iloc[0] for k in keys})

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), fields])
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(overlap, schema)


def _large_set_sum(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of Jaccard over unordered pairs of items in which at least one set is large."""
    def total(shared, a, b, twice):
        return pd.DataFrame({"total": [float((shared / (a + b - shared) * twice).sum() / 2)]})

    selves = sets.filter(F.size("tags") > MAX_SUBSET_TAGS).select(*keys, (-F.col("m") / 2).alias("total"))
    return _large_pairs(sets, keys, total, "total double").unionByName(selves).groupBy(*keys).agg(F.sum("total").alias("total"))


def _large_histogram(sets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, shared, twice, sim)``: twice the pairs with a large set, by shared tags, and their similarities."""
    def by_shared(shared, a, b, twice):
        flat, weight = shared.ravel(), twice.ravel()
        sim = (shared / (a + b - shared)).ravel() * weight
        c = np.unique(flat)
        at = np.searchsorted(c, flat)
        pairs = np.zeros(len(c), np.int64)
        np.add.at(pairs, at, weight)
        return pd.DataFrame({"shared": c, "twice": pairs, "sim": np.bincount(at, sim)})

    size = F.size("tags")
    selves = sets.filter(size > MAX_SUBSET_TAGS).select(*keys, size.alias("shared"), (-F.col("m")).alias("twice"), (-F.col("m")).cast("double").alias("sim"))
    return _large_pairs(sets, keys, by_shared, "shared int, twice long, sim double").unionByName(selves)


def pairwise_jaccard(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """``(keys, n_sets, jaccard)``: mean Jaccard over all pairs of a group's non-empty sets.

    Groups whose items are all untagged have no row; groups with one tagged item score 0.
    """
    sets = cut(distinct_sets(df, keys, tags))
    counts = sets.groupBy(*keys).agg(F.sum("m").alias("n_sets"))
    total = _small_set_sum(sets.filter(F.size("tags") <= MAX_SUBSET_TAGS), keys)
    if not sets.filter(F.size("tags") > MAX_SUBSET_TAGS).isEmpty():
        total = total.unionByName(_large_set_sum(sets, keys)).groupBy(*keys).agg(F.sum("total").alias("total"))
    n = F.col("n_sets").cast("double")
    return counts.join(total, keys).select(
        *keys, "n_sets", F.when(n > 1, F.col("total") / (n * (n - 1) / 2)).otherwise(0.0).alias("jaccard"))


def overlap_histogram(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """``(keys, shared, n_pairs, jaccard_sum)``: item pairs by the number of tags they share.

    What a pair listing would be used for, without listing pairs: the number of pairs sharing
    exactly c tags follows from the subset counts by inclusion and exclusion; pairs with a set of more than
    ``MAX_SUBSET_TAGS`` tags are counted in tiles.
    """
    every = cut(distinct_sets(df, keys, tags))
    sets = every.filter(F.size("tags") <= MAX_SUBSET_TAGS)
    per = subset_counts(sets, keys).select(*keys, F.size("subset").alias("s"), "by_size")
    cells = per.select(*keys, "s", F.explode("by_size").alias("x"), "by_size").select(
        *keys, "s", "x", F.explode("by_size").alias("y"))
    ways = cells.groupBy(*keys, F.col("x.a").alias("a"), F.col("y.a").alias("b"), "s").agg(
        F.sum((F.col("x.m") * F.col("y.m")).cast("decimal(38,0)")).alias("ways"))
    c = F.explode(F.sequence(F.lit(1), F.col("s"))).alias("shared")
    sign = F.when((F.col("s") - F.col("shared")) % 2 == 0, 1).otherwise(-1)
    exact = ways.select("*", c).groupBy(*keys, "a", "b", "shared").agg(
        F.sum(F.col("ways") * (sign * _choose(F.col("s"), F.col("shared"))).cast("long")).alias("pairs"))
    own = sets.groupBy(*keys, F.size("tags").alias("a")).agg(F.sum("m").alias("m")).select(
        *keys, "a", F.col("a").alias("b"), F.col("a").alias("shared"), (-F.col("m")).cast("decimal(38,0)").alias("pairs"))
    both = exact.select(*keys, "a", "b", "shared", F.col("pairs").cast("decimal(38,0)").alias("pairs")).unionByName(own)
    sim = F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))
    small = both.groupBy(*keys, "shared").agg(F.sum("pairs").cast("long").alias("twice"), F.sum(F.col("pairs").cast("double") * sim).alias("sim"))
    if not every.filter(F.size("tags") > MAX_SUBSET_TAGS).isEmpty():
        small = small.unionByName(_large_histogram(every, keys))
    return small.filter("shared > 0").groupBy(*keys, "shared").agg(
        (F.sum("twice") / 2).cast("long").alias("n_pairs"), (F.sum("sim") / 2).alias("jaccard_sum")).filter(F.col("n_pairs") > 0)


def concept_coherence(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """``(keys, n, coherence)``: share of all items of a group that carry its commonest tag."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = df.select(*keys, F.explode(F.array_distinct(F.col(tags))).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("m"))
    top = counts.groupBy(*keys).agg(F.max("m").alias("m"))
    share = F.coalesce(F.col("m"), F.lit(0)) / F.col("n")
    return sizes.join(top, keys, "left").select(*keys, "n", share.alias("coherence"))


def cluster_tag_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """``(by, cluster, n, four metrics)`` from tag arrays named after the metrics."""
    keys = [*by, "cluster"]
    jaccards = [m for m, (_, _, stat) in cfg.TAG_METRICS.items() if stat == "jaccard"]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("tags")) for m in jaccards])).alias("f")).select(*keys, "f.*")
    scores = pairwise_jaccard(long, [*keys, "metric"], "tags")
    wide = scores.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("jaccard"))).alias(m) for m in jaccards])
    base = concept_coherence(df, keys, "concept_coherence").withColumnRenamed("coherence", "concept_coherence")
    return base.join(wide, keys, "left").fillna(0.0, subset=jaccards)


def tag_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """``(by, four metrics)``: cluster metrics averaged with the cluster sizes as weights.

    ``df`` has ``by``, ``cluster`` and the tag arrays of :func:`tag_columns`.
    """
    per = cluster_tag_metrics(df, by)
    mean = [(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in cfg.TAG_METRICS]
    return per.groupBy(*by).agg(*mean)
