"""Scores, rankings and acceptance rules over small tables of candidate configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice import settings as cfg


def _weighted(weights: dict[str, float], terms: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * terms.get(m, F.col(m)) for m, w in weights.items()])


def _unit_silhouette() -> Column:
    return (F.col("silhouette") + 1) / 2


def stage1_score() -> Column:
    return _weighted(cfg.STAGE1_WEIGHTS, {"silhouette": _unit_silhouette()})


def final_score() -> Column:
    return _weighted(cfg.FINAL_WEIGHTS, {
        "silhouette": _unit_silhouette(), "judge_coherence": F.col("judge_coherence") / cfg.JUDGE_MAX})


def apply_judge(clusters: DataFrame, ratings: DataFrame, by: list[str]) -> DataFrame:
    """Put a rating on every ``(by, cluster)``; a missing or failed one counts as the middle."""
    keys = [*by, "cluster"]
    joined = clusters.join(ratings.select(*keys, "score"), keys, "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(cfg.JUDGE_DEFAULT)))


def judge_coherence(rated: DataFrame, by: list[str]) -> DataFrame:
    """Size-weighted mean rating per configuration; 0 without any weight."""
    weight = F.sum("n")
    mean = F.when(weight > 0, F.sum(F.col("score") * F.col("n")) / weight).otherwise(0.0)
    return rated.groupBy(*by).agg(mean.alias("judge_coherence"))


def best_candidate(candidates: DataFrame, by: list[str], score: str, ord_col: str = "ord") -> DataFrame:
    """The best-scoring row per group, the earliest one on a tie; a partial aggregation."""
    rest = [c for c in candidates.columns if c not in by]
    key = F.struct(F.col(score).alias("s"), (-F.col(ord_col)).alias("o"))
    best = candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("_row"))
    return best.select(*by, "_row.*")


def shortlist(candidates: DataFrame, n: int, score: str = "stage1_score", ord_col: str = "ord") -> DataFrame:
    return candidates.orderBy(F.desc(score), F.asc(ord_col)).limit(n)


def shortlist_per_group(candidates: DataFrame, by: list[str], n: int, score: str, ord_col: str) -> DataFrame:
    """The ``n`` best rows per group with their rank; limited per partition ahead of the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(ord_col))
    return candidates.withColumn("stage1_rank", F.row_number().over(order)).filter(F.col("stage1_rank") <= n)


def rerank(short: DataFrame, by: list[str], before: str = "stage1_score", after: str = "final_score", ord_col: str = "ord") -> DataFrame:
    """Ranks before and after judging and how far each row moved up."""
    first = W.partitionBy(*by).orderBy(F.desc(before), F.asc(ord_col))
    then = W.partitionBy(*by).orderBy(F.desc(after), F.desc(before), F.asc(ord_col))
    ranked = short.withColumn("stage1_rank", F.row_number().over(first)).withColumn("final_rank", F.row_number().over(then))
    return ranked.withColumn("moved_up", F.col("stage1_rank") - F.col("final_rank"))


def accept_attempt(attempts: DataFrame, by: list[str], quality: str = "quality", rank: str = "final_rank",
                   threshold: float = cfg.ACCEPT_QUALITY, tries: int = cfg.L1_ATTEMPTS) -> DataFrame:
    """Of the first few candidates the first that is good enough, else the best of them."""
    tried = attempts.filter(F.col(rank) <= tries)
    rest = [c for c in attempts.columns if c not in by]
    row = F.struct(*rest)
    good = F.when(F.col(quality) >= threshold, F.col(rank))
    top = F.struct(F.col(quality).alias("q"), (-F.col(rank)).alias("r"))
    picked = F.coalesce(F.min_by(F.when(good.isNotNull(), row), good), F.max_by(row, top))
    accepted = F.coalesce(F.max(F.col(quality) >= threshold), F.lit(False))
    return tried.groupBy(*by).agg(picked.alias("_row"), accepted.alias("accepted")).select(*by, "_row.*", "accepted")


def _average_rank(by: list[str], value: str) -> Column:
    peers = W.partitionBy(*by, value)
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(peers) - 1) / 2


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation of two scores within each shortlist (average ranks on ties)."""
    ranked = rows.withColumn("_x", _average_rank(by, x)).withColumn("_y", _average_rank(by, y))
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"),
        F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_y") * F.col("_y")).alias("syy"),
        F.sum(F.col("_x") * F.col("_y")).alias("sxy"))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    return sums.select(*by, "n", F.when(spread > 0, cov / F.sqrt(spread)).alias("spearman"))


def splittable_groups(sizes: DataFrame, minimum: int = cfg.MIN_SPLIT_SIZE) -> DataFrame:
    return sizes.filter(F.col("n") >= minimum)


def accept_split(labelled: DataFrame, threshold: float) -> DataFrame:
    """Keep a group's new labels when its best score reaches the threshold, else one leaf."""
    good = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return labelled.withColumn("cluster", F.when(good, F.col("cluster")).otherwise(F.lit(0)))


def _configs(rows: list[tuple]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(a).alias("algo"), F.lit(m).cast("string").alias("method"), F.lit(s).alias("size"))
        for i, (a, m, s) in enumerate(rows)]))


def sweep_rows(ks: list[int], min_sizes: list[int] | None = None) -> list[tuple]:
    """The pipeline's candidates in generation order: five algorithms per k, then densities."""
    algos = ["kmeans", "ward", "gmm", "birch", "spectral"]
    sizes = cfg.SWEEP_MIN_SIZES if min_sizes is None else min_sizes
    return [(a, None, k) for k in ks for a in algos] + [("hdbscan", None, s) for s in sizes]


def grid_rows() -> list[tuple]:
    """The experiment's clusterings in generation order."""
    linkage = [("agglomerative", m, k) for m in cfg.GRID_LINKAGES for k in cfg.GRID_KS]
    flat = [(a, None, k) for a in ("kmeans", "spectral") for k in cfg.GRID_KS]
    return linkage + flat + [("hdbscan", None, s) for s in cfg.GRID_MIN_SIZES]


def valid_configs(groups: DataFrame, rows: list[tuple], by: list[str], spectral_max: int | None = cfg.SPECTRAL_MAX_ITEMS) -> DataFrame:
    """The configurations that make sense for each group's size ``n``.

    Fewer clusters than items; spectral only on groups of at most ``spectral_max`` items (None: all); a density size below half the group.
    """
    all_rows = groups.select(*by, "n", _configs(rows).alias("c")).select(*by, "n", "c.*")
    gate = F.lit(True) if spectral_max is None else (F.col("algo") != "spectral") | (F.col("n") <= spectral_max)
    ok = F.when(F.col("algo") == "hdbscan", F.col("size") < F.floor(F.col("n") / 2)).otherwise((F.col("size") < F.col("n")) & gate)
    return all_rows.filter(ok)


def grid_configs(models: DataFrame) -> DataFrame:
    """``(config_id, model, variant, ord, algo, method, size)`` for every embedding model row."""
    from coppice.functions.text import config_label

    variants = F.explode(F.array(*[F.lit(v) for v in cfg.TEXT_VARIANTS]))
    grid = models.select("model", variants.alias("variant")).select("model", "variant", _configs(grid_rows()).alias("c"))
    flat = grid.select("model", "variant", "c.*")
    label = config_label(F.col("algo"), F.col("method"), F.col("size"))
    return flat.withColumn("cluster_algo", label).withColumn("config_id", F.concat_ws("_", "model", "variant", "cluster_algo"))
