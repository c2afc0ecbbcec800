"""Competing clusterings: generate, score, pick, split and try again.

``items`` carries ``item_id``, ``features`` and the tag arrays of ``tag_metrics.tag_columns``, and
``scope`` where several groups are clustered side by side. Each algorithm runs once for all its
cluster counts and all groups; candidates come back in one long assignment table.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.operators import birch, centers, density, linkage, scores, spectral
from coppice.operators import vector_metrics as vm
from coppice.operators.hierarchy import cluster_distribution
from coppice.operators.tag_metrics import tag_metrics
from coppice.session import cut, number_rows

CONFIG = ["scope", "ord"]
PARALLEL_FITS = 6  # algorithms fitted side by side; each is a series of Spark jobs of its own


def _scoped(items: DataFrame) -> DataFrame:
    return items if "scope" in items.columns else items.withColumn("scope", F.lit(0))


def _fits(rows: DataFrame, configs: list[tuple], starts: int) -> dict[tuple, Callable[[], DataFrame]]:
    """``(algo, method) -> fit`` giving ``(id, scope, k, cluster)`` for all sizes of that algorithm."""
    sizes: dict[tuple, list[int]] = {}
    for algo, method, size in configs:
        sizes.setdefault((algo, method), []).append(size)
    def run(algo: str, method: str | None, ks: list[int]) -> DataFrame:
        if algo == "kmeans":
            return centers.kmeans_sweep(rows, ks, starts)
        if algo == "gmm":
            return centers.gmm_sweep(rows, ks, min(starts, centers.GMM_STARTS)).drop("converged")
        if algo == "birch":
            return birch.birch(rows, ks)
        if algo == "spectral":
            return spectral.spectral_sweep(rows, ks, starts=starts)
        if algo == "hdbscan":
            return density.hdbscan_sweep(rows, ks)
        return linkage.agglomerative(rows, method or algo, ks)

    return {key: (lambda a=key[0], m=key[1], ks=ks: run(a, m, ks)) for key, ks in sizes.items()}


def candidate_sweep(items: DataFrame, configs: list[tuple], spectral_max: int | None = None,
                    starts: int = centers.KMEANS_STARTS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(scope, ord, algo, method, size, item_id, cluster)`` and the fits that failed.

    ``configs`` are ``(algo, method, size)`` in generation order; ``ord`` is the place in it.
    Candidates with fewer than two clusters, or one per item, are left out. Every algorithm is fitted to every scope, whatever its
    size; only a caller who passes ``spectral_max`` keeps spectral clustering to scopes of that many items.
    """
    spark = items.sparkSession
    rows = cut(_scoped(items).select(F.col("item_id").alias("id"), "scope", F.col("features").alias("vec")))
    sizes = cut(rows.groupBy("scope").agg(F.count("*").alias("n")))
    plan = cut(scores.valid_configs(sizes, configs, ["scope"], spectral_max))
    wanted = {(r["algo"], r["method"]) for r in plan.select("algo", "method").distinct().collect()}
    gate = rows if spectral_max is None else rows.join(sizes.filter(F.col("n") <= spectral_max), "scope", "left_semi")
    fits = {**_fits(rows, [c for c in configs if c[0] != "spectral"], starts), **_fits(gate, [c for c in configs if c[0] == "spectral"], starts)}

    def attempt(key: tuple):
        try:
            return cut(fits[key]().withColumn("algo", F.lit(key[0])).withColumn("method", F.lit(key[1]).cast("string")))
        except (np.linalg.LinAlgError, PythonException) as e:  # a matrix that cannot be factored costs its candidates, not the sweep
            if isinstance(e, PythonException) and "LinAlgError" not in str(e):
                raise
            return key[1] or key[0], f"{type(e).__name__}: {e}"[:500]

    with ThreadPool(PARALLEL_FITS) as pool:
        done = pool.map(inheritable_thread_target(spark)(attempt), [k for k in fits if k in wanted], chunksize=1)
    parts = [d for d in done if isinstance(d, DataFrame)]
    failed = [d for d in done if not isinstance(d, DataFrame)]
    if not parts:
        return spark.createDataFrame([], "scope int, ord int, algo string, method string, size int, item_id long, cluster int"), failed
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    on = [F.col("a.scope") == F.col("p.scope"), F.col("a.algo") == F.col("p.algo"),
          F.col("a.method").eqNullSafe(F.col("p.method")), F.col("a.k") == F.col("p.size")]
    kept = cut(long.alias("a").join(plan.alias("p"), on).select(
        "a.scope", "p.ord", "a.algo", "a.method", "p.size", F.col("a.id").alias("item_id"), "a.cluster"))
    shape = kept.groupBy(*CONFIG).agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n"))
    good = shape.filter((F.col("k") >= 2) & (F.col("k") < F.col("n"))).select(*CONFIG)
    return kept.join(good, CONFIG, "left_semi"), failed


def score_candidates(items: DataFrame, assignments: DataFrame, full: bool = False, silhouette_kind: str = "euclidean") -> DataFrame:
    """One row per candidate: shape, tag metrics, separation and stage-1 score.

    ``full`` adds the Calinski-Harabasz and Davies-Bouldin indices. The silhouette is of the kind
    named, whatever the number of items; rankings must not mix kinds.
    """
    items = _scoped(items)
    assigned = cut(assignments.select(*CONFIG, "algo", "method", "size", "item_id", "cluster"))
    tags = items.select("item_id", *cfg.TAG_METRICS)
    tagged = tag_metrics(assigned.select(*CONFIG, "item_id", "cluster").join(tags, "item_id"), CONFIG)
    config = F.concat_ws("-", *CONFIG).alias("config_id")
    labels = assigned.select("item_id", config, "cluster")
    vectors = items.select("item_id", "features", "scope")
    sil = vm.silhouette(vectors, labels, silhouette_kind)
    shape = cluster_distribution(assigned, CONFIG)
    info = assigned.select(*CONFIG, "algo", "method", "size").distinct()
    out = info.join(shape, CONFIG).join(tagged, CONFIG).withColumn("config_id", F.concat_ws("-", *CONFIG)).join(sil, "config_id")
    if full:
        out = out.join(vm.calinski_harabasz(vectors.drop("scope"), labels), "config_id").join(
            vm.davies_bouldin(vectors.drop("scope"), labels), "config_id")
    return out.drop("config_id").withColumn("stage1_score", scores.stage1_score())


def pick_best(items: DataFrame, configs: list[tuple], **kw) -> tuple[DataFrame, DataFrame]:
    """The best candidate of every scope and its labels ``(scope, item_id, cluster, score)``."""
    assignments, _ = candidate_sweep(items, configs, **kw)
    assignments = cut(assignments)
    if assignments.isEmpty():
        return None, assignments.select("scope", "item_id", "cluster", F.lit(0.0).alias("score"))
    scored = cut(score_candidates(items, assignments))
    best = cut(scores.best_candidate(scored, ["scope"], "stage1_score"))
    labels = assignments.join(best.select(*CONFIG, F.col("stage1_score").alias("score")), CONFIG)
    return best, labels.select("scope", "item_id", "cluster", "score")


def split_groups(items: DataFrame, groups: Column | str, ks: list[int], threshold: float, min_sizes: list[int] | None = None,
                 **kw) -> DataFrame:
    """``(item_id, cluster)``: every group clustered by itself; null where a group stays whole.

    ``groups`` numbers the group of each item. Groups that are too small, have no usable candidate,
    or whose best score is below ``threshold`` are not split.
    """
    grouped = items.withColumn("scope", (F.col(groups) if isinstance(groups, str) else groups).cast("int"))
    sizes = grouped.groupBy("scope").agg(F.count("*").alias("n"))
    big = cut(grouped.join(scores.splittable_groups(sizes).select("scope"), "scope", "left_semi"))
    whole = grouped.select("item_id")
    if big.isEmpty():
        return whole.withColumn("cluster", F.lit(None).cast("int"))
    _, labels = pick_best(big, scores.sweep_rows(ks, min_sizes), **kw)
    accepted = labels.filter(F.col("score") >= threshold).select("item_id", "cluster")
    return whole.join(accepted, "item_id", "left")


def overall_quality(items: DataFrame, labels: DataFrame) -> float:
    """Stage-1 score with the second-level groups as clusters; 0 without two usable groups.

    ``labels(item_id, l1, l2)``.
    """
    keys = number_rows(labels.select("l1", "l2").distinct(), ["l1", "l2"], "cluster")
    flat = cut(labels.join(keys, ["l1", "l2"]).select(
        F.lit(0).alias("scope"), F.lit(0).alias("ord"), F.lit("tree").alias("algo"), F.lit(None).cast("string").alias("method"),
        F.lit(0).alias("size"), "item_id", F.col("cluster").cast("int").alias("cluster")))
    k, n = flat.agg(F.countDistinct("cluster"), F.count("*")).first()
    if k < 2 or k >= n:
        return 0.0
    return float(score_candidates(items.drop("scope"), flat).first()["stage1_score"])


Judge = Callable[[DataFrame], DataFrame]


def judged_shortlist(items: DataFrame, assignments: DataFrame, scored: DataFrame, n: int, judge: Judge | None) -> DataFrame:
    """The ``n`` best candidates by stage-1 score with judge, final score and both ranks.

    ``judge`` gets ``(ord, cluster, n, technology_name, Technology_Description, item_id)`` members of
    the shortlisted candidates and returns ``(ord, cluster, score)``; unrated clusters count as 3.
    """
    short = cut(scores.shortlist(scored, n))
    members = assignments.join(short.select(*CONFIG), CONFIG, "left_semi").select("ord", "cluster", "item_id")
    sizes = members.groupBy("ord", "cluster").agg(F.count("*").alias("n"))
    if judge is None:
        rated = sizes.withColumn("score", F.lit(cfg.JUDGE_DEFAULT))
    else:
        text = items.select("item_id", "technology_name", "Technology_Description")
        rated = scores.apply_judge(sizes, judge(members.join(text, "item_id")), ["ord"])
    short = short.join(scores.judge_coherence(rated, ["ord"]), "ord").withColumn("final_score", scores.final_score())
    return cut(scores.rerank(short, ["scope"]))


def correction_loop(items: DataFrame, judge: Judge | None = None, ks: list[int] | None = None, l2_ks: list[int] | None = None,
                    min_sizes: list[int] | None = None, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First- and second-level groups: ``(labels, shortlist, attempts)``.

    The best three judged candidates are split in turn; the first whose overall quality is good
    enough wins, else the best of the three. ``labels(item_id, l1, l2)``. Where no split is possible
    all items are one group and no attempt is listed.
    """
    assignments, _ = candidate_sweep(items, scores.sweep_rows(ks or cfg.L1_KS, min_sizes), **kw)
    assignments = cut(assignments)
    short = judged_shortlist(items, assignments, cut(score_candidates(items, assignments)), cfg.SHORTLIST_TREE, judge)
    tries, made = [], {}
    for row in short.filter(F.col("final_rank") <= cfg.L1_ATTEMPTS).orderBy("final_rank").collect():
        l1 = assignments.filter(F.col("ord") == row["ord"]).select("item_id", F.col("cluster").alias("l1"))
        parts = cut(items.drop("scope").join(l1, "item_id"))
        l2 = split_groups(parts, "l1", l2_ks or cfg.L2_KS, cfg.L2_MIN_SCORE, min_sizes, **kw)
        labels = cut(l1.join(l2, "item_id").select("item_id", "l1", F.coalesce("cluster", F.lit(0)).alias("l2")))
        quality = overall_quality(items, labels)
        made[row["final_rank"]] = labels
        tries.append((0, row["final_rank"], row["ord"], row["algo"], row["size"], quality))
        if quality >= cfg.ACCEPT_QUALITY:
            break
    attempts = items.sparkSession.createDataFrame(
        tries, "scope int, final_rank int, ord int, algo string, size int, quality double")
    winner = scores.accept_attempt(attempts, ["scope"]).first()
    if winner is None:  # nothing can be split: one group
        return items.select("item_id", F.lit(0).alias("l1"), F.lit(0).alias("l2")), short, attempts
    return made[winner["final_rank"]], short, attempts
