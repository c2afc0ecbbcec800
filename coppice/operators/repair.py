"""Repairing a tree: consolidating first-level groups, moving orphans, merging tiny leaves.

``tree(item_id, l1, l2, l3)`` is the only state; ``l3`` is null where a second-level group is a leaf.
Decisions are made on group summaries; the items are joined with the outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import vectors as vx
from coppice.operators import blocks as bl
from coppice.operators import vector_metrics as vm
from coppice.operators.linkage import find_roots
from coppice.session import cut, number_rows

NO_L3 = -1


def _sums(tree: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    return tree.join(vectors, "item_id").groupBy(*keys).agg(
        F.count("*").alias("n"), vx.sum_vector(F.col("features")).alias("total"))


def next_child_ids(children: DataFrame, adopted: DataFrame, parent: str, child: str, order: list[str]) -> DataFrame:
    """Number newly adopted children after the largest child id their new parent has."""
    last = children.groupBy(parent).agg(F.max(child).alias("_last"))
    place = F.row_number().over(W.partitionBy(parent).orderBy(*order))
    return adopted.withColumn("_place", place).join(last, parent, "left").withColumn(
        "new_id", (F.coalesce("_last", F.lit(-1)) + F.col("_place")).cast("int")).drop("_place", "_last")


def consolidate_l1(tree: DataFrame, vectors: DataFrame, threshold: float = cfg.CONSOLIDATE_COSINE) -> tuple[DataFrame, DataFrame]:
    """Merge the most similar first-level groups while their similarity reaches the threshold.

    Returns the tree and the log ``(round, kept, merged, similarity)``. The lower id is kept; the
    other group's children are renumbered after the kept group's own. At most one round per group.
    """
    spark = tree.sparkSession
    groups = cut(_sums(tree, vectors, ["l1"]))
    paths = cut(tree.select("l1", "l2").distinct().select("l1", "l2", F.col("l1").alias("to_l1"), F.col("l2").alias("to_l2")))
    log = []
    while True:
        vecs = groups.select(F.col("l1").cast("long").alias("gid"), F.transform("total", lambda v: v / F.col("n")).alias("vec"))
        near = vm.closest_groups(vecs).withColumn("kept", F.least("gid", "other")).withColumn("merged", F.greatest("gid", "other"))
        top = near.orderBy(F.desc(F.round("similarity", 12)), "kept", "merged").limit(1).collect()
        if not top or top[0]["similarity"] < threshold:
            break
        kept, merged = int(top[0]["kept"]), int(top[0]["merged"])
        log.append((len(log) + 1, kept, merged, float(top[0]["similarity"])))
        mine = paths.filter(F.col("to_l1") == kept)
        theirs = paths.filter(F.col("to_l1") == merged).withColumn("to_l1", F.lit(kept))
        renumbered = next_child_ids(mine, theirs, "to_l1", "to_l2", ["to_l2"]).select("l1", "l2", "to_l1", F.col("new_id").alias("to_l2"))
        paths = cut(paths.filter(F.col("to_l1") != merged).unionByName(renumbered))
        into = F.when(F.col("l1") == merged, kept).otherwise(F.col("l1")).alias("l1")
        groups = cut(groups.groupBy(into).agg(F.sum("n").alias("n"), vx.sum_vector(F.col("total")).alias("total")))
    moved = tree.join(paths, ["l1", "l2"]).select("item_id", F.col("to_l1").alias("l1"), F.col("to_l2").cast("int").alias("l2"), "l3")
    return moved, spark.createDataFrame(log, "round int, kept int, merged int, similarity double")


def reassign_orphans(tree: DataFrame, vectors: DataFrame, max_leaf: int = cfg.ORPHAN_MAX_LEAF,
                     factor: float = cfg.ORPHAN_DISTANCE_FACTOR, improvement: float = cfg.ORPHAN_IMPROVEMENT) -> tuple[DataFrame, DataFrame]:
    """Move items of small leaves that sit far out and have a clearly closer leaf elsewhere.

    All moves are decided on one snapshot of the leaves and applied together; a leaf left empty
    is gone, and an item's first level follows it. Returns the tree and the moves.
    """
    tree = cut(tree.withColumn("_l3", F.coalesce("l3", F.lit(NO_L3))))
    path = ["l1", "l2", "_l3"]
    means = vm.centroids(tree.join(vectors, "item_id"), path)
    leaves = cut(number_rows(means, path, "gid"))
    small = tree.join(leaves.filter(F.col("n") <= max_leaf).select(*path, "gid", "centroid"), path).join(vectors, "item_id")
    far = cut(small.select("item_id", "gid", "features", vx.cosine_distance(F.col("features"), F.col("centroid")).alias("distance")))
    # A median over at most ``max_leaf`` rows.
    typical = far.groupBy("gid").agg(F.median("distance").alias("typical"))
    out = far.join(typical, "gid").filter((F.col("distance") > factor * F.col("typical")) & (F.col("distance") > 0))
    rows = out.select(F.col("item_id").alias("id"), F.col("features").alias("vec"), F.col("gid").alias("own"))
    near = bl.best_group(rows, leaves.select("gid", F.col("centroid").alias("vec")), bl.COSINE)
    moves = near.withColumnRenamed("gid", "to").join(out.select(F.col("item_id").alias("id"), "gid", "distance"), "id").filter(
        F.col("cost") / F.col("distance") < improvement)
    moves = cut(moves.select(F.col("id").alias("item_id"), F.col("gid").alias("from_leaf"), F.col("to").alias("to_leaf"),
                             "distance", F.col("cost").alias("new_distance")))
    target = moves.join(leaves.select(F.col("gid").alias("to_leaf"), *[F.col(c).alias(f"to{c}") for c in path]), "to_leaf")
    moved = tree.join(cut(target.select("item_id", *[f"to{c}" for c in path])), "item_id", "left")
    new = [F.when(F.col("tol1").isNotNull(), F.col(f"to{c}")).otherwise(F.col(c)).alias(c) for c in path]
    return cut(_with_null(moved.select("item_id", *new))), moves


def _with_null(tree: DataFrame) -> DataFrame:
    return tree.select("item_id", "l1", "l2", F.when(F.col("_l3") != NO_L3, F.col("_l3")).cast("int").alias("l3"))


def _closest_sibling(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(gid, other)``: for each candidate the most similar group with the same parent number."""
    vec = F.transform("total", lambda v: v / F.col("n")).alias("vec")
    rows = candidates.select(F.col("gid").alias("id"), vec, F.col("gid").alias("own"), F.col("parent").alias("scope"))
    pool = groups.select("gid", vec, F.col("parent").alias("scope"))
    return bl.best_group(rows, pool, bl.COSINE).select(F.col("id").alias("gid"), F.col("gid").alias("other"))


def _merge_rounds(groups: DataFrame, small: int) -> DataFrame:
    """Merge the smallest small group of every parent into its closest sibling until none is left.

    ``groups(gid, parent, n, total, fixed)``; ``fixed`` groups take others in but are never merged
    away. Returns pointers ``(node, up, round)``. One merge per parent and round, so the rounds are
    bounded by the number of children of a parent.
    """
    state, steps, turn = cut(groups), None, 0
    while True:
        siblings = F.count("*").over(W.partitionBy("parent"))
        tiny = state.withColumn("_kin", siblings).filter((F.col("n") <= small) & ~F.col("fixed") & (F.col("_kin") > 1))
        rest = [c for c in state.columns if c != "parent"]
        first = tiny.groupBy("parent").agg(F.min_by(F.struct(*rest), F.struct("n", "gid")).alias("g")).select("parent", "g.*")
        first = cut(first)
        if first.isEmpty():
            return steps
        turn += 1
        step = cut(_closest_sibling(state, first).select(F.col("gid").alias("node"), F.col("other").alias("up"), F.lit(turn).alias("round")))
        steps = step if steps is None else steps.unionByName(step)
        to = step.select(F.col("node").alias("gid"), F.col("up").alias("_up"))
        state = cut(state.join(to, "gid", "left").groupBy(F.coalesce("_up", "gid").alias("gid"), "parent").agg(
            F.sum("n").alias("n"), vx.sum_vector(F.col("total")).alias("total"), F.max("fixed").alias("fixed")))


def _destinations(groups: DataFrame, steps: DataFrame) -> DataFrame:
    """``(gid, to)`` of every group after all merges."""
    links = groups.select(F.col("gid").alias("node")).join(steps.select("node", "up"), "node", "left").select(
        F.lit(0).alias("z"), "node", F.coalesce("up", "node").alias("up"))
    return find_roots(links, ["z"]).select(F.col("node").alias("gid"), F.col("up").alias("to"))


def merge_small_leaves(tree: DataFrame, vectors: DataFrame, small: int = cfg.SMALL_LEAF_SIZE) -> DataFrame:
    """Merge leaves of at most ``small`` items into their most similar sibling, never across parents.

    Third-level leaves first; a parent left with one third-level group becomes a leaf again. Then
    second-level leaves: merged into a sibling with children of its own, the items become a new
    third-level group of it.
    """
    tree = cut(tree)
    threes = tree.filter("l3 is not null")
    if not threes.isEmpty():
        tree = cut(_merge_level(tree, vectors, threes, small))
    twos = _sums(tree, vectors, ["l1", "l2"]).join(
        tree.groupBy("l1", "l2").agg(F.max(F.col("l3").isNotNull()).alias("fixed")), ["l1", "l2"])
    groups = cut(number_rows(twos, ["l1", "l2"], "gid").withColumn("parent", F.col("l1")))
    steps = _merge_rounds(groups.select("gid", "parent", "n", "total", "fixed"), small)
    if steps is None:
        return tree
    steps = cut(steps)
    to = cut(_destinations(groups, steps))
    # Every group that ends up in a parent of third-level groups becomes one new group of it.
    final = groups.select(F.col("gid").alias("to"), F.col("l2").alias("to_l2"), "fixed")
    moved = to.filter("gid <> to").join(final, "to")
    entry = _entries(steps, groups)
    adopted = entry.join(final, "to").filter("fixed").select("to", "entry").distinct()
    kids = tree.filter("l3 is not null").join(groups.select("l1", "l2", F.col("gid").alias("to")), ["l1", "l2"]).select("to", "l3")
    ids = next_child_ids(kids, adopted, "to", "l3", ["entry"]).select("to", "entry", F.col("new_id").alias("new_l3"))
    change = moved.join(entry.select("gid", "entry"), "gid").join(ids, ["to", "entry"], "left").join(
        groups.select("gid", "l1", "l2"), "gid").select("l1", "l2", "to_l2", "new_l3", F.lit(True).alias("_m"))
    joined = tree.join(cut(change), ["l1", "l2"], "left")
    return cut(joined.select("item_id", "l1", F.coalesce("to_l2", "l2").alias("l2"),
                             F.when(F.col("_m"), F.col("new_l3")).otherwise(F.col("l3")).cast("int").alias("l3")))


def _entries(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """``(gid, entry, to)``: the last group a merged one passed through before its destination."""
    last = steps.join(steps.select(F.col("node").alias("up"), F.lit(True).alias("_on")), "up", "left")
    links = last.select(F.lit(0).alias("z"), "node", F.when(F.col("_on"), F.col("up")).otherwise(F.col("node")).alias("up"))
    heads = find_roots(links, ["z"]).select(F.col("node").alias("gid"), F.col("up").alias("entry"))
    return heads.join(steps.select(F.col("node").alias("entry"), F.col("up").alias("to")), "entry").select("gid", "entry", "to")


def _merge_level(tree: DataFrame, vectors: DataFrame, threes: DataFrame, small: int) -> DataFrame:
    parents = number_rows(threes.select("l1", "l2").distinct(), ["l1", "l2"], "parent").withColumn("parent", F.col("parent").cast("int"))
    sums = _sums(threes, vectors, ["l1", "l2", "l3"]).join(parents, ["l1", "l2"])
    groups = cut(number_rows(sums, ["l1", "l2", "l3"], "gid").withColumn("fixed", F.lit(False)))
    steps = _merge_rounds(groups.select("gid", "parent", "n", "total", "fixed"), small)
    if steps is None:
        return tree
    to = _destinations(groups, cut(steps))
    names = groups.select("gid", "parent", "l1", "l2", "l3")
    change = names.join(to, "gid").join(groups.select(F.col("gid").alias("to"), F.col("l3").alias("to_l3")), "to")
    left = change.groupBy("parent").agg(F.countDistinct("to").alias("left"))
    change = change.join(left, "parent").select(
        "l1", "l2", "l3", F.when(F.col("left") > 1, F.col("to_l3")).alias("to_l3"), F.lit(True).alias("_m"))
    joined = tree.join(cut(change), ["l1", "l2", "l3"], "left")
    return joined.select("item_id", "l1", "l2", F.when(F.col("_m"), F.col("to_l3")).otherwise(F.col("l3")).alias("l3"))
