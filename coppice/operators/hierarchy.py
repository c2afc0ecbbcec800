"""Hierarchy roll-ups, ids and look-ups on a result table.

A result table has one row per item with ``category_level_1..3`` (``""`` for an absent level),
``full_path`` and ``leaf_category``. Node tables are the distinct paths of it: they are tree-sized,
so items are first reduced to paths by a partial aggregation and everything else works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import text as tx
from coppice.session import cut, number_rows

L1, L2, L3 = cfg.LEVELS
PATH = ["l1", "l2", "l3"]
KEYS = ["_k1", "_k2", "_k3"]


def with_paths(items: DataFrame) -> DataFrame:
    """Add ``full_path`` and ``leaf_category``."""
    levels = [F.col(c) for c in cfg.LEVELS]
    return items.withColumn("full_path", tx.full_path(levels)).withColumn("leaf_category", tx.leaf_of(levels))


def non_empty(df: DataFrame, level: str) -> DataFrame:
    return df.filter(F.col(level) != "")


def path_counts(result: DataFrame) -> DataFrame:
    return result.groupBy(*cfg.LEVELS).agg(F.count("*").alias("n"))


def with_keys(df: DataFrame) -> DataFrame:
    """Add ``_k1.._k3``, which tell the nodes of a path apart: its names and, where the table has them, its numbers.

    Names are labels: siblings of one name are two nodes if ``l1``, ``l2``, ``l3`` say so.
    """
    def key(name: str, number: str) -> Column:
        if number not in df.columns:
            return F.col(name)
        return F.when(F.col(name) == "", "").otherwise(F.concat_ws("\0", name, F.col(number).cast("string")))

    return df.withColumns({k: key(c, p) for k, c, p in zip(KEYS, cfg.LEVELS, PATH)})


def node_paths(result: DataFrame) -> DataFrame:
    return with_keys(result).groupBy(*KEYS, *cfg.LEVELS).agg(F.count("*").alias("n"))


def node_ids(paths: DataFrame) -> DataFrame:
    """``(level_1, level_2, level_3, level, n, node_id)`` and the keys: one row per node of the tree.

    A node's number is its rank by size among its siblings; names break ties. A third-level node
    directly under a first-level one is numbered ``1.0.k`` so that it never shares its parent's id.
    The windows rank nodes, not items, and are split by parent below the first level. The paths are
    written once, so the three levels do not each aggregate the items again.
    """
    paths = cut(paths if KEYS[0] in paths.columns else with_keys(paths))
    k1, k2, k3 = KEYS

    def level(keys: list[str], parent: list[str]) -> DataFrame:
        names = [F.min(c).alias(c) for c in cfg.LEVELS[:len(keys)]]
        nodes = non_empty(paths, keys[-1]).groupBy(*keys).agg(F.sum("n").alias("n"), *names)
        order = W.partitionBy(*parent).orderBy(F.desc("n"), F.asc(keys[-1]))
        return nodes.withColumn(f"_r{len(keys)}", F.row_number().over(order))

    one = level([k1], [])
    two = level([k1, k2], [k1]).join(one.select(k1, "_r1"), k1)
    three = (
        level(KEYS, [k1, k2])
        .join(one.select(k1, "_r1"), k1)
        .join(two.select(k1, k2, "_r2"), [k1, k2], "left")
        .withColumn("_r2", F.coalesce("_r2", F.lit(0)))
    )
    blank = F.lit("")
    return (
        one.select(k1, blank.alias(k2), blank.alias(k3), L1, blank.alias(L2), blank.alias(L3), F.lit(1).alias("level"), "n",
                   F.col("_r1").cast("string").alias("node_id"))
        .unionByName(two.select(k1, k2, blank.alias(k3), L1, L2, blank.alias(L3), F.lit(2).alias("level"), "n",
                                F.concat_ws(".", "_r1", "_r2").alias("node_id")))
        .unionByName(three.select(*KEYS, L1, L2, L3, F.lit(3).alias("level"), "n",
                                  F.concat_ws(".", "_r1", "_r2", "_r3").alias("node_id")))
    )


def assign_ids(result: DataFrame) -> DataFrame:
    """Add ``full_numeric_id``, the dotted id of the deepest node on the item's path."""
    ids = node_ids(node_paths(result)).select(*KEYS, F.col("node_id").alias("full_numeric_id"))
    return with_keys(result).join(cut(ids), KEYS).drop(*KEYS)


def taxonomy_summary(result: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per node: id, category, parent (``-`` at the top), level, item count, summary.

    ``summaries`` has ``category_level_1..3, summary`` (and path numbers if ``result`` has) and is matched by path.
    """
    nodes = node_ids(node_paths(result))
    if summaries is None:
        nodes = nodes.withColumn("summary", F.lit(""))
    else:
        nodes = nodes.join(with_keys(summaries).select(*KEYS, "summary"), KEYS, "left")
    own, parent = _own_and_parent()
    return nodes.select(
        F.col("node_id").alias("id"), own.alias("category"), parent.alias("parent"), "level",
        F.col("n").alias("tech_count"), F.coalesce("summary", F.lit("")).alias("summary"),
    )


def _own_and_parent() -> tuple[Column, Column]:
    own = F.when(F.col("level") == 1, F.col(L1)).when(F.col("level") == 2, F.col(L2)).otherwise(F.col(L3))
    parent = (
        F.when(F.col("level") == 1, F.lit("-"))
        .when((F.col("level") == 3) & (F.col(L2) != ""), F.col(L2))
        .otherwise(F.col(L1))
    )
    return own, parent


def summary_levels(result: DataFrame) -> DataFrame:
    """``(level, category, tech_count)`` of all three levels in one pass over the paths."""
    paths = path_counts(result)
    own = [F.struct(F.lit(i + 1).alias("level"), F.col(c).alias("category")) for i, c in enumerate(cfg.LEVELS)]
    return (
        paths.select("n", F.explode(F.array(*own)).alias("node"))
        .select("n", "node.*")
        .filter(F.col("category") != "")
        .groupBy("level", "category")
        .agg(F.sum("n").alias("tech_count"))
    )


def leaf_nodes(summary: DataFrame) -> DataFrame:
    """Summary rows that are nobody's parent."""
    parents = summary.select(F.col("parent").alias("category")).distinct()
    return summary.join(parents, "category", "left_anti")


def children_of(summary: DataFrame, parent: str = "-") -> DataFrame:
    """The children of a node with a has-children flag and their natural position."""
    parents = summary.select(F.col("parent").alias("category")).distinct().withColumn("has_children", F.lit(True))
    rows = (
        summary.filter(F.col("parent") == parent)
        .join(parents, "category", "left")
        .withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    )
    return natural_order(rows, "id")


def natural_order(df: DataFrame, id_column: str, name: str = "position", ties: list[str] | None = None) -> DataFrame:
    """Number rows by dotted id, ``1.2 < 1.10 < 2``."""
    return number_rows(df, [tx.natural_key(F.col(id_column)), id_column, *(ties or [])], name)


def leaf_sizes(result: DataFrame) -> DataFrame:
    return result.groupBy("leaf_category").agg(F.count("*").alias("size"))


def leaf_size_histogram(result: DataFrame) -> DataFrame:
    return leaf_sizes(result).groupBy("size").agg(F.count("*").alias("n_leaves"))


def leaf_kpis(result: DataFrame) -> DataFrame:
    """One row of tree figures.

    The median comes from the size histogram, which has few rows however many leaves there are:
    the middle leaf (or two) is where the running leaf count crosses half.
    """
    hist = leaf_size_histogram(result)
    running = W.orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("n_leaves").over(W.partitionBy())
    upto = hist.withColumn("_upto", F.sum("n_leaves").over(running)).withColumn("_total", total)
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    leaves = upto.agg(
        F.sum("n_leaves").alias("n_leaves"),
        (F.sum(F.col("size") * F.col("n_leaves")) / F.sum("n_leaves")).alias("mean_leaf"),
        ((F.min(F.when(F.col("_upto") >= low, F.col("size")))
          + F.min(F.when(F.col("_upto") >= high, F.col("size")))) / 2).alias("median_leaf"),
        F.min("size").alias("min_leaf"),
        F.max("size").alias("max_leaf"),
        F.sum(F.when(F.col("size") <= cfg.ORPHAN_MAX_LEAF, F.col("n_leaves")).otherwise(0)).alias("small_leaves"),
    )
    tops = path_counts(result).groupBy(L1).agg(F.sum("n").alias("n"), F.max(F.col(L3) != "").alias("deep"))
    tree = tops.agg(
        F.count("*").alias("n_l1"),
        (F.max("n") * 100.0 / F.sum("n")).alias("largest_l1_pct"),
        F.when(F.max("deep"), 3).otherwise(2).alias("depth"),
    )
    both = leaves.unionByName(tree, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def sunburst_levels(result: DataFrame) -> DataFrame:
    """Fill absent levels so that every item has a full three-part path."""
    return result.select(
        F.col(L1).alias("L1"),
        F.coalesce(tx.blank_to_null(F.col(L2)), F.col(L1)).alias("L2"),
        F.coalesce(tx.blank_to_null(F.col(L3)), F.col("leaf_category")).alias("L3"),
    )


def sunburst_counts(result: DataFrame) -> DataFrame:
    return sunburst_levels(result).groupBy("L1", "L2", "L3").agg(F.count("*").alias("n"))


def filter_l1(result: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    return result.filter(F.col(L1).isin(chosen)) if chosen else result


def search_name(result: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """Items whose name contains the pattern, with their path and a shortened description."""
    hits = result.filter(tx.search_condition(F.col("technology_name"), query, literal))
    return hits.select(
        "technology_name", "full_path",
        tx.shorten(F.col("Technology_Description"), cfg.SEARCH_CHARS, "…").alias("excerpt"),
    )


def leaf_members(result: DataFrame, leaf: str | Column) -> DataFrame:
    """The items of the chosen leaf (or of every leaf matching a condition), numbered from 1."""
    wanted = F.col("leaf_category") == leaf if isinstance(leaf, str) else leaf
    members = result.filter(wanted).select("leaf_category", "item_id", "technology_name", "Technology_Description")
    return number_rows(members, ["item_id"], "position", within=["leaf_category"])


def display_projection(result: DataFrame) -> DataFrame:
    """The browsable columns that are there, numbered in natural id order."""
    wanted = ["item_id", "full_numeric_id", "technology_name", *cfg.LEVELS, "leaf_category"]
    shown = result.select(*[c for c in wanted if c in result.columns])
    return natural_order(shown, "full_numeric_id", ties=["item_id"])


def preview(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy("item_id").limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: str = "item_id") -> DataFrame:
    """Keep the earliest row of every key; a partial aggregation, not a window over the group."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def chunked_lists(df: DataFrame, key: str, value: str, order: list[str], chunk: int = 500) -> DataFrame:
    """``(key, part_no, n, values)``: a key's values in order, at most ``chunk`` to a row.

    A key with few values gets the single row the list would be; a key that holds much of the
    table is spread over as many rows as it needs, and no task ever gathers it.
    """
    numbered = number_rows(df.select(key, value, *[c for c in order if c not in (key, value)]), order, "_no", within=[key])
    part = F.floor((F.col("_no") - 1) / chunk).alias("part_no")
    packed = numbered.groupBy(key, part).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_no", value))).alias("_vals"))
    return packed.select(key, "part_no", "n", F.transform("_vals", lambda v: v[value]).alias("values"))


def leaf_item_lists(result: DataFrame, chunk: int = 500) -> DataFrame:
    return chunked_lists(result, "leaf_category", "technology_name", ["item_id"], chunk)


def tree_leaves(tree: DataFrame) -> DataFrame:
    """``(l1, l2, l3, n)``: the leaves of a tree table; membership stays in the tree itself."""
    return tree.groupBy("l1", "l2", "l3").agg(F.count("*").alias("n"))


def attach_names(tree: DataFrame, names: DataFrame) -> DataFrame:
    """Put names on an item's path and blank the levels it does not have.

    ``tree(item_id, l1, l2, l3)``, ``names(level, l1, l2, l3, name, summary)``. A second level is
    only shown when its parent has more than one. Names are joined to the distinct paths first,
    so the item-side join is a single one.
    """
    paths = cut(tree.select("l1", "l2", "l3").distinct())
    split = paths.groupBy("l1").agg((F.countDistinct("l2") > 1).alias("_split"))

    def level(n: int, keys: list[str]) -> DataFrame:
        return names.filter(F.col("level") == n).select(*keys, F.col("name").alias(f"_n{n}"))

    named = (
        paths.join(split, "l1")
        .join(level(1, ["l1"]), "l1", "left")
        .join(level(2, ["l1", "l2"]), ["l1", "l2"], "left")
        .join(level(3, ["l1", "l2", "l3"]), ["l1", "l2", "l3"], "left")
    )
    blank = F.lit("")
    shown = named.select(
        "l1", "l2", F.coalesce("l3", F.lit(-1)).alias("_l3"),
        F.coalesce("_n1", blank).alias(L1),
        F.when(F.col("_split"), F.coalesce("_n2", blank)).otherwise(blank).alias(L2),
        F.coalesce("_n3", blank).alias(L3),
    )
    rows = tree.withColumn("_l3", F.coalesce("l3", F.lit(-1))).join(cut(shown), ["l1", "l2", "_l3"])
    return with_paths(rows.drop("_l3"))


def cluster_sizes(assignments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per cluster: size, share of the total in percent, rank by size."""
    by = by or ["config_id"]
    sizes = cut(assignments.groupBy(*by, "cluster").agg(F.count("*").alias("size")))
    totals = sizes.groupBy(*by).agg(F.sum("size").alias("_all"))
    ranked = number_rows(sizes, [F.desc("size"), F.asc("cluster")], "size_rank", within=by)
    return ranked.join(totals, by).select(
        *by, "cluster", "size", F.round(F.col("size") * 100.0 / F.col("_all"), 1).alias("pct"), F.col("size_rank").cast("int").alias("size_rank"))


def cluster_distribution(assignments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per configuration: number of clusters, items, share of the largest cluster."""
    by = by or ["config_id"]
    sizes = assignments.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(
        F.count("*").alias("n_clusters"), F.sum("size").alias("n_items"),
        F.round(F.max("size") * 100.0 / F.sum("size"), 1).alias("max_cluster_pct"),
    )
