"""Ordered report tables: header rows, batches, palettes and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import text as tx
from coppice.operators.hierarchy import L1, L2, L3, node_ids, path_counts
from coppice.session import number_rows


def overview_rows(result: DataFrame) -> DataFrame:
    """``(row_no, row_kind, id, title, description)``: items under their level headers.

    Headers come from the tree-sized path table, so the item side is read once; a range sort on
    (natural id, kind, item) interleaves them.
    """
    headers = node_ids(path_counts(result)).select(
        F.concat(F.lit("header_"), F.col("level")).alias("row_kind"), F.col("level").alias("_kind"),
        F.col("node_id").alias("id"),
        F.concat(F.col("node_id"), F.lit("  "), F.coalesce(tx.blank_to_null(F.col(L3)), tx.blank_to_null(F.col(L2)), F.col(L1))).alias("title"),
        F.lit("").alias("description"), F.lit(-1).cast("long").alias("item_id"),
    )
    rows = result.select(
        F.lit("item").alias("row_kind"), F.lit(9).alias("_kind"), F.col("full_numeric_id").alias("id"),
        F.col("technology_name").alias("title"), F.col("Technology_Description").alias("description"), "item_id",
    )
    ordered = number_rows(headers.unionByName(rows), [tx.natural_key(F.col("id")), "_kind", "item_id"])
    return ordered.select("row_no", "row_kind", "id", "title", "description")


def leaf_palette(result: DataFrame) -> DataFrame:
    """Leaf to colour number, by first appearance in natural order."""
    leaves = result.groupBy("leaf_category").agg(F.min(tx.natural_key(F.col("full_numeric_id"))).alias("_key"))
    ranked = number_rows(leaves, ["_key", "leaf_category"], "_no")
    return ranked.select("leaf_category", ((F.col("_no") - 1) % cfg.PALETTE_SIZE).alias("colour"))


def batch_ids(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows, numbered from 0, with a position from 1 in the batch."""
    rows = number_rows(df, order, "_no")
    return (
        rows.withColumn("batch_id", F.floor((F.col("_no") - 1) / size))
        .withColumn("batch_pos", (F.col("_no") - 1) % size + 1)
        .drop("_no")
    )


def _first_members(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    # Catalyst turns "row_number <= n" into a per-partition group limit ahead of the shuffle.
    order = W.partitionBy(*keys).orderBy("item_id")
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)


def cluster_digest(members: DataFrame, keys: list[str], chars: int | None = cfg.JUDGE_CHARS, n: int = cfg.DIGEST_ITEMS) -> DataFrame:
    """The first ``n`` members of a group as ``- name: description`` lines (names only without ``chars``)."""
    line = F.concat(F.lit("- "), F.coalesce(F.col("technology_name"), F.lit("")))
    if chars:
        line = F.concat(line, F.lit(": "), F.substring(F.coalesce("Technology_Description", F.lit("")), 1, chars))
    heads = _first_members(members, keys, n).withColumn("_line", line)
    packed = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "_line"))).alias("_lines"))
    return packed.select(*keys, F.array_join(F.transform("_lines", lambda v: v["_line"]), "\n").alias("digest"))


def parent_digest(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Per parent node its children as ``- name: summary`` lines in child order; node-sized."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("summary", F.lit("")))
    packed = nodes.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct(F.col(child).alias("c"), line.alias("line")))).alias("_lines"))
    return packed.select(*parent, F.array_join(F.transform("_lines", lambda v: v["line"]), "\n").alias("digest"))


def naming_order(tree: DataFrame) -> DataFrame:
    """The bottom-up naming work list of a tree table.

    Phases: 1 third-level leaves, 2 second-level leaves, 3 second-level parents, 4 first level,
    largest first. ``source`` says whether a node is named from its items or from its children.
    """
    paths = tree.groupBy("l1", "l2", "l3").agg(F.count("*").alias("n"))
    threes = paths.filter(F.col("l3").isNotNull()).select(
        F.lit(1).alias("phase"), F.lit(3).alias("level"), "l1", "l2", "l3", "n", F.lit("items").alias("source"))
    pairs = paths.groupBy("l1", "l2").agg(F.sum("n").alias("n"), F.count("l3").alias("_kids"))
    twos = pairs.select(
        F.when(F.col("_kids") > 0, 3).otherwise(2).alias("phase"), F.lit(2).alias("level"), "l1", "l2",
        F.lit(None).cast("int").alias("l3"), "n",
        F.when(F.col("_kids") > 0, "children").otherwise("items").alias("source"))
    ones = pairs.groupBy("l1").agg(F.sum("n").alias("n"), F.count("*").alias("_kids")).select(
        F.lit(4).alias("phase"), F.lit(1).alias("level"), "l1", F.lit(None).cast("int").alias("l2"),
        F.lit(None).cast("int").alias("l3"), "n",
        F.when(F.col("_kids") > 1, "children").otherwise("items").alias("source"))
    work = threes.unionByName(twos).unionByName(ones)
    size_first = F.when(F.col("phase") == 4, -F.col("n")).otherwise(0)
    return number_rows(work, [size_first, "l1", "l2", "l3"], "position", within=["phase"])


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}-]+"), lambda w: w != "")


def guarded_words(parent_name: Column) -> Column:
    """The words of a parent's name that its children should not repeat: those of more than three letters."""
    return F.filter(_words(F.coalesce(parent_name, F.lit(""))), lambda w: F.length(w) > 3)


def name_guard_audit(names: DataFrame) -> DataFrame:
    """Check ``names(node_id, parent_id, name, parent_name)`` against the naming rules.

    Flags generic words, a name shared with a sibling, a word of more than three letters taken
    from the parent, and a name equal to the parent's.
    """
    words = _words
    blocked = F.array(*[F.lit(w.lower()) for w in cfg.GENERIC_WORDS])
    long_words = guarded_words(F.col("parent_name"))
    siblings = names.groupBy("parent_id", F.lower("name").alias("_name")).agg(F.count("*").alias("_same"))
    flagged = names.withColumn("_name", F.lower("name")).join(siblings, ["parent_id", "_name"], "left")
    return flagged.select(
        "node_id", "name",
        F.array_join(F.array_sort(F.array_intersect(words(F.col("name")), blocked)), " ").alias("generic_words"),
        (F.coalesce("_same", F.lit(1)) > 1).alias("shared_with_sibling"),
        F.array_join(F.array_sort(F.array_intersect(words(F.col("name")), long_words)), " ").alias("parent_words"),
        F.coalesce(F.col("_name") == F.lower("parent_name"), F.lit(False)).alias("equals_parent"),
    )
