"""From described items to a named, numbered tree and its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions.text import compose_text
from coppice.operators import hierarchy as hi
from coppice.operators import naming, repair, sweep
from coppice.operators.report import overview_rows
from coppice.operators.tag_metrics import tag_columns
from coppice.session import cut, number_rows
from coppice.sources.embeddings import EmbedFn, embed_items
from coppice.sources.items import require_columns
from coppice.sources.sinks import write_tables


@dataclass
class TreeTables:
    result: DataFrame
    summary: DataFrame
    names: DataFrame
    tree: DataFrame
    shortlist: DataFrame
    attempts: DataFrame
    audit: DataFrame | None = None  # the names checked against the naming rules

    def overview(self) -> DataFrame:
        return overview_rows(self.result)

    def write(self, path: str, fmt: str = "parquet") -> dict[str, str]:
        """The item table, the summary in natural order and the overview."""
        ordered = hi.natural_order(self.summary, "id")
        return write_tables({"items": self.result, "summary": ordered, "overview": self.overview()}, path, fmt)


def prepared(items: DataFrame, features: DataFrame | None = None, embed_fn: EmbedFn | None = None) -> DataFrame:
    """Items with their tag arrays and vectors, written once: every later step reads this table."""
    require_columns(items, cfg.ITEM_COLUMNS)
    if features is None:
        features = embed_items(items.select("item_id", compose_text().alias("text")), embed_fn).select("item_id", "features")
    tagged = tag_columns(items, ["item_id", "technology_name", "Technology_Description"])
    return cut(tagged.join(features.select("item_id", "features"), "item_id"))


def split_third(items: DataFrame, labels: DataFrame, ks: list[int] | None = None, min_sizes: list[int] | None = None, **kw) -> DataFrame:
    """``tree(item_id, l1, l2, l3)``: every second-level group, unsplit first-level ones too, tried once more."""
    keys = number_rows(labels.select("l1", "l2").distinct(), ["l1", "l2"], "group")
    grouped = cut(items.join(labels.join(keys, ["l1", "l2"]).select("item_id", "group"), "item_id"))
    third = sweep.split_groups(grouped, "group", ks or cfg.L3_KS, cfg.L3_MIN_SCORE, min_sizes, **kw)
    return cut(labels.join(third.withColumnRenamed("cluster", "l3"), "item_id"))


def build_tree(items: DataFrame, features: DataFrame | None = None, embed_fn: EmbedFn | None = None, judge: sweep.Judge | None = None,
               name_fn: naming.NameFn | None = None, names: DataFrame | None = None, ks: list[int] | None = None,
               l2_ks: list[int] | None = None, l3_ks: list[int] | None = None, min_sizes: list[int] | None = None,
               consolidate: bool = False, naming_rounds: int = 2, **kw) -> TreeTables:
    """Cluster, judge, recurse, repair, name and number.

    ``items`` has ``item_id`` and the six item columns; ``features(item_id, features)`` replaces
    embedding. The ranges can be narrowed; ``starts`` is passed on to the fits. Names that break a naming rule
    are asked for again, ``naming_rounds`` times at most; ``audit`` tells which still do.
    """
    ready = prepared(items, features, embed_fn)
    vectors = ready.select("item_id", "features")
    labels, shortlist, attempts = sweep.correction_loop(ready, judge, ks, l2_ks, min_sizes, **kw)
    if consolidate:
        labels, _ = repair.consolidate_l1(labels.withColumn("l3", F.lit(None).cast("int")), vectors)
        labels = cut(labels.drop("l3"))
    tree = split_third(ready, labels, l3_ks, min_sizes, **kw)
    tree, _ = repair.reassign_orphans(tree, vectors)
    tree = repair.merge_small_leaves(tree, vectors)
    node_names = naming.name_tree(tree, ready, name_fn, names)
    node_names, audit = naming.repair_names(tree, ready, node_names, name_fn if names is None else None, naming_rounds)
    tables = result_tables(items, tree, node_names, shortlist, attempts)
    tables.audit = audit
    return tables


def result_tables(items: DataFrame, tree: DataFrame, names: DataFrame, shortlist: DataFrame, attempts: DataFrame) -> TreeTables:
    levels = hi.attach_names(tree, names)
    result = cut(hi.assign_ids(items.join(levels, "item_id")))
    paths = hi.attach_names(tree.select("l1", "l2", "l3").distinct().withColumn("item_id", F.lit(0)), names)
    summary = hi.taxonomy_summary(result, _path_summaries(paths, names))
    return TreeTables(result.drop(*hi.PATH), summary, names, tree, shortlist, attempts)


def _path_summaries(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``(l1, l2, l3, category_level_1..3, summary)`` of every node, by its path."""
    blank = F.lit("")
    l1, l2, l3 = cfg.LEVELS
    per = {
        1: (["l1"], paths.select("l1", F.col(l1), blank.alias(l2), blank.alias(l3))),
        2: (["l1", "l2"], paths.filter(F.col(l2) != "").select("l1", "l2", F.col(l1), F.col(l2), blank.alias(l3))),
        3: (["l1", "l2", "l3"], paths.filter("l3 is not null").select("l1", "l2", "l3", F.col(l1), F.col(l2), F.col(l3))),
    }
    out = None
    for level, (keys, nodes) in per.items():
        notes = names.filter(F.col("level") == level).select(*keys, "summary")
        numbers = [F.col(p) if p in keys else F.lit(None).cast("int").alias(p) for p in hi.PATH]
        rows = nodes.distinct().join(notes, keys).select(*numbers, *cfg.LEVELS, "summary")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*hi.PATH, *cfg.LEVELS).agg(F.min("summary").alias("summary"))
