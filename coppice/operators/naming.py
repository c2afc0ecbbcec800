"""Bottom-up naming of a finished tree by a caller's naming function or table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import text as tx
from coppice.operators.report import cluster_digest, guarded_words, name_guard_audit, naming_order, parent_digest
from coppice.session import cut, shared_dir

NODE = ["level", "l1", "l2", "l3"]
NameFn = Callable[[list[str]], list[str]]
RateFn = Callable[[list[str]], list[int]]


def call_in_batches(df: DataFrame, column: str, out: str, kind: str, fn: Callable, batch: int = cfg.EMBED_BATCH) -> DataFrame:
    """Add ``out`` by calling ``fn`` on up to ``batch`` values at a time, inside the tasks."""
    shared_dir(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, answers = pdf[column].tolist(), []
            for i in range(0, len(values), batch):
                answers += list(fn(values[i:i + batch]))
            yield pdf.assign(**{out: answers})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` {kind}"])
    return df.mapInPandas(run, schema)


def rate_clusters(members: DataFrame, fn: RateFn, keys: list[str]) -> DataFrame:
    """``(keys, score)`` from a judge that reads cluster digests; scores outside 1-5 are dropped."""
    digests = cluster_digest(members, keys, cfg.JUDGE_CHARS)
    rated = call_in_batches(digests, "digest", "score", "int", fn)
    return rated.filter(F.col("score").between(1, int(cfg.JUDGE_MAX))).select(*keys, "score")


def judge_with(fn: RateFn):
    """A judge for ``sweep.judged_shortlist`` out of a rating function."""
    return lambda members: rate_clusters(members, fn, ["ord", "cluster"])


def placeholder(prefix: str = "Cluster") -> Column:
    """The name of an unnamed node: its ids along the path."""
    return F.concat(F.lit(f"{prefix}_"), F.concat_ws(".", "l1", "l2", "l3"))


def name_tree(tree: DataFrame, items: DataFrame, fn: NameFn | None = None, names: DataFrame | None = None) -> DataFrame:
    """``(level, l1, l2, l3, name, summary)`` for every node.

    Leaves are named from their items, parents from the names and summaries of their children, the
    first level last. ``fn`` answers a list of digests with naming replies (JSON with
    ``cluster_name`` and ``summary``, or a bare name). A ``names`` table is taken as it is; without
    either, nodes keep a placeholder.
    """
    nodes = cut(naming_order(tree))
    if names is not None:
        got = nodes.select(*NODE).join(names.select(*[F.col(c).alias(f"_{c}") for c in NODE], "name", "summary"), _same_node(), "left")
        return got.select(*NODE, F.coalesce("name", F.lit(cfg.UNNAMED)).alias("name"), F.coalesce("summary", F.lit("")).alias("summary"))
    if fn is None:
        return nodes.select(*NODE, placeholder().alias("name"), F.lit("").alias("summary"))
    described = _described(tree, items)
    named = None
    for phase in (1, 2, 3, 4):
        out = cut(_ask(_digests(described, nodes.filter(F.col("phase") == phase), named, phase), fn))
        named = out if named is None else named.unionByName(out)
    return cut(named)


def _described(tree: DataFrame, items: DataFrame) -> DataFrame:
    return tree.join(items.select("item_id", "technology_name", "Technology_Description"), "item_id")


def _digests(described: DataFrame, work: DataFrame, named: DataFrame | None, phase: int) -> DataFrame:
    """``(node, digest)`` of the work list's nodes of one phase: their items, or their named children."""
    keys = {1: ["l1", "l2", "l3"], 2: ["l1", "l2"], 3: ["l1", "l2"], 4: ["l1"]}[phase]
    digests = cluster_digest(described.join(work.filter("source = 'items'").select(*keys), keys, "left_semi"), keys, cfg.NAMING_CHARS)
    if named is not None and phase > 2:
        level, child = (3, "l3") if phase == 3 else (2, "l2")
        below = parent_digest(named.filter(F.col("level") == level), keys, child)
        digests = digests.unionByName(below.join(work.filter("source = 'children'").select(*keys), keys, "left_semi"))
    return work.join(digests, keys).select(*NODE, "digest")


def _ask(digests: DataFrame, fn: NameFn) -> DataFrame:
    replies = call_in_batches(digests, "digest", "reply", "string", fn)
    reply = tx.named_reply(F.col("reply"))
    plain = ~tx.unfence(F.col("reply")).startswith("{")
    return replies.select(
        *NODE, F.when(plain, tx.clean_name(F.col("reply"))).otherwise(reply["cluster_name"]).alias("name"),
        F.when(plain, "").otherwise(reply["summary"]).alias("summary"))


def offenders(names: DataFrame) -> DataFrame:
    """``(node, context)`` of the nodes whose names break a rule, with what a better name needs to know.

    Of siblings that share a name the first keeps it. The context names the parent, the names that other
    children of it have, and the words to avoid.
    """
    node = names.withColumn("node_id", F.concat_ws(".", "l1", "l2", "l3"))
    pairs = cut(named_pairs(names))
    broken = name_guard_audit(pairs).drop("name").join(pairs, "node_id")
    first = pairs.groupBy("parent_id", F.lower("name").alias("_name")).agg(F.min("node_id").alias("_first"), F.count("*").alias("_same"))
    others = pairs.groupBy("parent_id").agg(F.array_sort(F.collect_set("name")).alias("_all"))
    again = F.col("shared_with_sibling") & (F.col("node_id") != F.col("_first"))
    bad = broken.withColumn("_name", F.lower("name")).join(first, ["parent_id", "_name"]).join(others, "parent_id").filter(
        (F.col("generic_words") != "") | (F.col("parent_words") != "") | F.col("equals_parent") | again)
    taken = F.array_join(F.filter("_all", lambda n: (F.lower(n) != F.col("_name")) | (F.col("_same") > 1)), "; ")
    avoid = F.array_union(F.array(*[F.lit(w) for w in cfg.GENERIC_WORDS]), guarded_words(F.col("parent_name")))
    parent = F.when(F.coalesce("parent_name", F.lit("")) != "", F.concat(F.lit("Parent group: "), F.col("parent_name")))
    context = F.concat_ws("\n", parent, F.when(taken != "", F.concat(F.lit("Names already taken: "), taken)), F.concat(F.lit("Words to avoid: "), F.array_join(avoid, ", ")))
    return node.join(bad.select("node_id", context.alias("context")), "node_id").select(*NODE, "context")


def repair_names(tree: DataFrame, items: DataFrame, names: DataFrame, fn: NameFn | None = None, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Names after at most ``rounds`` of asking offending nodes again, and the audit of what is left.

    Only offending nodes are asked, each with its digest under the context of :func:`offenders`; a reply
    without a name changes nothing. Without ``fn`` the names stay and are audited.
    """
    names = cut(names.select(*NODE, "name", "summary"))
    work = cut(naming_order(tree))
    for _ in range(rounds if fn is not None else 0):
        bad = cut(offenders(names))
        if not bad.take(1):
            break
        held = cut(work.join(bad.select(*[F.col(c).alias(f"_{c}") for c in NODE], "context"), _same_node()).drop(*[f"_{c}" for c in NODE]))
        asked = None
        for phase in (1, 2, 3, 4):
            digests = _digests(_described(tree, items), held.filter(F.col("phase") == phase), names, phase)
            asked = digests if asked is None else asked.unionByName(digests)
        told = asked.join(bad.select(*[F.col(c).alias(f"_{c}") for c in NODE], "context"), _same_node())
        told = told.select(*NODE, F.concat_ws("\n\n", "context", "digest").alias("digest"))
        new = cut(_ask(told, fn)).select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("name").alias("_name"), F.col("summary").alias("_summary"))
        better = F.col("_name").isNotNull() & (F.trim("_name") != "") & (F.col("_name") != cfg.UNNAMED)
        summary = F.when(better & (F.coalesce("_summary", F.lit("")) != ""), F.col("_summary")).otherwise(F.col("summary"))
        names = cut(names.join(new, _same_node(), "left").select(*NODE, F.when(better, F.col("_name")).otherwise(F.col("name")).alias("name"), summary.alias("summary")))
    return names, cut(name_guard_audit(named_pairs(names)))


def _same_node() -> Column:
    hit = F.col("level") == F.col("_level")
    for c in NODE[1:]:
        hit = hit & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return hit


def named_pairs(names: DataFrame) -> DataFrame:
    """``(node_id, parent_id, name, parent_name)`` of all nodes, as the naming audit wants them."""
    node = names.withColumn("node_id", F.concat_ws(".", "l1", "l2", "l3"))
    up = F.when(F.col("level") == 1, "").when(F.col("level") == 2, F.concat_ws(".", "l1")).otherwise(F.concat_ws(".", "l1", "l2"))
    parents = node.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return node.withColumn("parent_id", up).select("node_id", "parent_id", "name").join(parents, "parent_id", "left")
