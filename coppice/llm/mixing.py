"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the sources in code point order (null last) get the weights in turn and share a multiple of
all words by weight; no target exceeds ``most`` times its source, and what is over goes to the others
by weight until none is above. That is one level for all: sources sorted by their limit over their
weight fill up one after the other, so running sums give it without rounds.

Quotas: every source is cut into BLOCKS blocks by a hash of its documents. A source gives all its
blocks as often as its target holds it whole; the rest of the target is filled with further blocks in
a permuted order, each that still fits, and the end with single documents of the next block, largest
first. A block with more than UNITS documents is cut into blocks again first. Documents are always
taken whole.

Shards: the quotas of all sources, counted in block copies, are split in two again and again: the
left half gets half of the copies, and each source's part of it is drawn from the hypergeometric
distribution given what the sources before it drew. Each source's copies, in permuted order, are then
dealt to the leaves by their quotas: the blocks of different shards are disjoint, and the sums are
exact. Inside a shard the order is that of a hash.

All of it is DataFrame functions. Windows and arrays hold BLOCKS rows of a source, never documents.

Defined cases: a null or empty text has size 0 and moves with its block; a null source is a source,
the last; repeated rows stay together in a block and are taken alike; an empty table gives no row; a
source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Blocks of each source, and of a block that is cut again.
BLOCKS = 512
#: Documents of a block that single choices are made from, at most.
UNITS = 1024
DEPTH = 4  # 2**DEPTH output shards
SEED = 20_231
WORD = "[^\\x20\\x09-\\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size to rank, weight, target. One row per source."""
    everything = Window.partitionBy()
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    limit, total = F.col("source_size") * F.lit(most), F.sum("source_size").over(everything) * F.lit(share)
    by_limit = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = named.withColumn("_level", level)
    final = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * F.lit(most), F.struct(F.col("source_size") * F.lit(most) / F.col("weight"), F.col("rank"), "_level"))).over(everything)
    return levels.withColumn("target", F.coalesce(F.least(F.col("source_size") * F.lit(most), final["_level"] * F.col("weight")), F.col("source_size") * F.lit(most))).drop("_level")


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``total`` are among the ``good``: the quantile of ``u``.

    The probabilities are walked through by their ratios, over all values within 12 standard
    deviations, which leaves out less than double precision can hold.
    """
    n, k, d = (x.cast("double") for x in (total, good, drawn))
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    wide = 12 * F.sqrt(F.when(n > 1, F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / (n - 1))).otherwise(0.0)) + 2
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - wide).cast("double")).cast("long")
    high = F.least(k, d, F.ceil(mean + wide).cast("double")).cast("long")
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))
    ratio = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
    one = F.lit(1.0)
    whole = F.aggregate(steps, F.struct(one.alias("w"), one.alias("c")), lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["c"] + s["w"] * ratio(x)).alias("c")), lambda s: s["c"])
    return F.aggregate(
        steps, F.struct(one.alias("w"), one.alias("c"), low.alias("x"), (u * whole).alias("until")),
        lambda s, x: F.when(s["c"] >= s["until"], s).otherwise(F.struct((s["w"] * ratio(x)).alias("w"), (s["c"] + s["w"] * ratio(x)).alias("c"), (x + 1).alias("x"), s["until"].alias("until"))),
        lambda s: s["x"],
    )


def splitting_tree(quotas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """rank, copies (a row per source) to shard, rank, n: exact shares of every quota."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("copies").cast("long").alias("n")))).alias("q")).select(F.lit(0).cast("long").alias("shard"), "q")
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        split = node.withColumn("t", total).withColumns({"h": F.floor((F.col("t") + 1) / 2).cast("long"), "level": F.lit(level)})
        start = F.struct(F.col("t").alias("left"), F.col("h").alias("room"), F.array().cast("array<struct<rank:int,n:bigint>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            got = hypergeometric(s["left"], x["n"], s["room"], _uniform(F.col("shard"), x["rank"], F.col("level")))
            put = F.array(F.struct(x["rank"].alias("rank"), got.alias("n")))
            return F.struct((s["left"] - x["n"]).alias("left"), (s["room"] - got).alias("room"), F.concat(s["out"], put).alias("out"))

        half = split.withColumn("a", F.aggregate("q", start, step, lambda s: s["out"]))
        rest = F.zip_with("q", "a", lambda x, y: F.struct(x["rank"].alias("rank"), (x["n"] - y["n"]).alias("n")))
        both = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("a").alias("q")), F.struct((2 * F.col("shard") + 1).alias("shard"), rest.alias("q")))
        node = settle(half.select(F.explode(both).alias("x")).select("x.shard", "x.q"))
    return node.select("shard", F.explode("q").alias("x")).select("shard", "x.rank", "x.n")


def _greedy(items: Column, rest: Column) -> Column:
    """From structs (order, size, key) in order: those that still fit, and what is left to fill."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        items, F.struct(rest.cast("double").alias("rest"), empty.alias("keys")),
        lambda s, x: F.when(x["size"] <= s["rest"] + F.lit(0.5), F.struct((s["rest"] - x["size"]).alias("rest"), F.concat(s["keys"], F.array(x["key"])).alias("keys"))).otherwise(s),
    )


class Mix:
    """The plan of a mix: which rows are taken how often, and where their copies go."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, depth: int = DEPTH):
        self.docs, text = docs, F.col(f"`{text_col}`").cast("string")
        self.key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), text, F.lit(SEED))
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(text).alias("size"), self.key.alias("key"))
        self.rows = settle(rows)  # no texts from here on
        self.sources = settle(targets(self.rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
        full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0)
        plan = self.sources.withColumn("full", full.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")))
        self.placed = self._place(self.rows)
        self._fill(plan)
        self._deal(plan, depth)

    def _place(self, rows: DataFrame) -> DataFrame:
        """Add rank, source_size, target and block to rows with source and key."""
        s = self.sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
        block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(BLOCKS)).cast("long")
        return rows.join(s, rows["source"].eqNullSafe(s["_source"])).drop("_source").withColumn("block", block)

    def _fill(self, plan: DataFrame) -> None:
        """Whole blocks that fit the rest of each target, then documents of the next block."""
        taken, picked, level = [], [], 0
        rest = plan.select("rank", "rest")
        within = self.placed.select("rank", "block", "key", "size")
        while True:
            sizes = settle(within.groupBy("rank", "block").agg(F.sum("size").alias("size"), F.countDistinct("key").alias("units")))
            order = F.struct(F.xxhash64("block", F.lit(SEED + level)).alias("order"), "size", F.col("block").alias("key"), "units")
            lists = sizes.groupBy("rank").agg(F.array_sort(F.collect_list(order)).alias("items")).join(rest, "rank")
            got = settle(lists.withColumn("got", _greedy(F.col("items"), F.col("rest"))))
            chosen = got.select("rank", F.explode("got.keys").alias("block"))
            if level == 0:
                self.whole = settle(chosen)
            else:  # blocks of a block: their documents are chosen one by one
                taken.append(within.join(chosen, ["rank", "block"], "left_semi").select("rank", "key"))
            left = F.filter("items", lambda x: ~F.array_contains(F.col("got.keys"), x["key"]) & (x["size"] > 0))
            nxt = got.select("rank", F.col("got.rest").alias("rest"), F.element_at(left, F.when(F.size(left) > 0, 1)).alias("b"))
            nxt = settle(nxt.filter("b is not null and rest >= 1").select("rank", "rest", F.col("b.key").alias("block"), F.col("b.units").alias("units")))
            if level == 0:
                self.partial = nxt.select("rank", "block")
            inside = settle(within.join(nxt.select("rank", "block"), ["rank", "block"], "left_semi").select("rank", "key", "size"))
            if not nxt.filter(F.col("units") > UNITS).limit(1).count():
                units = inside.groupBy("rank", "key").agg(F.sum("size").alias("size"))
                listed = units.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "size", "key"))).alias("items")).join(nxt.select("rank", "rest"), "rank")
                picked.append(listed.select("rank", F.explode(_greedy(F.col("items"), F.col("rest"))["keys"]).alias("key")))
                break
            level += 1
            within = inside.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1 + level)), F.lit(BLOCKS)).cast("long"))
            rest = nxt.select("rank", "rest")
        out = picked[0]
        for more in taken:
            out = out.unionByName(more)
        self.picked = settle(out.distinct().withColumn("picked", F.lit(True)))

    def _deal(self, plan: DataFrame, depth: int) -> None:
        """Copies of blocks, each with its shard."""
        blocks = self.placed.select("rank", "block").distinct().join(plan.select("rank", "full"), "rank")
        marked = blocks.join(self.whole.withColumn("extra", F.lit(1)), ["rank", "block"], "left").join(self.partial.withColumn("part", F.lit(True)), ["rank", "block"], "left")
        times = marked.withColumn("n", F.col("full") + F.coalesce("extra", F.lit(0)))
        self.times = settle(times.select("rank", "block", "n", F.coalesce("part", F.lit(False)).alias("part")))
        copies = self.times.select("rank", "block", "part", "n", F.explode(F.sequence(F.lit(1), F.col("n") + F.col("part").cast("int") + F.lit(1))).alias("copy"))
        copies = copies.filter(F.col("copy") <= F.col("n") + F.col("part").cast("int")).withColumn("partial", F.col("copy") > F.col("n"))
        spot = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64("block", "copy", F.lit(SEED)), "block", "copy"))
        copies = settle(copies.withColumn("spot", spot))
        tree = splitting_tree(copies.groupBy("rank").agg(F.count("*").alias("copies")), depth)
        ends = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        ranges = tree.withColumn("end", F.sum("n").over(ends)).filter("n > 0")
        spots = ranges.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("spot"))
        self.copies = settle(copies.join(spots, ["rank", "spot"]).select("rank", "block", "copy", "partial", "shard"))

    def digest(self) -> DataFrame:
        """doc_id, size, source_size, target, taken and the shards of its copies, for every row.

        ``taken`` counts the copies that the splitting tree dealt out; a block has at most ``most`` + 1 of them.
        """
        dealt = self.copies.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "copy", "partial"))).alias("dealt"))
        rows = self.placed.join(dealt, ["rank", "block"], "left").join(self.picked, ["rank", "key"], "left")
        mine = F.filter(F.coalesce("dealt", F.array()), lambda x: ~x["partial"] | F.coalesce("picked", F.lit(False)))
        shards = F.transform(mine, lambda x: x["shard"].cast("int"))
        return rows.withColumn("shards", shards).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")

    def rows_with_copies(self, text_col: str = "text", source_col: str = "source") -> DataFrame:
        """The input's columns, one row per copy, with _shard and _order (the place inside the shard)."""
        names = self.docs.columns
        docs = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{source_col}`").cast("string").alias("source"), self.key.alias("key"))
        rows = self._place(docs).join(self.copies, ["rank", "block"]).join(self.picked, ["rank", "key"], "left").filter(~F.col("partial") | F.col("picked"))
        return rows.select("_doc.*", F.col("shard").alias("_shard"), F.xxhash64("key", "copy", F.lit(SEED)).alias("_order"))


def write_shards(mix: Mix, path: str) -> None:
    """Shuffle locally and write a folder per shard."""
    mix.rows_with_copies().repartition("_shard", F.pmod("_order", F.lit(16))).sortWithinPartitions("_shard", "_order").write.partitionBy("_shard").parquet(path)
