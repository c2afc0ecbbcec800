"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are one record from the start, so
copies cost nothing. Each record has SIGNATURE minwise values and a sketch of one bit of each.

In every tree a record walks down from the root: a node picks one or two of the minwise positions
(1 / similarity on average, never none), and the record goes on to the child that its value there
names. Two records of similarity J stay together on each pick with probability J, so similar ones
meet again and again, others part. The number of independent trees follows from the recall wanted
at the threshold (MISS). Nodes with few records (SMALL) compare all of theirs. In a larger node
every record is first compared with one pivot; what is then in the pivot's component needs no more
comparison inside it, so only the others meet the node's records, if they are few. Otherwise the node's
records belong to a family, with those of all crowded nodes that share a record. A family of more than one block
and at most WHOLE of them is compared all with all, block against block, since that sends fewer rows than walking on; its
tasks take exact intersections as matrix products. In other families the node
branches further, at most to DEEPEST; records that are still together there are compared in the same way, however many:
no limit drops a pair. Branching further parts similar records too, so the
records of such nodes walk down further trees from the root, as many as DEEPEST levels need for the
same recall (``deep_trees``).

Sketches settle most comparisons (a pair at the threshold passes but once in a million); below the first look
records carry a map of their set's hashes too, which bounds the intersection, so that a crowd of sets just below the threshold
makes few pairs and no link is lost. Every link is confirmed on the full sets. Only components matter, so a pair that already is in one component is
not compared again, and no list of pairs of a group is made.

Defined cases: null and empty texts have no shingle and no link; a text with fewer words than a
shingle is one shingle; rows with equal texts are copies, whatever their ids; a null id links like
any other, and the smallest id of a component is the smallest that is not null; an empty table gives
no row; a single very common shingle is one value among many and gathers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import discard, keyed, lower_words, mix64, ready, settle, slices, utf8
from coppice.llm.components import components

SIGNATURE = 128
START = 3  # levels before the first look at the nodes
STEP = 3  # levels between looks
DEEPEST = 9
#: Records of a family that a task compares with as many others.
BLOCK = 512
#: Blocks of a family that is compared whole instead of walking on, and the shingles that one of its records may send for that.
WHOLE = 16
SENT = 8192
#: Shingles, columns of a matrix, that are counted at a time.
COLUMNS = 4096
#: Shingles, about, of either side of such a count.
HELD = 1 << 20
SMALL = 16
MISS = 1e-6
#: Bits of the map of a set's hashes that records carry below the first look.
MAP = 1024
#: Sketch bits in which a pair at the threshold may differ, in standard deviations above the mean.
SPREAD = 4.9

_R = np.random.default_rng(12_345)
_MULTIPLY = _R.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def shingles(text: str | bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; the whole sequence if there are fewer words."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = min(n, len(words))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - m + 1 + k])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """Minwise values of a set: for every position the least hash, 32 bits."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(items), 4096):
        h = (items[None, lo : lo + 4096] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)
        out = np.minimum(out, h.min(axis=1).astype(np.uint32))
    return out


def sketch(sig: np.ndarray) -> tuple[int, int]:
    """One bit of each minwise value, as two signed 64-bit integers."""
    bits = np.packbits((mix64(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8))
    return tuple(np.frombuffer(bits.tobytes(), "<i8").tolist())


def bit_map(items: np.ndarray) -> list[int]:
    """Which of MAP buckets the hashes of a set fall in, as signed 64-bit integers."""
    bits = np.zeros(MAP, np.uint8)
    bits[(items % np.uint64(MAP)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8").tolist()


def _possible(x: Column, m: Column, y: Column, n: Column, parts: int, of: int) -> Column:
    """False only for sets that cannot be linked: a bucket that one set alone uses holds an item that the other lacks."""
    alone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda k, c: k + c)
    both = F.least(m - alone(x, y), n - alone(y, x))
    return of * both >= parts * (m + n - both)


def recall(similarity: float, share: float, levels: int) -> float:
    """The chance that a pair of that similarity is still together ``levels`` below the root."""
    two, r = 1 / share - 1, 1.0
    for _ in range(levels):
        p = similarity * r
        r = (1 - two) * p + two * (1 - (1 - p) ** 2)
    return r


def trees_for(threshold: float, miss: float = MISS) -> int:
    return int(np.ceil(np.log(miss) / np.log(1 - recall(threshold, threshold, START + 1))))


def missed(similarity: float, share: float, levels: int, trees: int) -> float:
    """The chance that a pair is in no common node of any tree ``levels`` down; all trees share one signature, so averaged over its equal values."""
    out = 0.0
    for same in range(SIGNATURE + 1):
        out += math.comb(SIGNATURE, same) * similarity**same * (1 - similarity) ** (SIGNATURE - same) * (1 - recall(same / SIGNATURE, share, levels)) ** trees
    return out


def deep_trees(threshold: float, miss: float | None = None) -> int:
    """The trees that records of crowded nodes need, so that pairs at the threshold are missed as seldom at DEEPEST as MISS."""
    goal, trees = MISS if miss is None else miss, trees_for(threshold)
    while missed(threshold, threshold, DEEPEST, trees) > goal:
        trees += 1
    return trees


def extend(node: np.ndarray, row: np.ndarray, sig: np.ndarray, threshold: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes for the records that are in them, some levels down."""
    two = np.uint64(int((1 / threshold - 1) * 2**63) * 2)
    for _ in range(levels):
        u = mix64(node ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        again = np.flatnonzero(mix64(u) < two)
        first = u % np.uint64(SIGNATURE)
        step = np.uint64(1) + mix64(u[again] + np.uint64(1)) % np.uint64(SIGNATURE - 1)
        at = np.concatenate([first, (first[again] + step) % np.uint64(SIGNATURE)]).astype(np.int64)
        node, row = np.concatenate([node, node[again]]), np.concatenate([row, row[again]])
        node = mix64(mix64(node + (at.astype(np.uint64) << np.uint64(40))) ^ sig[row, at].astype(np.uint64))
    return node, row


def roots(trees: range) -> np.ndarray:
    return mix64(np.arange(trees.start + 1, trees.stop + 1, dtype=np.uint64))


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, record (the set's hash; null without words), n_shingles, sig, s1, s2, bits for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in utf8(b.column(1)):
                s = shingles(t, n)
                if len(s):
                    sig = signature(s)
                    rows.append((np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64).item(), len(s), sig.tobytes(), *sketch(sig), bit_map(s)))
                else:
                    rows.append((None, 0, None, None, None, None))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "record", "n_shingles", "sig", "s1", "s2", "bits"])

    return docs.mapInArrow(run, "doc_id long, record long, n_shingles long, sig binary, s1 long, s2 long, bits array<long>")


def _walk(records: DataFrame, threshold: float, trees: range | None, levels: int) -> DataFrame:
    """record, s1, s2 at its nodes: from the roots of ``trees``, or from those in its list ``node``.

    Below the first look also n_shingles and bits; few records go there.
    """
    more = ["n_shingles", "bits"] if levels > START or trees is None else []
    carried = ["record", "s1", "s2", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096 if trees is not None else 256):
                b = big.slice(lo, 4096 if trees is not None else 256)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, SIGNATURE)
                row = np.arange(b.num_rows)
                if trees is None:
                    row = np.repeat(row, b.column("node").value_lengths().to_numpy())
                    node = b.column("node").flatten().to_numpy().astype(np.int64).view(np.uint64)
                else:
                    node = np.repeat(roots(trees), b.num_rows)
                    row = np.tile(row, len(trees))
                node, row = extend(node, row, sig, threshold, levels)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[b.column(c).take(at) for c in carried]], names=["node", *carried])

    names = ["record", "sig", "s1", "s2", *more] + ([] if trees is not None else ["node"])
    return records.select(*names).mapInArrow(run, "node long, record long, s1 long, s2 long" + ", n_shingles long, bits array<long>" * bool(more)).distinct()


class Links:
    """Confirmed links, growing; and the components they make."""

    def __init__(self, docs: DataFrame, described: DataFrame, n: int, parts: int, of: int):
        self.docs, self.n, self.parts, self.of = docs, n, parts, of
        self.where = settle(described.filter("record is not null").groupBy("record").agg(F.min("doc_id").alias("doc_id")))
        self.texts: DataFrame | None = None
        self.component: DataFrame | None = None

    def of_record(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """Add the component of a record; its own number without links."""
        if self.component is None:
            return df.withColumn(name, F.col(col))
        c = self.component.select(F.col("node").alias(col), F.col("component").alias(name))
        return df.join(c, col, "left").withColumn(name, F.coalesce(name, col))

    def fetch(self, members: DataFrame) -> None:
        """The texts of all records that share a node, once; every later comparison is among them."""
        ids = members.select("record").distinct().join(self.where, "record")
        self.texts = settle(self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"])).select("record", "text"))

    def sets(self, needed: DataFrame) -> DataFrame:
        """record, items (sorted hashes) for a table of records, from the whole texts."""
        n = self.n

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                s = [shingles(t, n) for t in utf8(b.column(1))]
                names = [np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64).item() for x in s]
                keep = [i for i, (x, y) in enumerate(zip(names, b.column(0).to_pylist())) if x == y]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.int64()), pa.array([s[i].tobytes() for i in keep], pa.binary())], names=["record", "items"])

        texts = self.texts.join(needed.select("record").distinct(), "record").select("record", "text")
        return settle(texts.mapInArrow(read, "record long, items binary").dropDuplicates(["record"]))

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of candidate pairs a, b and keep the links."""
        pairs = settle(pairs.select("a", "b").distinct())
        if not pairs.limit(1).count():
            return
        parts, of = self.parts, self.of

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), parts, of) for x, y in zip(b.column(2), b.column(3))]
                yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        read = self.sets(pairs.select(F.col("a").alias("record")).union(pairs.select("b")))
        left, right = read.select(F.col("record").alias("a"), F.col("items").alias("x")), read.select(F.col("record").alias("b"), F.col("items").alias("y"))
        self.add(settle(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")))
        discard(read, pairs)

    def add(self, found: DataFrame) -> None:
        if not found.limit(1).count():
            return
        old = self.component
        before = old.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b") if old is not None else None
        self.component = components(found if before is None else before.unionByName(found))
        discard(found, old)

    def compare_families(self, members: DataFrame) -> None:
        """Records that share nodes which do not part them (record, pivot): all of a family, block against block."""
        self.compare_whole(family := family_of(members))
        discard(family)

    def compare_whole(self, family: DataFrame) -> None:
        """Families (node: a record, component: its family), all of each, block against block.

        A task holds two blocks of at most about BLOCK records and gives back only links that join
        two components, so a family of any size is compared whole without a list of its pairs.
        """
        blocks = settle(family.groupBy("component").agg(_blocks().alias("blocks")))
        placed = family.join(blocks, "component").select(F.col("node").alias("record"), F.col("component").alias("family"), "blocks")
        placed = self.of_record(placed.withColumn("block", F.pmod(F.xxhash64("record"), F.col("blocks"))), "record", "c")
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        placed = placed.select("record", "family", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        parts, of = self.parts, self.of

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(block_links(pdf["record"].tolist(), pdf["items"].tolist(), pdf["c"].tolist(), pdf["block"].to_numpy(), parts, of), columns=["a", "b"], dtype="int64")

        read = self.sets(family.select(F.col("node").alias("record")))
        self.add(settle(placed.join(read, "record").groupBy("family", "lo", "hi").applyInPandas(meet, "a long, b long")))
        discard(read, blocks)

    def clear(self) -> None:
        """Delete the tables behind the links."""
        discard(self.where, self.texts, self.component)


def similar(x: np.ndarray, y: np.ndarray, parts: int, of: int) -> bool:
    """of * intersection >= parts * union, on sorted sets."""
    if of * min(len(x), len(y)) < parts * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= parts * (len(x) + len(y) - both)


def _blocks() -> Column:
    return F.floor((F.count("*") - 1) / BLOCK) + 1


def family_of(members: DataFrame) -> DataFrame:
    """Rows of record and pivot to node (a record) and component (its family)."""
    return components(members.select(F.col("record").alias("a"), F.col("pivot").alias("b")))


def shared_sizes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every set of ``x`` with every one of ``y``."""
    flat = [np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (x, y)]
    row = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)))
    at = [np.searchsorted(common, z) for z in flat]
    known = [np.flatnonzero(common[np.minimum(a, len(common) - 1)] == z) if len(common) else np.zeros(0, np.int64) for a, z in zip(at, flat)]
    at, row = [a[k] for a, k in zip(at, known)], [r[k] for r, k in zip(row, known)]
    for lo in range(0, len(common), COLUMNS):
        both = []
        for a, r, z in zip(at, row, (x, y)):
            use = (a >= lo) & (a < lo + COLUMNS)
            m = np.zeros((len(z), min(COLUMNS, len(common) - lo)), np.float32)
            m[r[use], a[use] - lo] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out.astype(np.int64)


def _pieces(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows cut where their sets get long; a block of short ones stays whole."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // HELD)) + 1)


def block_links(names: list[int], items: list[bytes], known: list[int], block: np.ndarray, parts: int, of: int) -> list[tuple[int, int]]:
    """Links that join components, among the records of one block or between two."""
    sets, c = [np.frombuffer(x, np.uint64) for x in items], np.asarray(known, np.int64)
    two = block.min() != block.max()
    left, right = (np.flatnonzero(block == b) for b in ((block.min(), block.max())))
    size = np.array([len(x) for x in sets], np.int64)
    root = {k: k for k in known}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i in _pieces(left, size):
        for j in _pieces(right, size):
            both = shared_sizes([sets[k] for k in i], [sets[k] for k in j])
            ok = (of * both >= parts * (size[i][:, None] + size[j][None, :] - both)) & (c[i][:, None] != c[j][None, :])
            if not two:
                ok &= i[:, None] < j[None, :]
            for p, q in np.argwhere(ok).tolist():
                p, q = int(i[p]), int(j[q])
                a, b = find(known[p]), find(known[q])
                if a != b:
                    root[b] = a
                    out.append((names[p], names[q]))
    return out


def _far(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def link_components(docs: DataFrame, words: int = 3, parts: int = 85, of: int = 100) -> DataFrame:
    """Rows of doc_id and text to doc_id, record, n_shingles, component (of records); one row per input row.

    Sets with ``of * intersection >= parts * union`` are linked.
    """
    ready(docs.sparkSession)
    threshold = parts / of
    differ = SIGNATURE * (1 - threshold) / 2
    most = int(np.ceil(differ + SPREAD * np.sqrt(differ * (1 + threshold) / 2)))
    signed = settle(_described(docs, words))
    records = settle(signed.filter("record is not null").dropDuplicates(["record"]).select("record", "sig", "s1", "s2", "n_shingles", "bits"))
    described = settle(signed.select("doc_id", "record", "n_shingles"))
    discard(signed)
    links = Links(docs, described, words, parts, of)
    act, depth = settle(_walk(records, threshold, range(trees_for(threshold)), START)), START
    while True:
        more = ["n_shingles", "bits"] if depth > START else []
        rank = F.struct(F.xxhash64("record").alias("r"), "record", "s1", "s2", *more)
        nodes = act.groupBy("node").agg(F.count("*").alias("n"), F.min(rank).alias("p")).filter("n > 1")
        members = settle(act.join(nodes, "node").select("node", "record", "s1", "s2", *more, *[F.col(f"p.{c}").alias(f"p_{c}") for c in more], "n", F.col("p.record").alias("pivot"), F.col("p.r").alias("r"), F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2")))
        discard(act)
        if depth == START:
            links.fetch(members)
        star = members.filter(F.col("record") != F.col("pivot")).filter(_far(F.col("s1"), F.col("s2"), F.col("p1"), F.col("p2")) <= most)
        if more:
            star = star.dropDuplicates(["record", "pivot"]).filter(_possible(F.col("bits"), F.col("n_shingles"), F.col("p_bits"), F.col("p_n_shingles"), parts, of))
        star = settle(star.select("record", "pivot", "r").distinct())
        one = star.groupBy("record").agg(F.min(F.struct("r", "pivot"))["pivot"].alias("b")).select(F.col("record").alias("a"), "b")
        if depth == START:  # one pivot for each record first: that alone joins most groups of near copies
            links.confirm(one)
        pairs = star.select(F.col("record").alias("a"), F.col("pivot").alias("b"))
        placed = settle(links.of_record(links.of_record(members.select("node", "record", "s1", "s2", *more, "n", "pivot"), "record", "c"), "pivot", "pc"))
        discard(members)
        others = placed.groupBy("node").agg(F.sum((F.col("c") != F.col("pc")).cast("long")).alias("others"))
        few = others.filter(f"others > 0 and others <= {SMALL}")
        # the records outside the pivot's component meet all records of other components in the node
        out = placed.filter("c <> pc").join(few, "node").select("node", F.col("record").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), *[F.col(c).alias(f"a_{c}") for c in more], F.col("c").alias("ca"))
        met = out.join(placed.select("node", F.col("record").alias("b"), "s1", "s2", *more, F.col("c").alias("cb")), "node")
        met = met.filter((F.col("ca") != F.col("cb")) & (_far(F.col("a1"), F.col("a2"), F.col("s1"), F.col("s2")) <= most))
        if more:
            met = met.filter(_possible(F.col("a_bits"), F.col("a_n_shingles"), F.col("bits"), F.col("n_shingles"), parts, of))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(met).distinct()
        left = links.of_record(links.of_record(left, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
        if depth == START:
            left = left.join(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        links.confirm(left)
        discard(star)
        many = settle(others.filter(f"others > {SMALL}").select("node"))
        deeper, last = many.limit(1).count() > 0, depth >= DEEPEST
        if deeper and last:
            links.compare_families(placed.select("node", "record", "pivot").join(many, "node"))
        elif deeper:
            crowded = settle(placed.select("node", "record", "pivot").join(many, "node"))
            family = family_of(crowded)
            sizes = family.join(records.select(F.col("record").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("n"), _blocks().alias("blocks"), F.sum("n_shingles").alias("held"))
            whole = settle(sizes.filter((F.col("n") > BLOCK) & (F.col("blocks") <= WHOLE) & (F.col("blocks") * F.col("held") <= SENT * F.col("n"))).select("component"))
            if whole.limit(1).count():
                whole_families = settle(family.join(whole, "component").select("node", "component"))
                links.compare_whole(whole_families)
                rest = settle(crowded.join(whole_families.select(F.col("node").alias("record")), "record", "left_anti").select("node", "record", "pivot"))
                discard(crowded, whole_families)
                crowded = rest
            discard(family, whole)
            if not crowded.limit(1).count():
                discard(crowded, placed, many)
                break
            # one row a record, with its nodes, so that a signature is neither joined nor sent once a node
            nodes = crowded.groupBy("record").agg(F.collect_set("node").alias("node"))
            act = _walk(nodes.join(records, "record"), threshold, None, STEP)
            if depth == START:  # pairs that met in crowded nodes only get the trees that the deeper levels need
                again = crowded.select("record").distinct().join(records, "record")
                act = act.unionByName(_walk(again, threshold, range(trees_for(threshold), deep_trees(threshold)), START + STEP))
            act = settle(act)
            depth += STEP
            discard(crowded)
        discard(placed, many)
        if last or not deeper:
            break
    out = settle(links.of_record(described, "record", "component"))
    links.clear()
    discard(described, records)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, parts: int = 85, of: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that), for every row."""
    rows = link_components(keyed(docs, id_col, text_col), words, parts, of)
    least = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "component", "left")
    named = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"))
