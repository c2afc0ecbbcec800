"""Clusterings against brute force on small fixtures, and their invariants."""

from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.operators import birch as bi
from coppice.operators import blocks as bl
from coppice.operators import centers as ce
from coppice.operators import density as de
from coppice.operators import linkage as lk
from coppice.operators import merge_tree as mt
from coppice.operators import spectral as sp
from coppice.operators import sweep
from tests.conftest import points


def partition(df, **only):
    pdf = df.toPandas()
    for k, v in only.items():
        pdf = pdf[pdf[k] == v]
    return {frozenset(g["id"]) for c, g in pdf.groupby("cluster") if c != de.NOISE}


def greedy(x, method, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]

    def distance(a, b):
        if method == "ward":
            gap = x[a].mean(0) - x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * gap @ gap
        d = cos[np.ix_(a, b)]
        return d.mean() if method == "average" else d.max()

    while len(groups) > k:
        _, i, j = min((distance(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
def test_linkage_equals_greedy_merging(spark, monkeypatch, method):
    monkeypatch.setattr(lk, "TAIL_GROUPS", 20)
    x = np.random.default_rng(11).normal(size=(60, 5))
    got = lk.agglomerative(points(spark, x), method, [2, 7])
    for k in (2, 7):
        assert partition(got, k=k) == greedy(x, method, k)


def merges(df):
    return {(r.scope, r.node, r.up, round(r.height, 9)) for r in df.collect()}


def test_complete_linkage_is_the_same_however_long_the_tail(spark, monkeypatch):
    """Tied data: whole-number points on few rays, equal points, two scopes; short lists that run out."""
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (90, 3)).astype(float)
    x[np.abs(x).sum(1) == 0] = 1.0
    df = points(spark, x).withColumn("scope", (F.col("id") % 5 == 0).cast("int"))
    want = merges(lk.dendrogram(df, "complete"))
    monkeypatch.setattr(lk, "TAIL_GROUPS", 2)
    monkeypatch.setattr(lk, "CANDIDATES", 5)
    monkeypatch.setattr(lk, "CHUNK", 4)
    monkeypatch.setattr(bl, "TILE_ROWS", 30)
    assert merges(lk.dendrogram(df, "complete")) == want and len(want) == 2 * (90 - 2)


@pytest.mark.parametrize("method", ["ward", "average"])
def test_summary_linkage_is_the_same_however_long_the_tail(spark, monkeypatch, method):
    x = np.random.default_rng(5).normal(size=(50, 3))
    x[20:25] = x[5:10]
    df = points(spark, x)
    want = merges(lk.dendrogram(df, method))
    monkeypatch.setattr(lk, "TAIL_GROUPS", 4)
    got = merges(lk.dendrogram(df, method))
    assert {m[:3] for m in got} == {m[:3] for m in want}


@pytest.mark.parametrize("method", ["ward", "average", "complete"])
def test_linkage_of_copies(spark, monkeypatch, method):
    """A third of the items are one point: they merge at once, and no round is spent on them."""
    r = np.random.default_rng(7)
    x = r.normal(size=(45, 4))
    x[3::3] = x[0]
    rounds = []
    pairs = lk._mutual_pairs
    monkeypatch.setattr(lk, "TAIL_GROUPS", 10)
    monkeypatch.setattr(lk, "_mutual_pairs", lambda near: rounds.append(1) or pairs(near))
    got = lk.agglomerative(points(spark, x), method, [2, 6])
    for k in (2, 6):
        assert partition(got, k=k) == greedy(x, method, k)
    assert len(rounds) < 10


@pytest.mark.parametrize("method", ["ward", "average"])
def test_long_tail_takes_the_least_merge_each_time(spark, monkeypatch, method):
    """Whole-number points, many equal costs, more groups than the rounds used to leave; no round is needed."""
    r = np.random.default_rng(9)
    x = r.integers(-3, 4, (700, 5)).astype(float)
    x[np.abs(x).sum(1) == 0] = 1.0
    monkeypatch.setattr(lk, "_mutual_pairs", lambda near: pytest.fail("a round"))
    got = lk.agglomerative(points(spark, x[:90]), method, [3, 9])
    assert [len(partition(got, k=k)) for k in (3, 9)] == [3, 9]
    y = r.normal(size=(700, 4))
    steps = lk.dendrogram(points(spark, y), method).toPandas()
    assert len(steps) == 2 * 699 and steps["up"].nunique() == 699
    monkeypatch.undo()
    few = lk.agglomerative(points(spark, y[:70]), method, [4])
    assert partition(few, k=4) == greedy(y[:70], method, 4)


@pytest.mark.parametrize("method", ["ward", "average"])
def test_rounds_in_plain_tiles_equal_the_tail(spark, monkeypatch, method):
    """Cells that rule nothing out are given up: later rounds meet all groups in one product, with equal merges."""
    x = np.random.default_rng(8).normal(size=(90, 24))
    df = points(spark, x)
    want = {m[:3] for m in merges(lk.dendrogram(df, method))}
    made = []
    cells = bl._cells
    monkeypatch.setattr(lk, "SUMMARY_TAIL", 40)
    monkeypatch.setattr(bl, "GROUP_BLOCK", 20)
    monkeypatch.setattr(bl, "CELL_GROUPS", 25)
    monkeypatch.setattr(bl, "TILE_ROWS", 30)
    monkeypatch.setattr(bl, "_cells", lambda *a: made.append(1) or cells(*a))
    assert {m[:3] for m in merges(lk.dendrogram(df, method))} == want
    assert len(made) == 1


@pytest.mark.parametrize("method", ["ward", "average"])
def test_rounds_of_few_groups_do_not_try_cells(spark, monkeypatch, method):
    """Two scopes, tied data; cells would have been made and given up or not, with equal merges."""
    x = np.random.default_rng(12).integers(-4, 5, (70, 6)).astype(float)
    x[np.abs(x).sum(1) == 0] = 1.0
    df = points(spark, x).withColumn("scope", (F.col("id") % 9 == 0).cast("int"))
    want = {m[:3] for m in merges(lk.dendrogram(df, method))}
    monkeypatch.setattr(lk, "SUMMARY_TAIL", 30)
    monkeypatch.setattr(bl, "GROUP_BLOCK", 20)
    monkeypatch.setattr(bl, "CELL_GROUPS", 10)
    monkeypatch.setattr(bl, "TILE_ROWS", 30)
    monkeypatch.setattr(bl, "_cells", lambda *a: pytest.fail("cells"))
    assert {m[:3] for m in merges(lk.dendrogram(df, method))} == want


@pytest.mark.parametrize("method", ["ward", "average"])
def test_rounds_of_a_task_take_the_same_merges(spark, monkeypatch, method):
    """Tied data, copies, two scopes: rounds on summaries inside the task merge what the task merges one by one."""
    x = np.random.default_rng(13).integers(-3, 4, (160, 4)).astype(float)
    x[np.abs(x).sum(1) == 0] = 1.0
    df = points(spark, x).withColumn("scope", (F.col("id") % 7 == 0).cast("int"))
    want = {m[:3] for m in merges(lk.dendrogram(df, method))}
    monkeypatch.setattr(lk, "SQUARE_TAIL", 6)
    assert {m[:3] for m in merges(lk.dendrogram(df, method))} == want and len(want) == 2 * (160 - 2)


@pytest.mark.parametrize("method", ["ward", "average"])
def test_rounds_of_a_task_look_again_only_where_needed(monkeypatch, method):
    """Many equal costs, weights, blocks of few rows and columns; every group against every group in each round gives the same."""
    monkeypatch.setattr(lk, "TAIL_ROWS", 7)
    monkeypatch.setattr(lk, "TAIL_COLUMNS", 13)
    r = np.random.default_rng(3)
    for case in range(6):
        x = np.unique(r.integers(-2, 3, (120, 3)).astype(float), axis=0) if case % 2 else r.normal(size=(120, 4))
        x = x[np.abs(x).sum(1) > 0]
        if method == "average":
            x = np.unique(np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 12), axis=0)
        size, names, n = r.integers(1, 4, len(x)).astype(float), np.arange(len(x)), len(x)
        got = lk._rounds(x.copy(), size.copy(), names.copy(), method, 2, n)[3]
        want, cost = [], lk.WARD if method == "ward" else lk.AVERAGE
        while len(x) > 2:
            d = cost.value(x, size[:, None], x, size[None, :])
            np.fill_diagonal(d, np.inf)
            i, at = np.arange(len(x)), d.argmin(1)
            a = i[(at[at] == i) & (i < at)]
            if not len(a):
                _, a, b = min((d[k, at[k]], min(k, at[k]), max(k, at[k])) for k in i)
                a, at[a] = np.array([a]), b
            b, up, both = at[a], names[a] + n, size[a] + size[at[a]]
            want += [(p, u) for part in (a, b) for p, u in zip(names[part], up)]
            x[a] = (x[a] * size[a][:, None] + x[b] * size[b][:, None]) / both[:, None]
            size[a], names[a] = both, up
            x, size, names = (np.delete(v, b, axis=0) for v in (x, size, names))
        assert [m[:2] for m in got] == want


def test_thousands_of_groups_need_no_round_of_jobs(spark, monkeypatch):
    monkeypatch.setattr(lk, "_mutual_pairs", lambda near: pytest.fail("a round"))
    x = np.random.default_rng(4).normal(size=(4300, 3))
    assert lk.dendrogram(points(spark, x), "ward").count() == 2 * 4299


def test_linkage_scopes_do_not_mix(spark):
    x = np.random.default_rng(3).normal(size=(40, 4))
    two = points(spark, x).withColumn("scope", (F.col("id") % 2).cast("int"))
    got = lk.agglomerative(two, "ward", [3])
    for s in (0, 1):
        want = greedy(x[s::2], "ward", 3)
        assert partition(got, scope=s) == {frozenset(2 * i + s for i in g) for g in want}


BLOBS = np.vstack([c + np.random.default_rng(1).normal(size=(40, 6)) * 0.3 for c in np.random.default_rng(4).normal(size=(4, 6)) * 5])
TRUE = {frozenset(range(i, i + 40)) for i in range(0, 160, 40)}


def test_centre_methods_find_blobs(spark):
    df = points(spark, BLOBS)
    assert partition(ce.kmeans_sweep(df, [4], 3)) == TRUE
    assert partition(ce.kmeans(df, 4, 3)) == TRUE
    assert partition(ce.gmm_sweep(df, [4], 2)) == TRUE
    assert partition(bi.birch(df, [4], 1.0)) == TRUE


def test_kmeans_is_a_fixed_point(spark):
    x = np.random.default_rng(8).normal(size=(200, 3))
    pdf = ce.kmeans_sweep(points(spark, x), [3, 5], 4).toPandas()
    for _, g in pdf.groupby("k"):
        lab = g.sort_values("id")["cluster"].to_numpy()
        means = np.array([x[lab == c].mean(0) for c in range(lab.max() + 1)])
        near = ((x[:, None] - means[None]) ** 2).sum(-1).argmin(1)
        assert (near == lab).mean() > 0.97


def mixture(x, centres, steps):
    """Expectation-maximisation from the nearest-centre labelling, with plain covariances."""
    k, d = centres.shape
    share = np.eye(k)[((x[:, None] - centres) ** 2).sum(-1).argmin(1)]
    for _ in range(steps):
        n = share.sum(0)
        means = share.T @ x / n[:, None]
        covs = [(share[:, c, None] * (x - means[c])).T @ (x - means[c]) / n[c] + ce.GMM_RIDGE * np.eye(d) for c in range(k)]
        logs = np.stack([np.log(n[c] / len(x)) - 0.5 * np.linalg.slogdet(covs[c])[1]
                         - 0.5 * np.einsum("ni,ij,nj->n", x - means[c], np.linalg.inv(covs[c]), x - means[c]) for c in range(k)], 1)
        share = np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    return logs.argmax(1)


def test_mixtures_equal_plain_maximisation_at_full_width(spark, monkeypatch):
    """Twelve correlated dimensions far from the origin, sums added two at a time, a turn for every k."""
    monkeypatch.setattr(ce, "TREE_FAN", 2)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(150, 12)) @ (rng.normal(size=(12, 12)) * 0.6) + rng.normal(size=12) * 1.5 for _ in range(3)]) + 1e4
    df = points(spark, x).repartition(7)
    starts = {m["k"]: m["centres"] for m in ce.kmeans_models(ce._scoped(df), [2, 3], 1)}
    got = ce.gmm_sweep(df, [2, 3], 1, iterations=6, turn_bytes=1).toPandas()
    for k, g in got.groupby("k"):
        assert list(g.sort_values("id")["cluster"]) == list(mixture(x, starts[k], 6))


def test_mixtures_report_convergence(spark):
    df = points(spark, BLOBS)
    assert set(ce.gmm_sweep(df, [4], 1).toPandas()["converged"]) == {True}
    assert set(ce.gmm_sweep(df, [4], 1, iterations=1).toPandas()["converged"]) == {False}
    assert ce.gmm_sweep(df.limit(0), [4], 1).count() == 0
    flat = points(spark, np.repeat(BLOBS[::40], 5, axis=0))  # four texts five times: covariances of rank zero
    assert len(partition(ce.gmm_sweep(flat, [2], 1))) == 2
    assert partition(ce.gmm(df, 4, 2, dims=2)) == TRUE


def test_spectral_finds_blobs(spark):
    assert partition(sp.spectral_sweep(points(spark, BLOBS), [4], gamma=0.1, starts=3)) == TRUE


@pytest.mark.parametrize("block", [512, 9])
def test_spectral_embedding_equals_the_leading_eigenvectors(spark, monkeypatch, block):
    """Scopes of 40, 25, 3 and 1 items beside each other, in one tile and in many, with restarts."""
    monkeypatch.setattr(sp, "BLOCK_ROWS", block)
    monkeypatch.setattr(sp, "BASIS_BLOCKS", 2)
    x = np.random.default_rng(5).normal(size=(69, 6))
    scope = np.repeat([0, 1, 2, 3], [40, 25, 3, 1])
    which = F.element_at(F.array(*[F.lit(int(v)) for v in scope]), (F.col("id") + 1).cast("int"))
    got = sp.embedding(points(spark, x).withColumn("scope", which), 4, gamma=0.05).toPandas().sort_values("id")
    assert got["residual"].max() <= sp.TOLERANCE and list(got["scope"]) == list(scope)
    for s, part in got.groupby("scope"):
        own = x[scope == s]
        a = np.exp(-0.05 * ((own[:, None] - own[None]) ** 2).sum(-1))
        root = np.sqrt(a.sum(1))
        values, vectors = np.linalg.eigh(a / root[:, None] / root[None, :])
        n = min(4, len(own))
        mine, want = np.stack(part["vec"]) * root[:, None], vectors[:, ::-1][:, :n]
        assert np.abs(mine[:, n:]).max(initial=0.0) == 0.0
        assert np.abs((mine[:, :n] * want).sum(0)) == pytest.approx(np.ones(n), abs=1e-6)


def test_spectral_says_when_the_tolerance_is_out_of_reach(spark):
    x = np.random.default_rng(5).normal(size=(60, 6))
    with pytest.raises(np.linalg.LinAlgError):
        sp.embedding(points(spark, x), 4, rounds=1)
    assert sp.embedding(points(spark, x).limit(0), 4).count() == 0


def test_spectral_writes_no_square_of_the_items(spark, monkeypatch):
    """The largest table of a run is the basis; the affinities of 1,500 items would be 9 MB."""
    x = np.random.default_rng(3).normal(size=(1500, 4))
    made, sizes = sp.cut, []

    def watched(df):
        out = made(df)
        sizes.append(sum(Path(unquote(urlparse(f).path)).stat().st_size for f in out.inputFiles()))
        return out

    monkeypatch.setattr(sp, "BLOCK_ROWS", 100)
    monkeypatch.setattr(sp, "cut", watched)
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda *a, **k: pytest.fail("a stored affinity"))
    got = sp.embedding(points(spark, x), 2, gamma=0.02).toPandas()
    assert len(got) == 1500 and got["residual"].max() <= sp.TOLERANCE
    assert max(sizes) < 1500 * 2 * sp.BASIS_BLOCKS * 12 * 8 < 1500**2 * 2


@pytest.mark.parametrize("small", [1 << 16, 10])
def test_density_clusters_and_noise(spark, monkeypatch, small):
    monkeypatch.setattr(mt, "UNIT_EDGES", small)
    x = np.vstack([BLOBS, np.random.default_rng(6).normal(size=(8, 6)) * 12])
    got = de.hdbscan(points(spark, x), [5, 10])
    for k in (5, 10):
        assert {g & frozenset(range(160)) for g in partition(got, k=k)} == TRUE
    folded = de.fold_noise(points(spark, x), got)
    assert folded.filter(F.col("cluster") < 0).count() == 0 and folded.count() == 2 * len(x)


def test_spanning_tree_weight(spark):
    x = np.random.default_rng(9).normal(size=(70, 4))
    rows = points(spark, x).withColumn("scope", F.lit(0))
    got = {r["j"]: (r["n"], r["w"]) for r in de.spanning_tree(rows, [3, 6]).groupBy("j").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for j, size in enumerate((3, 6)):
        core = np.sort(d, axis=1)[:, size - 1]
        m = np.maximum(np.maximum(d, core[:, None]), core[None])
        seen, best, total = np.zeros(70, bool), m[0].copy(), 0.0
        seen[0] = True
        for _ in range(69):
            best[seen] = np.inf
            v = best.argmin()
            total += best[v]
            seen[v] = True
            best = np.minimum(best, m[v])
        assert got[j][0] == 69 and got[j][1] == pytest.approx(total, abs=1e-6)


def test_few_items_look_again_for_their_edge(spark, monkeypatch):
    """Two scopes, one of them finished early and too small for a size: after two passes an item looks again only where its edge has come to lie inside."""
    looked, outside = [], de._outside
    monkeypatch.setattr(de, "_outside", lambda looking, state, n: looked.append(looking.count()) or outside(looking, state, n))
    x = np.random.default_rng(10).normal(size=(400, 6))
    rows = points(spark, x).withColumn("scope", (F.col("id") >= 397).cast("int"))
    got = {(r["scope"], r["j"]): r["n"] for r in de.spanning_tree(rows, [2, 4]).groupBy("scope", "j").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0): 396, (0, 1): 396, (1, 0): 2}
    assert looked[:2] == [400, 397] and sum(looked[2:]) < 300


def test_all_noise_is_left_out(spark):
    x = np.random.default_rng(0).normal(size=(12, 2))
    df = points(spark, x)
    noise = df.select("id", F.lit(0).alias("scope"), F.lit(5).alias("k"), F.lit(-1).alias("cluster"))
    assert de.fold_noise(df, noise).count() == 0


def test_three_items_are_one_group(spark):
    tags = ", ".join(f"array('a', 'b') AS {c}" for c in cfg.TAG_METRICS)
    few = spark.sql(f"SELECT id AS item_id, array(double(id), 1.0D) AS features, concat('n', id) AS technology_name, 'd' AS Technology_Description, {tags} FROM range(3)")
    labels, _, attempts = sweep.correction_loop(few, ks=[5], l2_ks=[2], min_sizes=[5])
    assert {(r.l1, r.l2) for r in labels.collect()} == {(0, 0)} and labels.count() == 3 and attempts.count() == 0


def plain_merge_tree(edges):
    """Children and parents as sets of items, one merge a distinct length."""
    group, born, out = {}, {}, set()
    for a, b, _ in edges:
        group[a], group[b] = frozenset([a]), frozenset([b])
    for w in sorted({w for *_, w in edges}):
        old = {x for a, b, v in edges if v == w for x in (group[a], group[b])}
        for a, b, v in edges:
            if v == w and group[a] != group[b]:
                both = group[a] | group[b]
                group.update(dict.fromkeys(both, both))
        out |= {(min(x), born.get(x), len(x), min(group[next(iter(x))]), w) for x in old}
        born.update({group[next(iter(x))]: w for x in old})
    return out


@pytest.mark.parametrize("limit", [3, 1 << 16])
def test_merge_tree_equals_plain_merging(spark, limit):
    r = np.random.default_rng(limit)
    rows, want = [], {}
    for scope, (n, lengths) in enumerate([(60, 1000), (40, 5), (25, 1), (2, 1)]):  # many ties, one length only, a single edge
        ids = r.permutation(n) + 100 * scope
        edges = [(int(ids[i]), int(ids[r.integers(0, i)]), float(r.integers(0, lengths))) for i in range(1, n)]
        rows += [(scope, *e) for e in edges]
        want[scope] = plain_merge_tree(edges)
    got = mt.merge_tree(spark.createDataFrame(rows, "scope int, a long, b long, w double"), ["scope"], limit).collect()
    for scope in want:
        assert {(g.child, g.child_w, g["size"], g.parent, g.parent_w) for g in got if g.scope == scope} == want[scope]
    assert len(got) == sum(map(len, want.values()))


def plain_hdbscan(x, size):
    """Components at every edge length, condensed from the top; the choice by excess of mass."""
    d = np.round(np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)), de.DIGITS)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, size - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(m, np.inf)

    def parts(nodes, below):
        left, out = set(nodes), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                v = todo.pop()
                seen.add(v)
                near = [u for u in left if m[v, u] < below]
                left -= set(near)
                todo += near
            out.append(frozenset(seen))
        return out

    def formed(nodes):
        """The least length at which the nodes hang together."""
        ids, tree = sorted(nodes), []
        best = {v: m[ids[0], v] for v in ids[1:]}
        while best:
            v = min(best, key=best.get)
            tree.append(best.pop(v))
            best = {u: min(w, m[v, u]) for u, w in best.items()}
        return max(tree)

    inv = lambda w: 1.0 / max(w, 1e-12)

    def condense(nodes, birth):
        """(clusters chosen at or below, their value) of a cluster that starts as these nodes."""
        here, mass, w_up = nodes, 0.0, birth
        while True:
            w = formed(here)
            mass += len(here) * (inv(w) - inv(w_up if w_up is not None else w))
            big = [p for p in parts(here, w) if len(p) >= size]
            if len(big) != 1:
                break
            here, w_up = big[0], w
        below = [condense(p, w) for p in big]
        value = sum(v for _, v in below)
        if birth is not None and mass >= value:
            return [nodes], mass
        return [c for cs, _ in below for c in cs], value if birth is not None else value

    return set(condense(frozenset(range(len(x))), None)[0])


@pytest.mark.parametrize("case,unit", [("uniform", 16), ("blobs", 1 << 16), ("grid", 16)])
def test_density_equals_plain_tree(spark, monkeypatch, case, unit):
    monkeypatch.setattr(mt, "UNIT_EDGES", unit)
    monkeypatch.setattr(de, "SMALL_TREE", unit // 16)
    monkeypatch.setattr(bl, "TILE_ROWS", 50)
    r = np.random.default_rng(5)
    x = {"uniform": r.uniform(size=(130, 2)), "blobs": np.vstack([BLOBS[::2], r.normal(size=(20, 6)) * 6]),
         "grid": np.round(r.normal(size=(120, 2)) * 3)}[case]  # repeated points and many equal distances
    got = de.hdbscan(points(spark, x), [3, 8])
    for k in (3, 8):
        assert partition(got, k=k) == plain_hdbscan(x, k)


def plain_features(x, ids, radius):
    """One feature after the other, members kept."""
    groups = []
    for i in ids:
        if groups:
            c = min(range(len(groups)), key=lambda g: ((x[groups[g]].mean(0) - x[i]) ** 2).sum())
            both = x[groups[c] + [i]]
            if ((both - both.mean(0)) ** 2).sum(1).mean() <= radius * radius:
                groups[c].append(i)
                continue
        groups.append([i])
    return {frozenset(g) for g in groups}


def test_birch_features_of_one_block(spark):
    x = np.random.default_rng(3).normal(size=(120, 3))
    found, feats = bi.features(points(spark, x), 0.6)
    assert partition(found.withColumnRenamed("feature", "cluster")) == plain_features(x, range(120), 0.6)
    assert {r.id for r in feats.collect()} == {min(g) for g in plain_features(x, range(120), 0.6)}


def test_birch_scope_is_the_same_alone(spark, monkeypatch):
    monkeypatch.setattr(bi, "BLOCK_ROWS", 16)
    x = np.random.default_rng(4).normal(size=(300, 3))
    both = points(spark, x).withColumn("scope", (F.col("id") % 3 == 0).cast("int"))
    found, feats = bi.features(both, 0.7)
    for s in (0, 1):
        alone = both.filter(F.col("scope") == s)
        one, _ = bi.features(alone.repartition(3), 0.7)
        assert {(r.id, r.feature) for r in one.collect()} == {(r.id, r.feature) for r in found.filter(F.col("scope") == s).collect()}
    member = {}
    for r in found.collect():
        member.setdefault((r.scope, r.feature), []).append(r.id)
    rows = {(r.scope, r.id): r for r in feats.collect()}
    assert set(rows) == set(member)
    for key, ids in member.items():  # united across blocks, within the radius, sums exact
        v = x[ids]
        assert rows[key].n == len(ids) and np.allclose(rows[key].total, v.sum(0)) and ((v - v.mean(0)) ** 2).sum(1).mean() <= 0.49 + 1e-9
    assert len(rows) < 120


def test_birch_grows_the_radius_of_a_full_list(spark, monkeypatch):
    monkeypatch.setattr(bi, "MAX_FEATURES", 10)
    x = np.random.default_rng(5).normal(size=(80, 2))
    found, feats = bi.features(points(spark, x), 0.01)
    assert feats.count() <= 10 and found.count() == 80


def test_starts_see_all_rows(spark):
    """One row in six hundred lies far away: a bounded draw would mostly miss it, oversampling does not."""
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(size=(1800, 2)), [[500.0, 0], [500, 1], [0, 700]]])
    x[1000:1700] = x[0]  # many copies
    df = points(spark, x).withColumn("scope", F.when(F.col("id") < 1795, F.col("id") % 2).otherwise(0).cast("int")).repartition(6)
    models, sizes = ce._starts(df, [3, 5], 4, lambda k: None)
    assert sizes == {0: 906, 1: 897} and len(models) == 2 * 2 * 4
    for m in models:
        assert m["centres"].shape == (m["k"], 2)
        if m["scope"] == 0:
            d = ((x[-3:, None] - m["centres"]) ** 2).sum(-1).min(1)
            assert (d < 10).all()
    again, _ = ce._starts(df.repartition(3), [3, 5], 4, lambda k: None)
    assert all(np.allclose(a["centres"], b["centres"]) for a, b in zip(models, again))


def test_starts_on_fewer_points_than_centres(spark):
    x = np.array([[0.0, 0], [0, 0], [0, 0], [1, 1], [1, 1]])
    assert partition(ce.kmeans_sweep(points(spark, x), [2], 2)) == {frozenset([0, 1, 2]), frozenset([3, 4])}
    assert ce.kmeans_sweep(points(spark, x), [4], 2).count() == 5


def test_sweep_joins_mixtures_and_gates_spectral(spark):
    rows = points(spark, BLOBS[::4]).select(F.col("id").alias("item_id"), F.col("vec").alias("features"))
    configs = [("gmm", None, 4), ("spectral", None, 4)]
    for most, want in ((None, {"gmm", "spectral"}), (39, {"gmm"})):
        got, failed = sweep.candidate_sweep(rows, configs, spectral_max=most, starts=1)
        assert failed == [] and {r["algo"] for r in got.select("algo").distinct().collect()} == want


def test_sweep_fits_spectral_whatever_the_size(spark):
    """A scope above and one below the 200 items that used to decide about spectral clustering."""
    x = np.vstack([BLOBS, BLOBS + 0.01])
    rows = points(spark, x).select(F.col("id").alias("item_id"), F.col("vec").alias("features"), (F.col("id") >= 240).cast("int").alias("scope"))
    got, failed = sweep.candidate_sweep(rows, [("kmeans", None, 2), ("spectral", None, 2)], starts=1)
    sizes = {(r["scope"], r["algo"]): r["count"] for r in got.groupBy("scope", "algo").count().collect()}
    assert failed == [] and sizes == {(s, a): n for s, n in ((0, 240), (1, 80)) for a in ("kmeans", "spectral")}


def _united_one_by_one(parts, radius, most):
    """Every part measured against every feature; the radius grows after a whole pass."""
    while True:
        n, total, squares, names, into = [], [], [], [], {}
        for name, k, t, sq in parts:
            c = int(((np.array([x / m for x, m in zip(total, n)]) - t / k) ** 2).sum(axis=1).argmin()) if n else -1
            if n:
                mean = (total[c] + t) / (n[c] + k)
                if max((squares[c] + sq) / (n[c] + k) - mean @ mean, 0.0) <= radius * radius:
                    n[c], total[c], squares[c], into[name] = n[c] + k, total[c] + t, squares[c] + sq, names[c]
                    continue
            n, total, squares, names, into[name] = [*n, k], [*total, t], [*squares, sq], [*names, name], name
        if len(n) <= most:
            return n, names, into, radius
        radius *= bi.GROWTH


def test_features_unite_without_measuring_all(monkeypatch):
    """Lists unite as if every part met every feature, but few features a part are measured one by one."""
    r = np.random.default_rng(7)
    take, measured = bi.Features._take, []
    monkeypatch.setattr(bi.Features, "_take", lambda self, part, v, near: measured.append(len(near)) or take(self, part, v, near))
    blobs = r.normal(size=(30, 6))[r.integers(0, 30, 700)] + 0.1 * r.normal(size=(700, 6))
    for x, radius, most in ((blobs, 0.3, 1 << 15), (r.integers(0, 5, (700, 3)).astype(float), 0.6, 1 << 15), (r.normal(size=(900, 16)), 0.5, 1 << 15), (r.normal(size=(600, 3)), 0.2, 90)):
        parts = [(i, 1.0, v, float(v @ v)) for i, v in enumerate(x)]
        got, into = bi.unite(parts, x.shape[1], radius, most)
        n, names, want, grown = _united_one_by_one(parts, radius, most)
        assert into == want and got.names == names and got.n[: got.m].tolist() == n and got.radius == grown
        assert np.mean(measured) <= bi.AT_ONCE
        measured.clear()
    parts = [(i, 1.0, v, float(v @ v)) for i, v in enumerate(10 * r.normal(size=(2000, 4)))]
    assert bi.Features(4, 0.1).absorb(parts, 50) is None and len(measured) <= 50 + bi.AT_ONCE
