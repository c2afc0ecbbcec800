"""Tag and vector metrics against brute force."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.functions import tags as tg
from coppice.operators import hierarchy as hi
from coppice.operators import scores as sc
from coppice.operators import tag_metrics as tm
from coppice.operators import vector_metrics as vm
from tests.conftest import table


def jaccard(sets):
    sets = [s for s in sets if s]
    if len(sets) < 2:
        return 0.0
    pairs = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    return sum(pairs) / len(pairs)


def tagged(spark, groups):
    rows = [(g, sorted(s)) for g, sets in enumerate(groups) for s in sets]
    return spark.createDataFrame(rows, "cluster int, tags array<string>")


def test_jaccard_small_and_large_sets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = [f"t{i}" for i in range(16)]
    groups = [[set(rng.choice(vocab, rng.integers(0, 15), replace=False)) for _ in range(60)] for _ in range(4)] + [[{"a"}], [set(), {"a", "b"}]]
    monkeypatch.setattr(tm, "TILE_SETS", 16)
    for limit in (4, 10, 16):
        monkeypatch.setattr(tm, "MAX_SUBSET_TAGS", min(limit, 10))
        got = table(tm.pairwise_jaccard(tagged(spark, groups), ["cluster"], "tags"), "cluster", "jaccard")
        for g, sets in enumerate(groups):
            assert got[g] == pytest.approx(jaccard(sets), abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sets(st.sampled_from("abcdef")), min_size=1, max_size=8), min_size=1, max_size=3))
def test_jaccard_is_exact_and_bounded(spark, groups):
    got = table(tm.pairwise_jaccard(tagged(spark, groups), ["cluster"], "tags"), "cluster", "jaccard")
    for g, sets in enumerate(groups):
        want = jaccard(sets)
        assert got.get(g, 0.0) == pytest.approx(want, abs=1e-12) and 0 <= want <= 1


def test_one_tag_held_by_everyone(spark):
    """A tag shared by a whole group costs one subset row, however many items carry it."""
    df = spark.range(4000).select(F.lit(0).alias("cluster"), F.array(F.lit("all"), F.concat(F.lit("x"), F.col("id") % 50)).alias("tags"))
    got = tm.pairwise_jaccard(df, ["cluster"], "tags").first()["jaccard"]
    same = 80 * 79 / 2 * 50 / (4000 * 3999 / 2)
    assert got == pytest.approx(same + (1 - same) / 3)


def test_coherence_counts_untagged_items(spark):
    df = tagged(spark, [[{"a"}, {"a", "b"}, set(), {"c"}], [set(), set()]])
    assert table(tm.concept_coherence(df, ["cluster"], "tags"), "cluster", "coherence") == {0: 0.5, 1: 0.0}


def test_tag_parsing(spark):
    rows = [(" ['a b', 'c, d']", "A, B; C;; A, B "), ("[]", "nan"), ("None", None), ("  ", " "), ('["x"]', ";")]
    got = spark.createDataFrame(rows, "l string, s string").select(tg.parse_list(F.col("l")).alias("l"), tg.parse_semicolon(F.col("s")).alias("s")).collect()
    assert got[0]["l"] == ["a b", "c", "d"] and got[0]["s"] == ["A, B", "C"]
    assert all(r["l"] == [] and r["s"] == [] for r in got[1:4]) and got[4]["l"] == ["x"] and got[4]["s"] == []


def silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_separation_metrics(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 5))
    labs = {"p": rng.integers(0, 4, 150), "q": np.minimum(rng.geometric(0.5, 150), 6), "r": np.arange(150) // 3}
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, features array<double>")
    asg = spark.createDataFrame([(i, c, int(v)) for c, lab in labs.items() for i, v in enumerate(lab)], "item_id long, config_id string, cluster int")
    for width in (4096, 7):  # the second cuts configurations into slices
        monkeypatch.setattr(vm, "CLUSTER_SLICE", width)
        got = table(vm.silhouette_exact(vec, asg, 64), "config_id", "silhouette")
        for c, lab in labs.items():
            assert got[c] == pytest.approx(silhouette(x, lab), abs=1e-9)
    ch, db = table(vm.calinski_harabasz(vec, asg), "config_id", "calinski_harabasz"), table(vm.davies_bouldin(vec, asg), "config_id", "davies_bouldin")
    for c, lab in labs.items():
        ids = sorted(set(lab))
        mu, cs = x.mean(0), np.array([x[lab == i].mean(0) for i in ids])
        n = np.array([(lab == i).sum() for i in ids])
        inside = sum(((x[lab == i] - m) ** 2).sum() for i, m in zip(ids, cs))
        between = (n * ((cs - mu) ** 2).sum(1)).sum()
        assert ch[c] == pytest.approx(between / (len(ids) - 1) / (inside / (150 - len(ids))), rel=1e-9)
        s = np.array([np.linalg.norm(x[lab == i] - m, axis=1).mean() for i, m in zip(ids, cs)])
        worst = [max((s[i] + s[j]) / np.linalg.norm(cs[i] - cs[j]) for j in range(len(ids)) if j != i) for i in range(len(ids))]
        assert db[c] == pytest.approx(np.mean(worst), rel=1e-9)


def test_undefined_clusterings(spark):
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "item_id long, features array<double>")
    asg = spark.createDataFrame([(i, c, k) for i in range(4) for c, k in (("one", 0), ("each", i), ("two", i % 2))], "item_id long, config_id string, cluster int")
    got = {r["config_id"]: r for r in vm.internal_metrics(vec, asg, 4).collect()}
    for c in ("one", "each"):
        assert (got[c]["silhouette"], got[c]["calinski_harabasz"], got[c]["davies_bouldin"]) == (-1.0, 0.0, 999.0)
    assert got["two"]["davies_bouldin"] < 999


def test_nearest_group_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r], i % 30) for i, r in enumerate(x)], "id long, vec array<double>, own long")
    groups = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "gid long, vec array<double>")
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    d[np.arange(40), np.arange(40) % 30] = np.inf
    for block in (4096, 8):
        monkeypatch.setattr(vm.bl, "GROUP_BLOCK", block)
        got = {r["id"]: r["gid"] for r in vm.bl.best_group(rows, groups, vm.bl.EUCLIDEAN).collect()}
        assert got == {i: int(d[i].argmin()) for i in range(40)}


def test_attempt_acceptance(spark):
    rows = [("a", 1, .3), ("a", 2, .45), ("a", 3, .6), ("b", 1, .1), ("b", 2, .3), ("b", 3, .3), ("b", 4, .9)]
    df = spark.createDataFrame(rows, "g string, final_rank int, quality double")
    assert {r["g"]: (r["final_rank"], r["accepted"]) for r in sc.accept_attempt(df, ["g"]).collect()} == {"a": (2, True), "b": (2, False)}


def test_grid_has_560_configurations(spark):
    models = spark.createDataFrame([("cohere",), ("titan",)], "model string")
    grid = sc.grid_configs(models)
    assert grid.count() == 560 and grid.select("config_id").distinct().count() == 560
    assert grid.filter("config_id = 'titan_v3_agg-complete-k7'").count() == 1
    sizes = spark.createDataFrame([(0, 200), (1, 201)], "scope int, n int")
    counts = table(sc.valid_configs(sizes, sc.sweep_rows(list(range(4, 13))), ["scope"]).groupBy("scope").count(), "scope", "count")
    assert counts == {0: 50, 1: 41}


def plain_fast(x, labels, measure):
    if measure == "cosine":
        size = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(size == 0, 1, size)
        d = 1 - u @ u.T
        d[np.arange(len(x)), np.arange(len(x))] = 1 - (u * u).sum(1)
    else:
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i, c in enumerate(labels):
        own = (labels == c).sum()
        a = d[i, labels == c].sum() / max(own - 1, 1)
        b = min(d[i, labels == o].mean() for o in set(labels.tolist()) - {c})
        out.append(0.0 if own == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("measure", ["squaredEuclidean", "cosine"])
@pytest.mark.parametrize("slice_", [4096, 5])
def test_fast_silhouette_of_many_labellings(spark, monkeypatch, measure, slice_):
    monkeypatch.setattr(vm, "CLUSTER_SLICE", slice_)
    monkeypatch.setattr(vm.bl, "TILE_ROWS", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(70, 4))
    x[5:8] = x[0]
    ks = {f"k{k}": r.integers(0, k, 70) for k in (2, 3, 4, 9, 60)} | {"part": np.r_[r.integers(0, 3, 40), np.full(30, -9)], "one": np.zeros(70, int)}
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, features array<double>")
    asg = spark.createDataFrame([(i, c, int(lab[i])) for c, lab in ks.items() for i in range(70) if lab[i] != -9], "item_id long, config_id string, cluster int")
    got = {r["config_id"]: r["silhouette"] for r in vm.silhouette_fast(vec, asg, measure).collect()}
    for c, lab in ks.items():
        want = -1.0 if c == "one" else plain_fast(x[lab != -9], lab[lab != -9], measure)
        assert got[c] == pytest.approx(want, abs=1e-9), c


def test_tag_overlap_of_large_sets(spark, monkeypatch):
    """Sets of up to 40 tags beside small ones, equal sets, two groups, several tiles."""
    monkeypatch.setattr(tm, "TILE_SETS", 7)
    r = np.random.default_rng(2)
    rows = []
    for i in range(60):
        size = int(r.integers(21, 41)) if i % 3 == 0 else int(r.integers(0, 13))
        rows.append((i % 2, [f"t{t}" for t in r.choice(60, size, replace=False)]))
    rows += [rows[0], rows[0], rows[3], rows[1]]
    got = {(r.g, r.shared): (r.n_pairs, r.jaccard_sum) for r in tm.overlap_histogram(spark.createDataFrame(rows, "g int, tags array<string>"), ["g"], "tags").collect()}
    want = {}
    for i, (g, a) in enumerate(rows):
        for h, b in rows[:i]:
            if g == h and (c := len(set(a) & set(b))):
                n, j = want.get((g, c), (0, 0.0))
                want[g, c] = (n + 1, j + c / len(set(a) | set(b)))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_cluster_sizes_of_many_clusters(spark):
    rows = [(f"c{i % 2}", int(x), i) for i, x in enumerate(np.random.default_rng(0).integers(0, 40, 300))]
    got = hi.cluster_sizes(spark.createDataFrame(rows, "config_id string, cluster int, item_id long")).collect()
    for c in ("c0", "c1"):
        sizes = {}
        for k, x, _ in rows:
            if k == c:
                sizes[x] = sizes.get(x, 0) + 1
        want = [(x, n, round(n * 100 / 150, 1), i + 1) for i, (x, n) in enumerate(sorted(sizes.items(), key=lambda v: (-v[1], v[0])))]
        assert sorted([(r.cluster, r["size"], r.pct, r.size_rank) for r in got if r.config_id == c], key=lambda v: v[3]) == want


@pytest.mark.parametrize("block, sums", [(7, 1), (16, 4096), (4096, 4096)])
def test_silhouette_values_send_few_sums(spark, monkeypatch, block, sums):
    """Blocks of any size and sums given away early, one-item clusters, a cluster a pair, rows without a label."""
    monkeypatch.setattr(vm, "BLOCK_ITEMS", block)
    monkeypatch.setattr(vm, "SUMS_HELD", sums)
    monkeypatch.setattr(vm, "FEW", 3)
    x = np.random.default_rng(8).normal(size=(60, 3))
    ways = {"alone": lambda i: i if i % 2 else -1, "pairs": lambda i: i // 2, "few": lambda i: i % 3, "some": lambda i: i % 4 if i < 40 else None, "one": lambda i: 0}
    asg = spark.createDataFrame([(i, c, f(i)) for c, f in ways.items() for i in range(60) if f(i) is not None], "item_id long, config_id string, cluster int")
    vec = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "item_id long, features array<double>")
    out = vm.silhouette_values(vec, asg, 5)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["config_id"], r["item_id"]): r for r in out.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for c, f in ways.items():
        lab = [f(i) for i in range(60)]
        for i in range(60):
            if lab[i] is None:
                assert (c, i) not in got
                continue
            to = {k: [d[i, j] for j in range(60) if j != i and lab[j] == k] for k in set(lab) - {None}}
            a = np.mean(to[lab[i]]) if to[lab[i]] else 0.0
            rest = [np.mean(v) for k, v in to.items() if k != lab[i]]
            r = got[c, i]
            assert r["a"] == pytest.approx(a, abs=1e-9)
            assert (r["b"] is None) if not rest else r["b"] == pytest.approx(min(rest), abs=1e-9)
            assert r["s"] == pytest.approx((min(rest) - a) / max(a, min(rest)) if rest and to[lab[i]] else 0.0, abs=1e-9)
