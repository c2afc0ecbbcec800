"""Each operator against a plain version on small tables with hard rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import (
    binary_output, components, cross_polytope, lm, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, va_file,
)
from coppice.llm.common import fold_of, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, size long, spans string"


def hard_docs(spark, seed=0, n=60):
    """Near and exact copies, shared passages, null, empty and long texts, repeated rows, clashing column names."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdeé"), r.integers(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary, k))
    passage, rows = text(60), []
    for i in range(n):
        t = text(int(r.integers(1, 120)))
        if i % 5 == 1:
            t = rows[-1][1]
        elif i % 5 == 2 and rows[-2][1]:
            w = rows[-2][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif i % 7 == 3:
            t = text(10) + " " + passage + " " + text(10)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, text(6000)), (n + 6, "x" * 400), (n + 7, rows[0][1])]
    rows += [rows[3], rows[3]]
    full = [(i, t, None, None if i % 9 == 4 else f"s{i % 4}", None, "r", 1.5, 7, "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def brute_components(rows, n, parts, of):
    sets = {i: {tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)} if (w := words(t)) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and of * len(sets[a] & sets[b]) >= parts * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,parts", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, parts):
    docs, rows = hard_docs(spark)
    got = near_dedup.near_duplicates(docs, n, parts, 100).collect()
    want = brute_components(rows, n, parts, 100)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1]) for r in got)


def test_families_in_blocks_equal_brute_force(spark, monkeypatch):
    """Records that never part: everything goes through the block comparison."""
    r = np.random.default_rng(1)
    base, rows = [f"w{k}" for k in range(80)], []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, 80, 5):
            w[k] = f"z{r.integers(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "DEEPEST", near_dedup.START)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70, 100).collect()
    want = brute_components(rows, 3, 70, 100)
    assert len({c for _, c in want.values()}) < 60
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_pairs_of_crowded_nodes_meet_at_the_deepest_level():
    """Default constants: 20,000 pairs at the threshold, walked to DEEPEST in the trees that crowded records get."""
    r, n = np.random.default_rng(3), 20_000
    one = r.integers(0, 1 << 32, (n, near_dedup.SIGNATURE), dtype=np.uint32)
    two = np.where(r.random(one.shape) < 0.85, one, r.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    apart = np.ones(n, bool)
    for root in near_dedup.roots(range(near_dedup.deep_trees(0.85))):
        left = np.flatnonzero(apart)
        k = len(left)
        node, row = near_dedup.extend(np.full(2 * k, root), np.arange(2 * k), np.vstack([one[left], two[left]]), 0.85, near_dedup.DEEPEST)
        a, b = row < k, row >= k
        key = lambda use: np.unique(near_dedup.mix64(node[use]) ^ near_dedup.mix64((row[use] % k + 1).astype(np.uint64)), return_index=True)
        (x, i), (y, _) = key(a), key(b)
        apart[left[np.unique(row[a][i[np.isin(x, y)]])]] = False
        if not apart.any():
            break
    assert apart.sum() == 0
    assert near_dedup.missed(0.85, 0.85, near_dedup.DEEPEST, near_dedup.deep_trees(0.85)) <= near_dedup.MISS


def test_families_in_crowded_nodes(spark, monkeypatch):
    """One template in all texts, each linked to one other: nodes keep more than SMALL outsiders, default constants."""
    r = np.random.default_rng(4)
    base, rows = [f"w{k}" for k in range(400)], []
    for i in range(40):
        w = list(base)
        for k in r.choice(60, 15, replace=False):
            w[k * 6 + 3] = f"z{i}x{k}"
        other = list(w)
        for k in r.choice(60, 8, replace=False):
            other[k * 6 + 3] = f"y{i}x{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    walk, walked = near_dedup._walk, []
    monkeypatch.setattr(near_dedup, "_walk", lambda df, threshold, trees, levels: walked.append(trees) or walk(df, threshold, trees, levels))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    want = brute_components(rows, 3, 85, 100)
    assert range(near_dedup.trees_for(0.85), near_dedup.deep_trees(0.85)) in walked
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_components_both_ways(spark):
    r = np.random.default_rng(2)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(30)], "a long, b long")
    want = sorted(components.components(links).collect())
    assert sorted(components.components(links, 0).collect()) == want
    assert sorted(components.components(links.repartition(9), 40).collect()) == want
    dense = links.unionByName(spark.createDataFrame([(5000 + i, 5000 + j) for i in range(40) for j in range(i)], "a long, b long")).repartition(9)
    assert sorted(components.components(dense, 120).collect()) == sorted(components.components(dense, 0).collect())


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(dict.fromkeys(rows), key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        keep = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(keep).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [8192, 1])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    docs, rows = hard_docs(spark)
    got, want = suffix_dedup.digests(docs).collect(), brute_repeats(rows)
    assert len(got) == len(rows)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows) and left.filter("text is null").count() == 1


def test_longest_previous_factor():
    r = np.random.default_rng(3)
    text = r.integers(97, 99, 300).astype(np.uint8)
    order = r.permutation(300)
    got = suffix_dedup.longest_previous(text, np.arange(300), order, 20)
    raw = bytes(text) + bytes(40)
    for i in range(280):
        best = 0
        for j in range(300):
            if order[j] < order[i]:
                k = 0
                while k < 20 and raw[i + k] == raw[j + k]:
                    k += 1
                best = max(best, k)
        assert min(got[i], 20) == best


def test_binary_output_round_trip(spark):
    from tokenizers import Tokenizer

    docs, rows = hard_docs(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = binary_output.read_shards(binary_output.write_shards(docs, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    texts, at = dict(rows), 0
    for r in got:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids) // 4, ids)
        at += r.n_tokens


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks(n):
    x = (np.random.default_rng(n).zipf(1.3, n) % 2**32).astype("<u4")
    assert (binary_output.decode_blocks(binary_output.encode_blocks(x), n) == x).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    docs, rows = hard_docs(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(packing.token_pieces(docs, path, capacity=512), capacity=512).collect()
    texts, total = dict(rows), 0
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 512 * r.piece and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        total += r.length
    assert total == sum(len(ids[i]) for i, _ in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-total // 512) + 1


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    start = np.arange(10)
    got = packing.local_search(sizes, start, 10)
    assert len(set(got)) <= 5 and np.bincount(got, sizes).max() <= 10


def test_mixing(spark):
    docs, rows = hard_docs(spark)
    docs, rows = docs.filter("doc_id <> 65"), [r for r in rows if r[0] != 65]  # one text of 6000 words is no part of any target
    mix = mixing.Mix(docs)
    got = mix.digest().collect()
    assert len(got) == len(rows) and sorted(got) == sorted(mixing.Mix(docs).digest().collect())
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert all(r["size"] == len(words(dict(rows)[r.doc_id])) for r in got)
    source = {i: (None if i % 9 == 4 else f"s{i % 4}") for i, _ in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, free, room = {}, set(names), 1.5 * sum(sizes.values())
    while True:  # share, cap, share again
        level = room / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            room -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in names)
    assert all(abs(taken[s] - want[s]) <= 60 for s in names)
    copies = mix.rows_with_copies()
    assert copies.count() == sum(r.taken // r["size"] for r in got if r["size"]) + copies.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count()
    assert set(docs.columns) <= set(copies.columns)
    assert all(r.taken == r["size"] * len(r.shards) for r in got)
    placed = Counter((r.doc_id, r._shard) for r in copies.select("doc_id", "_shard").collect())
    assert placed == Counter((r.doc_id, s) for r in got for s in r.shards) and len({s for _, s in placed}) > 8


def test_mixing_handles_hard_rows(spark):
    """Null ids, texts and sources, a row forty times, one very long text and clashing columns."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(i, text[: 20 + i], "a", 1) for i in range(60)] + [(7, text, "b", 2)] * 40 + [(None, text, None, 3), (101, None, "a", 4), (102, "", None, 5), (103, "x " * 50_000, "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    mix = mixing.Mix(docs)
    got = mix.digest().collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * len(r.shards) for r in got)
    assert len({r.taken for r in got if r.doc_id == 7 and r["size"] == 30}) == 1  # repeated rows are taken alike
    copies = mix.rows_with_copies()
    assert [c for c in copies.columns if not c.startswith("_")] == docs.columns and copies.count() == sum(len(r.shards) for r in got)


def test_hypergeometric(spark):
    rows = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 4000).alias("x"))
    got = np.array([r.x for r in rows.collect()])
    want = np.sort(np.random.default_rng(0).hypergeometric(20, 30, 10, 400_000))[50::100]
    assert abs(got.mean() - 4) < 0.01 and (np.sort(got) != want).mean() < 0.02


def test_language_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "Unseenword")], "doc_id long, text string"))
    got = {r.doc_id: r for r in lm.score(docs, frequent=500, vocabulary=200).collect()}
    texts = {r.doc_id: [*words(r.text), b"\n"] for r in docs.collect()}
    counts = {}
    for i, w in texts.items():
        if fold_of(i, 10):
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in counts for x in w), n, fold_of(i, 10) == 0)
        assert abs(r.base_score - sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6


def test_model_is_normalised():
    uni = np.random.default_rng(0).dirichlet(np.ones(30))
    model = lm.start_model(uni)
    scorer = lm.Scorer(lm.train(model, np.random.default_rng(1).choice(30, 5000, p=uni), np.array([5000]), uni, 0))
    for u, v in ((1, 1), (5, 9), (0, 29)):
        s = scorer.bias + scorer.first[u] + scorer.second[v] - scorer.log_z[u, v]
        assert abs(np.exp(s).sum() - 1) < 1e-4


def vectors(spark, n=300, d=16):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (n, d))
    x[40:60] = x[0]
    rows = [(i, [float(v) for v in row], "v") for i, row in enumerate(x)] + [(1000, None, "v"), (1001, [float("nan")] * d, "v"), (1002, [None] * d, "v"), (1003, [1.0], "v"), (1004, [0.0] * d, "v"), (0, [float(v) for v in x[0]], "v")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), np.vstack([x, np.zeros((1, d))]), [*range(n), 1004]


@pytest.mark.parametrize("big", [1e17, 1e8])
def test_va_file_refuses_what_does_not_fit(spark, big):
    """One component without an exact integer; products beyond 64 bits."""
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(20)] + [(20, [big, -big])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError|may not fit"):
        va_file.search(df, F.col("vec_id") % 10 == 0, 3).count()


def test_va_file_is_exact(spark):
    df, x, ids = vectors(spark)
    ints = np.floor(256 * x).astype(np.int64)
    got = {}
    for r in va_file.search(df, F.col("vec_id") % 10 == 0, 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = [i for i in ids if i % 10 == 0]
    assert sorted(got) == asked
    for q in asked:
        s = ints @ ints[ids.index(q)]
        best = sorted((-int(s[k]), i) for k, i in enumerate(ids) if i != q)[:7]
        assert got[q] == {k + 1: (i, -v) for k, (v, i) in enumerate(best)}


def test_cross_polytope_recall(spark):
    df, x, ids = vectors(spark, 600, 32)
    x, ids = x[:-1], ids[:-1]
    got = {}
    for r in cross_polytope.search(df, F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 10 == 0]
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        best = {i for _, i in sorted((-s[i], i) for i in ids if i != q)[:10]}
        hits += len(best & {v for _, v, _ in found})
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
    assert hits / (10 * len(got)) >= 0.9


def found_and_best(spark, x, k, every, **settings):
    """The search's ids of each query, and those of brute force with ties to the smaller id."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q: [] for q in range(0, len(x), every)}
    for r in cross_polytope.search(df, F.col("vec_id") % every == 0, k, **settings).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    best = {}
    for q in got:
        s = x @ x[q]
        best[q] = [i for _, i in sorted((-s[i], i) for i in range(len(x)) if i != q)[:k]]
    return got, best


@pytest.mark.parametrize("spread", [None, 0.5, 1.0])
def test_cross_polytope_recall_with_unequal_norms(spark, spread):
    """One vector fifty times as long as the others, or lognormal norms."""
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if spread is None:
        x[7] *= 50
    else:
        x *= np.exp(r.normal(0, spread, (len(x), 1)))
    got, best = found_and_best(spark, x, 20, 15)
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(v) & set(best[q])) / 20 for q, v in got.items()]) >= 0.9


@pytest.mark.parametrize("n", [10, 21, 40, 300])
def test_cross_polytope_of_few_rows(spark, n):
    """No query gets fewer than k while further candidates exist, and the nearest are among them."""
    x = np.random.default_rng(7).normal(0, 1, (n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, best = found_and_best(spark, x, 20, 1 if n < 100 else 10)
    assert all(len(v) == min(20, n - 1) for v in got.values())
    assert np.mean([len(set(v) & set(best[q])) / len(best[q]) for q, v in got.items()]) >= (1 if n < 256 else 0.95)


def test_cross_polytope_ties_go_to_the_smaller_id(spark):
    """Distinct vectors with one score, more than a slice gives back."""
    r = np.random.default_rng(8)
    x = np.zeros((200, 16))
    x[:, 0] = 1
    x[np.arange(200), 1 + np.arange(200) % 15] = 1 + np.arange(200) // 15
    x[0] = np.eye(16)[0]
    x[1:] = x[1 + r.permutation(199)]
    got, _ = found_and_best(spark, x, 20, 200)
    assert got == {0: list(range(1, 21))}


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    marked = {r.doc_id: r for r in labels.collect()}
    s = {r.doc_id: r.quality_score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [i for i in marked if fold_of(i, 5) == 0]
    assert np.mean([(s[i] >= 0.3) == marked[i].quality for i in held]) >= 0.95
    train = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chain = toxicity.fit(docs, train, ["quality", "toxic"])
    p = {r.doc_id: r.p_toxic for r in toxicity.predict(docs, chain, ["quality", "toxic"]).collect()}
    flagged = [i for i in held if p[i] >= 0.5]
    assert flagged and np.mean([marked[i].toxic for i in flagged]) >= 0.8


def test_toxic_words_that_share_only_their_stem():
    """Marked texts hold words of one stem, each ending seen once; held-out ones have endings of their own."""
    r = np.random.default_rng(9)
    letters = np.array(list("abcdefghij"))
    word = lambda k: "".join(r.choice(letters, k))
    common = [word(6) for _ in range(300)]
    texts, marks = [], np.array([i % 4 == 0 for i in range(800)], float)
    for i in range(800):
        w = list(r.choice(common, 30))
        if marks[i]:
            w[3:30:9] = ["zumpelt" + word(7) for _ in range(3)]
        texts.append(" ".join(w))
    chain = toxicity.fit_chain(texts[:600], marks[:600, None], np.arange(600) % 5)
    p = toxicity.predict_chain(chain, texts[600:])[:, 0]
    assert ((p >= 0.5) == marks[600:]).mean() >= 0.98


def test_prior_estimate():
    r = np.random.default_rng(0)
    up = np.r_[r.normal(2, 1, 7000), r.normal(-2, 1, 3000)]
    assert abs(quality.estimate_prior(r.normal(2, 1, 10_000), up) - 0.7) < 0.05


def test_empty_tables(spark):
    docs = empty(spark)
    assert near_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.digests(docs).count() == 0
    assert mixing.Mix(docs).digest().count() == 0
    assert lm.score(docs).count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(packing.token_pieces(docs, path)).count() == 0
    assert binary_output.read_shards(binary_output.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert va_file.search(none, F.col("vec_id") % 50 == 0, 5).count() == 0
    assert cross_polytope.search(none, F.col("vec_id") % 20 == 0, 5).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model is None and quality.score(docs, model).count() == 0
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])
    assert toxicity.predict(docs, chain, ["quality", "toxic"]).count() == 0


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality_filter", "near_duplicate_filter", "repeat_filter", "mix", "pack"]
    step = dict(corpus_pipeline.STAGES)
    good = step["quality_filter"](spark, docs, sf).toPandas()
    assert list(good.columns) == columns and 0 < len(good) <= docs.count()
    one = step["near_duplicate_filter"](spark, spark.createDataFrame(good), sf).toPandas()
    want = brute_components(list(zip(good.doc_id, good.text)), 5, 80, 100)
    assert sorted(one.doc_id) == sorted({c for _, c in want.values()})
    cut = step["repeat_filter"](spark, spark.createDataFrame(one), sf).toPandas().set_index("doc_id")
    gone = brute_repeats(list(zip(one.doc_id, one.text)))
    assert all(0 <= len(cut.text[i].encode()) - (gone[i][0] - gone[i][1]) <= 6 * gone[i][2] for i in cut.index)
    mixed = step["mix"](spark, spark.createDataFrame(cut.reset_index()[columns]), sf)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = step["pack"](spark, mixed, sf)
    assert packed.filter("piece = 0").count() == mixed.count()


def test_deep_walk_has_one_row_a_record(spark, monkeypatch):
    """Records of crowded nodes walk on with the list of their nodes, not once a node with their signature each time."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):  # a crowd of texts that share most words but are not linked
        words = list(base)
        for k in r.choice(60, 6, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    walk, rows_in = near_dedup._walk, []

    def seen(df, threshold, trees, levels):
        if trees is None:
            rows_in.append((df.count(), df.select("record").distinct().count()))
        return walk(df, threshold, trees, levels)

    monkeypatch.setattr(near_dedup, "_walk", seen)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()
    assert rows_in and all(n == records for n, records in rows_in)
    sets = [set(t.split()) for _, t in rows]
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(root))


def test_bit_maps_drop_no_link(spark):
    """The bound from the maps keeps every pair that is linked, and drops most of a crowd just below the threshold."""
    r, rows = np.random.default_rng(2), []
    for n, share in [(1, 1.0), (3, 0.7), (90, 0.72), (90, 0.9), (700, 0.7), (5000, 0.86)]:
        for _ in range(40):
            x = r.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.where(r.random(n) < 2 * share / (1 + share), x, r.integers(0, 1 << 63, n, dtype=np.uint64))
            x, y = np.unique(x), np.unique(y)
            rows.append((near_dedup.bit_map(x), len(x), near_dedup.bit_map(y), len(y), bool(near_dedup.similar(x, y, 85, 100)), n))
    df = spark.createDataFrame(rows, "x array<long>, m long, y array<long>, n long, linked boolean, size long")
    got = df.withColumn("kept", near_dedup._possible(F.col("x"), F.col("m"), F.col("y"), F.col("n"), 85, 100)).collect()
    assert any(g["linked"] for g in got) and all(g["kept"] for g in got if g["linked"])
    assert sum(g["kept"] for g in got if g["size"] == 90 and not g["linked"]) < 0.3 * sum(g["size"] == 90 and not g["linked"] for g in got)


def test_crowds_of_some_blocks_are_compared_whole(spark, monkeypatch):
    """A crowd of a few blocks makes no deeper walk, whose rows are some hundred a record; links are exact."""
    r = np.random.default_rng(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        for k in r.choice(60, 6, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
        rows.append((1000 + i, " ".join([*words, "x"] if i % 3 else [*words[:50], *(f"y{i}_{k}" for k in range(10))])))
    walk, walked = near_dedup._walk, []
    monkeypatch.setattr(near_dedup, "_walk", lambda df, threshold, trees, levels: walked.append(trees) or walk(df, threshold, trees, levels))
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()
    assert walked == [range(near_dedup.trees_for(0.85))]
    want = brute_components(rows, 1, 85, 100)
    assert len({c for _, c in want.values()}) > 100
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_shared_sizes():
    """Intersections as matrix products, across pieces of columns and with sets that share nothing."""
    r = np.random.default_rng(13)
    sets = [np.unique(r.integers(0, 9000, r.integers(1, 3000)).astype(np.uint64)) for _ in range(20)] + [np.array([10_000], np.uint64)]
    got = near_dedup.shared_sizes(sets, sets[5:])
    assert got.shape == (21, 16) and near_dedup.COLUMNS < 9000
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets[5:]))
    assert near_dedup.shared_sizes(sets[20:], sets[:3]).tolist() == [[0, 0, 0]]
