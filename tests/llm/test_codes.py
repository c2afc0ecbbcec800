"""Vector codes and whitening against plain numpy, with hard rows."""

import hashlib

import numpy as np
import pytest

from coppice.llm import bidiagonal, trie_codes, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "c", 1, 2, "x") for i, v, lab in rows], SCHEMA)


def vectors(n, dim, seed=0, spread=0.2):
    r = np.random.default_rng(seed)
    x = r.normal(0, spread, (n, dim)).astype(np.float32).astype(float)
    rows = [(i, x[i], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(n + i, x[0], 1) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [rows[1], rows[1]]  # repeated rows
    bad = [None, [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1), []]
    return rows + [(9000 + i, v, 2) for i, v in enumerate(bad)], [r for r in rows]


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0], list(r[1])))
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        a, _ = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (a[:, p] == e).any():
                    books[p, e] = x[a[:, p] == e, p].sum(axis=0) // (a[:, p] == e).sum()
    a, d = near()
    err, by = d.sum(axis=1), {}
    for r, e in zip(rows, err):
        by[r[2]] = by.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    return sorted((r[0], "".join(f"{c:02x}" for c in code), int(e), by[r[2]], sha) for r, code, e in zip(rows, a, err))


@pytest.mark.parametrize("n,dim", [(400, 64), (20, 16), (2, 32)])
def test_codes(spark, n, dim):
    rows, kept = vectors(n, dim)
    got = trie_codes.digest(frame(spark, rows).repartition(5))
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(kept, 16, 64, 2)


@pytest.mark.parametrize("width,run", [(1, 1), (2, 3), (4, 7), (4, 2048)])
def test_trie_walk(width, run):
    r = np.random.default_rng(width)
    for n in (0, 1, 2, 700):
        parts = np.unique(r.integers(-6, 6, (n, width)), axis=0)
        book = r.integers(-6, 6, (20, width))  # with equal entries and ties
        best, error = trie_codes.walk(parts, book, run)
        d = ((parts[:, None] - book) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_refuse_what_they_cannot_do(spark):
    with pytest.raises(ValueError):
        trie_codes.digest(frame(spark, [(1, [0.5] * 10, 0)]))
    with pytest.raises(ValueError):
        trie_codes.first_books(trie_codes.kept_vectors(frame(spark, [(1, [1e30] * 16, 0)]), "vec_id", "embedding", "label"), 16, 64)


def plain_whitening(kept, k=16):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in kept], dtype=object)
    once = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(once), once.sum(axis=0)
    dev = [int(((n * r - s) ** 2).sum()) for r in x]
    c = ((n * once - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, dev, e, v, ((n * x - s) / n).astype(float) @ v / np.sqrt(e), np.trace(c.T @ c / n)


def test_whitening(spark):
    rows, kept = vectors(300, 24, spread=0.5)
    n, dev, e, v, w, trace = plain_whitening(kept)
    got = whitening.whiten(frame(spark, rows).repartition(6)).toPandas()
    assert len(got) == 16 * len(kept) and (got.n == n).all() and got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-10
    want = {}
    for (i, _, _), d, z in zip(kept, dev, w):
        want[i] = (d, z)
    sign = {}
    for r in got.itertuples():
        d, z = want[r.vec_id]
        z = z[r.component - 1]
        sign.setdefault(r.component, np.sign(z * r.whitened))
        assert r.deviation == d and abs(r.whitened - sign[r.component] * z) < 1e-9 and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-10


def test_whitening_without_variance(spark):
    same = [(i, [0.25] * 4, 0) for i in range(5)]
    assert whitening.whiten(frame(spark, same)).count() == 0
    line = [(i, [i, 2 * i, 0, 1], 0) for i in range(6)]
    got = whitening.whiten(frame(spark, line)).toPandas()
    assert set(got.component) == {1} and len(got) == 6 and np.allclose(got.explained, 1)


def test_deviation_beyond_64_bits_is_null():
    d = np.array([[3, 4], [2**31, 2**31], [2**32, 2**32]], np.int64)
    assert whitening.deviations(d) == [25, None, None] and whitening.deviations(d[:1]) == [25]


@pytest.mark.parametrize("op", [trie_codes.digest, whitening.whiten])
def test_empty(spark, op):
    assert op(frame(spark, [])).count() == 0
    assert op(frame(spark, [(1, None, 0), (2, [], None)])).count() == 0


def matrices():
    r = np.random.default_rng(1)
    q = [np.linalg.qr(r.normal(size=(30, 30)))[0] for _ in range(2)]
    yield from (np.linalg.qr(r.normal(size=(n + 5, n)), mode="r") for n in (1, 2, 3, 40))
    yield np.eye(12)
    yield q[0]
    for values in (np.repeat([5, 3, 1], 10), np.repeat([5, 3, 1], 10) * (1 + 1e-9 * r.normal(size=30)), 10.0 ** -np.arange(0, 9, 0.3)):
        yield q[0] @ np.diag(values) @ q[1]
    w = np.diag(np.abs(np.arange(-10, 11.0)) + 1) + np.diag(np.ones(20), 1)
    yield w
    yield np.kron(np.eye(3), w) + 1e-10 * np.eye(63, k=1)  # blocks that hardly touch have equal values
    low = r.normal(size=(50, 12))
    low[:, 3], low[:, 5], low[:, 7] = low[:, 4], 0, low[:, 1] + low[:, 2]
    yield np.linalg.qr(low, mode="r")
    yield np.zeros((4, 4))


def test_bidiagonal_solver():
    for m in matrices():
        sigma, v = bidiagonal.right_singular(m, len(m))
        want = np.linalg.svd(m)[1]
        assert len(sigma) == (want > 1e-12 * max(want[0], 1e-300)).sum()
        if len(sigma):
            assert np.abs(sigma - want[: len(sigma)]).max() < 1e-13 * want[0]
            assert np.abs(v.T @ v - np.eye(len(sigma))).max() < 1e-12
            assert np.abs(m.T @ (m @ v) - v * sigma**2).max() < 1e-13 * want[0] ** 2


def test_qd_keeps_small_values_accurate():
    a, b = 10.0 ** -np.arange(0, 40, 2.0), 0.3 * 10.0 ** -np.arange(1, 39, 2.0)
    got = np.array(bidiagonal.dqds(list(a * a), list(b * b)))
    assert abs(np.prod(got / (a * a)) - 1) < 1e-10  # the determinant, over eighty orders of magnitude
