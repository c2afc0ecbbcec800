"""Rows against groups: the short list, the tiles and the cells give what a plain scan gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coppice.operators import blocks as bl
from coppice.operators import linkage as lk
from coppice.operators import vector_metrics as vm
from tests.conftest import points

COSTS = {"euclidean": bl.EUCLIDEAN, "cosine": bl.COSINE, "ward": lk.WARD, "average": lk.AVERAGE, "davies": vm.DAVIES}


def fixture(spark, kind, n=220, g=150, dim=3, scopes=2, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim)) * 4
    draw = lambda m: np.round(centres[r.integers(0, 6, m)] + r.normal(size=(m, dim)) * 0.5, 1)  # noqa: E731  rounded: ties
    x, y = draw(n), draw(g)
    y[:5] = y[5:10]  # equal groups
    x[0] = 0
    if kind == "average":
        x, y = (v / np.maximum(1, np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y))
    xs, ys = r.integers(0, scopes, n), r.integers(0, scopes, g)
    xw, yw = r.integers(1, 9, n).astype(float), r.integers(1, 9, g).astype(float)
    own = r.integers(0, g, n)
    rows = spark.createDataFrame([(i, x[i].tolist(), xw[i].item(), int(own[i]), int(xs[i])) for i in range(n)], "id long, vec array<double>, w double, own long, scope int")
    groups = spark.createDataFrame([(i, y[i].tolist(), yw[i].item(), int(ys[i])) for i in range(g)], "gid long, vec array<double>, w double, scope int")
    c = COSTS[kind].value(x, xw[:, None], y, yw[None, :])
    return rows, groups, c, own, xs, ys


@pytest.mark.parametrize("kind", COSTS)
@pytest.mark.parametrize("cell", [12, 1000])
def test_best_group_of_many(spark, monkeypatch, kind, cell):
    monkeypatch.setattr(bl, "GROUP_BLOCK", 20)
    monkeypatch.setattr(bl, "CELL_GROUPS", cell)
    monkeypatch.setattr(bl, "TILE_ROWS", 64)
    rows, groups, c, own, xs, ys = fixture(spark, kind)
    c = np.where((xs[:, None] != ys[None, :]) | (np.arange(c.shape[1])[None, :] == own[:, None]), np.inf, c)
    got = {r.id: (r.gid, r.cost) for r in bl.best_group(rows, groups, COSTS[kind]).collect()}
    for i, row in enumerate(c):
        assert abs(got[i][1] - row.min()) < 1e-9 and row[got[i][0]] <= row.min() + 1e-9


def test_short_and_long_lists_agree(spark, monkeypatch):
    rows, groups, *_ = fixture(spark, "euclidean", dim=2)
    whole = F.transform("vec", lambda v: F.round(v))
    rows, groups = rows.select("id", whole.alias("vec")), groups.select("gid", whole.alias("vec"))
    answer = lambda: {(r.id, r.gid, r.cost) for r in bl.best_group(rows, groups, bl.EUCLIDEAN).collect()}
    short = answer()  # whole numbers: many exact ties, to the lowest group number
    monkeypatch.setattr(bl, "GROUP_BLOCK", 20)
    tiles = answer()
    monkeypatch.setattr(bl, "CELL_GROUPS", 9)
    assert short == tiles == answer() and len(short) == 220


def test_cells_rule_out_most_groups(spark, monkeypatch):
    """Well apart cells: nearly every row is settled in its home cell."""
    monkeypatch.setattr(bl, "GROUP_BLOCK", 20)
    monkeypatch.setattr(bl, "CELL_GROUPS", 25)
    met = []
    over = bl.over_tiles

    def counted(left, right, fn, schema, *more):
        if schema == bl._FOUND:
            met.append(left.count())
        return over(left, right, fn, schema, *more)

    monkeypatch.setattr(bl, "over_tiles", counted)
    rows, groups, *_ = fixture(spark, "euclidean", n=400, g=600, scopes=1)
    cells = bl._cells(groups, groups.groupBy("scope").agg(F.count("*").alias("_n")), bl.EUCLIDEAN)[1].count()
    bl.best_group(rows, groups, bl.EUCLIDEAN).collect()
    assert cells > 12 and met[0] == 400 and met[1] < 400 * (cells - 1) / 2


def test_blocks_meet_without_a_shuffle_of_their_rows(spark):
    x = np.random.default_rng(5).normal(size=(300, 4))
    rows = points(spark, x).withColumn("scope", (F.col("id") % 3).cast("int"))
    got = bl.over_tiles(rows, rows, lambda lp, rp: pd.DataFrame({"id": lp["id"], "n": len(rp)}), "id long, n long", 16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "hashpartitioning" not in plan
    assert {r["id"]: r["n"] for r in got.groupBy("id").agg(F.sum("n").alias("n")).collect()} == {i: 100 for i in range(300)}
