"""Two ways to compare many rows with many rows without listing pairs.

``best_group`` finds the cheapest group (centroid) of every row. A counted, short list of groups travels to
the rows; a longer one stays a Spark table, cut into cells around pivots whose radii rule out, by the triangle
inequality, the cells that cannot hold a row's best group. ``over_tiles`` compares rows
with rows: both sides are written as tables of bounded blocks, a product of these tables brings every pair of blocks
together as two matrices without a shuffle, and the task returns reductions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from coppice.session import cut, number_rows, shared_dir

GROUP_BLOCK = 4096
TILE_ROWS = 1024
MIN_PARTS, PART_BLOCKS = 8, 16  # parts of a table of blocks, and blocks in one of more parts than that
CELL_GROUPS = 2048
TRIAL_GROUPS = 4  # times GROUP_BLOCK: up to that many groups among themselves, one product costs less than finding out whether cells pay
OPEN_SHARE = 0.25  # of all pairs of rows and groups; cells that leave more than that open are not worth their tables
MAX_PIVOTS = 1024  # cells a scope; larger cells are cut into tiles
SLACK = 1e-9  # for rounding in distances and costs


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float, copy=False) if len(column) else np.zeros((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d, 0.0)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, y))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 - _unit(x) @ _unit(y).T


@dataclass(frozen=True)
class Cost:
    """What it costs to put a row in a group, and how little it can cost within a ball of groups.

    ``value`` takes (row vectors, row weights, group vectors, group weights); ``floor`` takes (rows, row weights, ball
    centres, radii, least and greatest weight in the ball). Balls are measured by euclidean distance after ``shape``.
    """

    value: Callable
    floor: Callable
    shape: Callable = lambda x: x


def outside(x: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Least distance of a row to anything in a ball, by the triangle inequality."""
    return np.maximum(euclidean(x, p) - r, 0.0)


EUCLIDEAN = Cost(lambda x, xw, y, yw: euclidean(x, y), lambda x, xw, p, r, lo, hi: outside(x, p, r))
# 1 - uv is at least half the squared distance of u and v when neither is longer than one
COSINE = Cost(lambda x, xw, y, yw: cosine(x, y), lambda x, xw, p, r, lo, hi: outside(x, p, r) ** 2 / 2, _unit)


def _nearest(lp: pd.DataFrame, rp: pd.DataFrame, cost: Cost, has: dict[str, bool]) -> pd.DataFrame:
    """The cheapest group of every row of one block."""
    rp = rp.sort_values("gid")
    gid = rp["gid"].to_numpy()
    c = cost.value(matrix(lp["vec"]), lp["w"].to_numpy(float)[:, None] if has["w"] else None,
                   matrix(rp["vec"]), rp["w"].to_numpy(float)[None, :] if has["w"] else None)
    if has["own"]:
        c = np.where(lp["own"].to_numpy()[:, None] == gid[None, :], np.inf, c)
    if has["scope"]:
        c = np.where(lp["scope"].to_numpy()[:, None] == rp["scope"].to_numpy()[None, :], c, np.inf)
    at = c.argmin(axis=1)
    low = c[np.arange(len(lp)), at]
    return pd.DataFrame({"id": lp["id"], "gid": gid[at], "cost": low})[np.isfinite(low)]


_FOUND = "id long, gid long, cost double"


def _cheapest(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("cost", "gid")).alias("b")).select("id", "b.gid", "b.cost")


def best_group(rows: DataFrame, groups: DataFrame, cost: Cost, written: bool = False, plan: dict | None = None) -> DataFrame:
    """``(id, gid, cost)``: the cheapest group for every row; ties go to the lowest group number.

    ``rows(id, vec[, w, own, scope])``, ``groups(gid, vec[, w, scope])``. A row never matches the
    group ``own`` and, with ``scope``, only groups of the same scope; a row without any candidate
    is absent. Up to ``GROUP_BLOCK`` groups, which are counted first, travel to the rows. More stay
    in Spark: rows meet them in tiles, and where a scope holds more than ``CELL_GROUPS``, only in the
    cells that can hold a cheaper one, unless the cells leave more than ``OPEN_SHARE`` of all pairs open, as they
    do in many dimensions: then every row meets every group of its scope, once. ``written`` says that ``groups``
    is already a table; a ``plan`` that is handed from call to call remembers that cells did not pay. Up to
    ``TRIAL_GROUPS`` blocks of groups that look for each other (``rows`` is ``groups``) do not try cells.
    """
    shared_dir(rows.sparkSession)
    has = {c: c in rows.columns for c in ("w", "own", "scope")}
    cols = ["id", "vec", *[c for c in has if has[c]]]
    take = ["gid", "vec", *[c for c in ("w", "scope") if has[c]]]
    same = rows is groups and has["scope"]
    groups = groups.select(*take) if written else cut(groups.select(*take))
    if len(groups.limit(GROUP_BLOCK + 1).select("gid").collect()) > GROUP_BLOCK:
        plan = {} if plan is None else plan
        if same and (plan.get("all") or groups.limit(TRIAL_GROUPS * GROUP_BLOCK + 1).count() <= TRIAL_GROUPS * GROUP_BLOCK):
            return _cheapest(_all_pairs(rows, rows, cost, has))
        return _best_of_many(cut(rows.select(*cols)), groups, cost, has, plan)
    held = groups.toPandas()
    if not len(held):
        return rows.select("id", F.lit(None).cast("long").alias("gid"), F.lit(None).cast("double").alias("cost")).limit(0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _nearest(pdf, held, cost, has)

    return rows.select(*cols).mapInPandas(nearest, _FOUND)


def _all_pairs(left: DataFrame, right: DataFrame, cost: Cost, has: dict[str, bool]) -> DataFrame:
    """The cheapest group of every row in each block of groups of its scope."""
    inside = {**has, "scope": False}  # a tile holds one scope
    return over_tiles(left, right, lambda lp, rp: _nearest(lp, rp, cost, inside), _FOUND)


def _best_of_many(rows: DataFrame, groups: DataFrame, cost: Cost, has: dict[str, bool], plan: dict) -> DataFrame:
    """Both sides stay in Spark; tasks return one group per row and block."""
    if not has["scope"]:
        rows, groups = rows.withColumn("scope", F.lit(0)), groups.withColumn("scope", F.lit(0))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return _all_pairs(left, right, cost, has)

    sizes = groups.groupBy("scope").agg(F.count("*").alias("_n"))
    if plan.get("all") or not sizes.filter(F.col("_n") > CELL_GROUPS).take(1):
        return _cheapest(meet(rows, groups.withColumn("id", F.col("gid"))))
    sizes = cut(sizes)
    placed, cells = _cells(groups, sizes, cost)
    apart = placed.select("gid", "vec", *(["w"] if has["w"] else []), F.col("gid").alias("id"), F.col("cell").alias("scope"))

    def floors(lp: pd.DataFrame, rp: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, p = cost.shape(matrix(lp["vec"])), matrix(rp["vec"])
        xw = lp["w"].to_numpy(float)[:, None] if has["w"] else None
        low = cost.floor(x, xw, p, *[rp[c].to_numpy(float)[None, :] for c in ("radius", "least", "most")])
        return low, euclidean(x, p)

    def home(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        low, d = floors(lp, rp)
        at = np.where(low <= low.min(axis=1, keepdims=True), d, np.inf).argmin(axis=1)
        i = np.arange(len(lp))
        return pd.DataFrame({"id": lp["id"], "low": low[i, at], "d": d[i, at], "cell": rp["id"].to_numpy()[at]})

    first = over_tiles(rows, cells, home, "id long, low double, d double, cell long").groupBy("id").agg(F.min(F.struct("low", "d", "cell")).alias("b"))
    homes = cut(first.select("id", F.col("b.cell").alias("home")))
    visit = lambda seen: rows.drop("scope").join(seen, "id")
    near = cut(_cheapest(meet(visit(homes.withColumnRenamed("home", "scope")), apart)))
    known = rows.join(homes, "id").join(near.select("id", "cost"), "id", "left").withColumn("best", F.coalesce("cost", F.lit(float("inf"))))

    def still_open(lp: pd.DataFrame, rp: pd.DataFrame) -> np.ndarray:
        low, _ = floors(lp, rp)
        best = lp["best"].to_numpy()[:, None]
        slack = SLACK * (1 + np.abs(np.where(np.isfinite(best), best, 0.0)))
        return (low <= best + slack) & (lp["home"].to_numpy()[:, None] != rp["id"].to_numpy()[None, :])

    def open_pairs(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pairs": [int((still_open(lp, rp) @ rp["held"].to_numpy(np.int64)).sum())]})

    def open_cells(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(still_open(lp, rp))
        return pd.DataFrame({"id": lp["id"].to_numpy()[i], "scope": rp["id"].to_numpy()[j]})

    known = cut(known)
    pairs = over_tiles(known, cells, open_pairs, "pairs long").agg(F.sum("pairs")).first()[0] or 0
    every = rows.groupBy("scope").agg(F.count("*").alias("_m")).join(sizes, "scope").agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0
    if pairs > OPEN_SHARE * every:
        plan["all"] = True
        return _cheapest(meet(rows, groups.withColumn("id", F.col("gid"))))
    seen = cut(over_tiles(known, cells, open_cells, "id long, scope long"))
    return _cheapest(near.unionByName(meet(visit(seen), apart)))


def _cells(groups: DataFrame, sizes: DataFrame, cost: Cost) -> tuple[DataFrame, DataFrame]:
    """Groups with the pivot they are nearest to, and the table of pivots with the radii of their cells.

    Pivots are groups picked by a hash of their number, about one in ``CELL_GROUPS`` and at most about
    ``MAX_PIVOTS`` a scope; the first group of a scope is one anyhow. A cell keeps its least and greatest weight.
    """
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("_n") / CELL_GROUPS))
    drawn = groups.join(sizes, "scope").filter((wanted > 1) & (F.pmod(F.xxhash64("gid"), F.ceil(F.col("_n") / wanted)) == 0)).select("scope", "gid", "vec")
    firsts = groups.groupBy("scope").agg(F.min_by(F.struct("gid", "vec"), "gid").alias("g")).select("scope", "g.*")
    pivots = cut(drawn.unionByName(firsts).dropDuplicates(["gid"]).withColumnRenamed("gid", "id"))

    def closest(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values("id")
        d = euclidean(cost.shape(matrix(lp["vec"])), cost.shape(matrix(rp["vec"])))
        at = d.argmin(axis=1)
        return pd.DataFrame({"id": lp["id"], "d": d[np.arange(len(lp)), at], "cell": rp["id"].to_numpy()[at]})

    found = over_tiles(groups.withColumn("id", F.col("gid")), pivots, closest, "id long, d double, cell long")
    near = found.groupBy("id").agg(F.min(F.struct("d", "cell")).alias("b")).select(F.col("id").alias("gid"), F.col("b.cell").alias("cell"), F.col("b.d").alias("far"))
    placed = cut(groups.join(near, "gid"))
    w = F.col("w") if "w" in groups.columns else F.lit(1.0)
    balls = placed.groupBy("cell").agg((F.max("far") * (1 + SLACK) + SLACK).alias("radius"), F.min(w).alias("least"), F.max(w).alias("most"), F.count("*").alias("held"))

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(vec=list(cost.shape(matrix(pdf["vec"]))))

    kind = dict(groups.dtypes)["scope"]
    table = pivots.join(balls, pivots["id"] == balls["cell"]).select("id", "scope", F.col("vec").cast("array<double>").alias("vec"), "radius", *[F.col(c).cast("double").alias(c) for c in ("least", "most")], "held")
    return placed, cut(table.mapInPandas(shaped, f"id long, scope {kind}, vec array<double>, radius double, least double, most double, held long"))


def packed(rows: DataFrame, tile_rows: int, order: list | None = None) -> DataFrame:
    """``(scope, block, items array<struct>)``: the rows of a scope in blocks of about ``tile_rows``, a block a row.

    The block of a row is a hash of its id (or of a ``block_key`` column); with ``order`` it follows from the row's
    place in that order, so what is near in it shares a block. The table is written in parts of a few blocks each.
    """
    if "scope" not in rows.columns:
        rows = rows.withColumn("scope", F.lit(0))
    take = [c for c in rows.columns if c != "block_key"]
    if order is None:
        sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / tile_rows).alias("_n"))
        key = "block_key" if "block_key" in rows.columns else "id"
        placed = rows.join(cut(sizes), "scope").withColumn("block", F.pmod(F.xxhash64(key), F.col("_n")))
    else:
        placed = number_rows(rows, order, "_n", within=["scope"]).withColumn("block", F.floor((F.col("_n") - 1) / tile_rows))
    out = cut(placed.groupBy("scope", "block").agg(F.collect_list(F.struct(*take)).alias("items")))
    parts = min(max(MIN_PARTS, -(-(n := out.count()) // PART_BLOCKS)), n)
    return cut(out.repartition(parts)) if parts > 1 else out


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(scope, block, mine, others)``: every block of the left table beside every one of the right of the same scope.

    A product of two tables that lie in the shared folder: each task reads one part of either, so no row is shuffled
    once for each block that it meets. The scopes are compared as a range, since a join on equal scopes would send a
    scope to one task.
    """
    mine = left.select("scope", "block", F.col("items").alias("mine"))
    others = right.select(F.col("scope").alias("_scope"), F.col("items").alias("others"))
    return mine.join(others, F.abs(F.col("scope") - F.col("_scope")) < 1).drop("_scope")


def unpacked(column: pa.ListArray, i: int) -> pa.RecordBatch:
    """The rows of the block in row ``i``."""
    return pa.RecordBatch.from_struct_array(column.slice(i, 1).flatten())


def over_tiles(left: DataFrame, right: DataFrame, fn: Callable, schema: str, tile_rows: int | None = None) -> DataFrame:
    """Run ``fn(left_block, right_block)`` for every pair of blocks of the same scope.

    Both sides have a unique ``id`` and may have an integer ``scope``; rows of different scopes never
    meet. The block of a row is a hash of its id (or of a ``block_key`` column), and a scope has as
    many blocks as its size asks for, so blocks stay even and bounded whatever the data looks like.
    """
    shared_dir(left.sparkSession)
    tile_rows = tile_rows or TILE_ROWS
    mine = packed(left, tile_rows)
    others = mine if right is left else packed(right, tile_rows)
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lp = None, None
        for b in batches:
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if key != at:
                    at, lp = key, unpacked(b.column(2), i).to_pandas()
                out = fn(lp, unpacked(b.column(3), i).to_pandas())
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, shape, preserve_index=False)

    return block_pairs(mine, others).mapInArrow(run, schema)
