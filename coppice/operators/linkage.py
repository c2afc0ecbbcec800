"""Agglomerative clustering as rounds of merging mutual nearest neighbours.

For Ward, average and complete linkage, merging every pair of groups that are each other's nearest
neighbour yields the same dendrogram as merging one closest pair at a time, so a round merges many
pairs and the number of rounds grows with the logarithm of the items. One dendrogram serves every
number of clusters, and all scopes are clustered together.

Ward and average (cosine) distances follow from group sums, so those rounds compare group
summaries; complete linkage needs the farthest pair of members and keeps the distances of near groups.
``items(id, vec[, w, scope])``: ``w`` weighs an item that stands for several.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import vectors as vx
from coppice.operators import blocks as bl
from coppice.session import cut, number_rows

TAIL_GROUPS = 512  # groups per scope that one task may finish in complete linkage, whose distances come as rows
SUMMARY_TAIL = 1 << 17  # the same for ward and average, whose rounds the task goes on with from the summaries alone
TAIL_BYTES = 64 << 20  # of summaries in such a task, so wide vectors leave it fewer groups
SQUARE_TAIL = 1024  # of which it keeps all costs: the square of that in numbers
TAIL_ROWS, TAIL_COLUMNS = 256, 2048  # costs computed together
CANDIDATES = 16  # nearest groups that a group keeps in complete linkage
CHUNK = 256  # items of a large group that are compared together
DIGITS = 10  # costs closer than this are ties, so that both sides of a pair agree


def _ward_cost(x, xw, y, yw):
    return np.round(np.sqrt(2.0 * xw * yw / (xw + yw) * bl.squared(x, y)), DIGITS)


def _average_cost(x, xw, y, yw):
    return np.round(1.0 - x @ y.T, DIGITS)


def _average_floor(x, xw, p, r, lo, hi):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.maximum(1.0 - x @ p.T - size * r, bl.outside(x, p, r) ** 2 / 2)


WARD = bl.Cost(_ward_cost, lambda x, xw, p, r, lo, hi: np.sqrt(2.0 * xw * lo / (xw + lo)) * bl.outside(x, p, r))
AVERAGE = bl.Cost(_average_cost, _average_floor)  # group vectors are means of unit vectors


def _sides(method: str, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns whose product is the squared distance, or the cosine distance less one."""
    if method == "average":
        return -x, x
    one = np.ones((len(x), 1))
    return np.hstack([-2.0 * x, square[:, None], one]), np.hstack([x, one, square[:, None]])


def _weighed(method: str, t: np.ndarray, xw: np.ndarray, yw: np.ndarray) -> np.ndarray:
    """What a cost follows from, in the same order as the costs, without their roots and roundings."""
    if method == "average":
        return t
    if xw.min() == xw.max() == yw.min() == yw.max():
        t *= xw[0] / 2.0
    else:
        t /= (1.0 / xw)[:, None] + (1.0 / yw)[None, :]
    return t


def _rounded(method: str, t: np.ndarray) -> np.ndarray:
    return np.round(1.0 + t if method == "average" else np.sqrt(2.0 * np.maximum(t, 0.0)), DIGITS)


def _up_to(method: str, cost: np.ndarray) -> np.ndarray:
    """The greatest such value that is rounded to ``cost``."""
    top = cost + 0.5 * 10.0**-DIGITS
    return top - 1.0 if method == "average" else top * top / 2.0


def _look(method: str, x: np.ndarray, square: np.ndarray, size: np.ndarray, rows: np.ndarray, low: np.ndarray, at: np.ndarray, told: np.ndarray | None) -> None:
    """Find the nearest group ``at`` of ``rows`` and its cost ``low``; groups that are ``told`` take a row that is nearer, or as near and before theirs."""
    best, to = np.full(len(rows), np.inf), np.zeros(len(rows), int)
    for c in range(0, len(x), TAIL_COLUMNS):
        columns = slice(c, min(c + TAIL_COLUMNS, len(x)))
        right = _sides(method, x[columns], square[columns])[1].T
        for lo in range(0, len(rows), TAIL_ROWS):
            part = rows[lo : lo + TAIL_ROWS]
            t = _weighed(method, _sides(method, x[part], square[part])[0] @ right, size[part], size[columns])
            own = np.flatnonzero((part >= c) & (part < columns.stop))
            t[own, part[own] - c] = np.inf
            least = t.min(axis=1)
            value = _rounded(method, least)
            new = np.flatnonzero(value < best[lo : lo + TAIL_ROWS])
            if len(new):
                best[lo + new] = value[new]
                to[lo + new] = c + (t[new] <= np.maximum(_up_to(method, value[new]), least[new])[:, None]).argmax(axis=1)
            if told is not None:
                near = np.flatnonzero(told[columns] & (t.min(axis=0) <= _up_to(method, low[columns])))
                if len(near):
                    cost = _rounded(method, t[:, near])
                    first = cost.argmin(axis=0)
                    cost, k = cost[first, np.arange(len(near))], c + near
                    sooner = (cost < low[k]) | ((cost == low[k]) & (part[first] < at[k]))
                    low[k[sooner]], at[k[sooner]] = cost[sooner], part[first[sooner]]
    low[rows], at[rows] = best, to


def _rounds(x: np.ndarray, size: np.ndarray, names: np.ndarray, method: str, most: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Rounds on the summaries of one scope, in order of their first items, until at most ``most`` groups are left.

    A merge is no nearer to a group than its parts were, so only merges and groups whose nearest was merged look again;
    the others are told of a merge that costs as much as their nearest and comes before it.
    """
    low, at, out = np.full(len(x), np.inf), np.zeros(len(x), int), []
    square = (x * x).sum(axis=1)
    if len(x) > most:
        _look(method, x, square, size, np.arange(len(x)), low, at, None)
    while len(x) > most:
        i = np.arange(len(x))
        a = i[(at[at] == i) & (i < at)]
        if not len(a):
            tied = i[low == low.min()]
            a = tied[np.lexsort((np.maximum(tied, at[tied]), np.minimum(tied, at[tied])))[:1]]
        a, b = np.minimum(a, at[a]), np.maximum(a, at[a])
        up, both = names[a] + offset, size[a] + size[b]
        out += [(int(n), int(u), float(h)) for part in (a, b) for n, u, h in zip(names[part], up, low[a])]
        x[a] = (x[a] * size[a][:, None] + x[b] * size[b][:, None]) / both[:, None]
        size[a], names[a], square[a] = both, up, (x[a] * x[a]).sum(axis=1)
        fresh, gone = np.zeros(len(x), bool), np.zeros(len(x), bool)
        fresh[a], gone[b] = True, True
        stale = (fresh | gone)[at] & ~fresh
        place, kept = np.cumsum(~gone) - 1, ~gone
        x, size, names, square, low, at, fresh, stale = (v[kept] for v in (x, size, names, square, low, place[at], fresh, stale))
        _look(method, x, square, size, np.flatnonzero(fresh), low, at, ~(fresh | stale))
        _look(method, x, square, size, np.flatnonzero(stale), low, at, None)
    return x, size, names, out


def dendrogram(items: DataFrame, method: str = "ward") -> DataFrame:
    """``(scope, node, up, height)``: the merge every node goes into; the last merge has no row.

    Items are nodes under their own id; a merge node is named after the part with the smaller first item, one
    offset higher. Rounds run until every scope is down to ``TAIL_GROUPS`` groups (``SUMMARY_TAIL``, or ``TAIL_BYTES``,
    where costs follow from summaries); what is left, a bounded table per scope, is finished in one task per scope. A group is known by its first item, and of equal
    costs the pair with the smaller first items goes first, in the rounds as in the tail.
    """
    unit = F.transform("vec", lambda v: v / vx.norm(F.col("vec"))) if method == "average" else F.col("vec")
    start = cut(items.select(
        "id", (F.col("scope") if "scope" in items.columns else F.lit(0)).alias("scope"), unit.alias("vec"),
        (F.col("w").cast("double") if "w" in items.columns else F.lit(1.0)).alias("w")))
    offset = (start.agg(F.max("id")).first()[0] or 0) + 1
    start, copied = _collapse(start, method, offset)
    steps = [*copied, *(_complete_rounds(start, offset) if method == "complete" else _summary_rounds(start, method, offset))]
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return cut(out)


def _collapse(start: DataFrame, method: str, offset: int) -> tuple[DataFrame, list[DataFrame]]:
    """Items without distance between them, merged first and all at once: copies join the first of them one by one.

    Left to the rounds, a set of copies would merge one pair a round.
    """
    size = F.greatest(vx.norm(F.col("vec")), F.lit(1e-300))
    key = F.col("vec") if method == "ward" else F.transform("vec", lambda v: F.round(v / size, 12) + F.lit(0.0))
    keyed = start.withColumn("_key", key)
    same = cut(keyed.groupBy("scope", "_key").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("w").alias("_w")))
    if not same.filter("n > 1").take(1):
        return start.withColumn("node", F.col("id")), []
    copies = keyed.join(same.filter("n > 1").select("scope", "_key", "first"), ["scope", "_key"]).select("id", "scope", "first")
    nth = number_rows(copies, ["id"], "_no", within=["scope", "first"]).filter("_no > 1").withColumn("up", F.col("first") + (F.col("_no") - 1) * offset)
    step = cut(nth.select("scope", F.explode(F.array(F.col("up") - offset, F.col("id"))).alias("node"), "up", F.lit(0.0).alias("height")))
    firsts = same.select(F.col("first").alias("id"), (F.col("first") + (F.col("n") - 1) * offset).alias("node"), "_w")
    return cut(start.join(firsts, "id").select("id", "scope", "vec", F.col("_w").alias("w"), "node")), [step]


def _too_many(groups: DataFrame, most: int) -> bool:
    return bool(groups.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > most).take(1))


def _summary_rounds(start: DataFrame, method: str, offset: int) -> list[DataFrame]:
    """Rounds whose costs follow from group sums."""
    groups = cut(start.select(F.col("id").alias("gid"), "node", "scope", "vec", "w"))
    cost = WARD if method == "ward" else AVERAGE
    steps, plan = [], {}
    width = groups.agg(F.max(F.size("vec"))).first()[0] or 1
    most = min(SUMMARY_TAIL, max(SQUARE_TAIL, TAIL_BYTES // (8 * width)))
    while _too_many(groups, most):
        rows = groups.select("gid", "scope", "vec", "w", F.col("gid").alias("id"), F.col("gid").alias("own"))
        near = cut(bl.best_group(rows, rows, cost, written=True, plan=plan))
        step = cut(_merge_rows(_mutual_pairs(near), groups, offset))
        if step.isEmpty():
            closest = near.orderBy("cost", F.least("id", "gid"), F.greatest("id", "gid")).limit(1).select(
                F.least("id", "gid").alias("a"), F.greatest("id", "gid").alias("b"), "cost")
            step = cut(_merge_rows(closest, groups, offset))
        steps.append(step.select("scope", "node", "up", "height"))
        weighted = F.transform("vec", lambda v: v * F.col("w"))
        moved = groups.join(step.select("node", "up", "to"), "node", "left").select(
            F.coalesce("to", "gid").alias("gid"), F.coalesce("up", "node").alias("node"), "scope", weighted.alias("vec"), "w")
        summed = moved.groupBy("gid", "node", "scope").agg(vx.sum_vector(F.col("vec")).alias("total"), F.sum("w").alias("w"))
        groups = cut(summed.select("gid", "node", "scope", F.transform("total", lambda v: v / F.col("w")).alias("vec"), "w"))
    return [*steps, _tail(groups.withColumn("far", F.lit(None).cast(_FAR)), method, offset)]


_FAR = "array<struct<gid:bigint,d:double>>"


def _blocked(members: DataFrame) -> DataFrame:
    """Members with the block they are compared in: a group of up to ``CHUNK`` items stays whole, a larger one is
    dealt out in chunks of that size, so a block holds few groups either way."""
    sizes = cut(members.groupBy("gid").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")))
    key = F.xxhash64("gid", F.pmod(F.xxhash64("id"), F.col("chunks")))
    return members.join(sizes, "gid").select("id", "scope", "vec", "gid", (F.col("chunks") == 1).alias("whole"), key.alias("block_key"))


def _farthest(lp: pd.DataFrame, rp: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Groups of either block, the farthest pair of items between them and whether that is all of both."""
    lp, rp = lp.sort_values("gid"), rp.sort_values("gid")
    lg, l0 = np.unique(lp["gid"].to_numpy(), return_index=True)
    rg, r0 = np.unique(rp["gid"].to_numpy(), return_index=True)
    d = np.round(bl.cosine(bl.matrix(lp["vec"]), bl.matrix(rp["vec"])), DIGITS)
    d = np.maximum.reduceat(np.maximum.reduceat(d, l0, axis=0), r0, axis=1)
    return lg, rg, d, lp["whole"].to_numpy()[l0][:, None] & rp["whole"].to_numpy()[r0][None, :]


def _candidates(stale: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, d)`` with the ``CANDIDATES`` nearest groups of every stale group, and ``(gid, beyond)``: no group
    left out is nearer than that. Tasks return that many groups of a block, and partial maxima of dealt-out groups."""
    def tile(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        lg, rg, d, whole = _farthest(lp, rp)
        other = lg[:, None] != rg[None, :]
        settled = np.where(whole & other, d, np.inf)
        m = min(CANDIDATES, len(rg))
        at = np.argpartition(settled, m - 1, axis=1)[:, :m]
        low = np.take_along_axis(settled, at, axis=1)
        i, j = np.nonzero(np.isfinite(low))
        p, q = np.nonzero(~whole & other)
        return pd.DataFrame({"x": np.concatenate([lg[i], lg[p]]), "y": np.concatenate([rg[at[i, j]], rg[q]]),
                             "d": np.concatenate([low[i, j], d[p, q]])})

    left = blocked.join(stale.select("gid"), "gid", "left_semi")
    found = bl.over_tiles(left, blocked, tile, "x long, y long, d double").groupBy("x", "y").agg(F.max("d").alias("d"))
    ranked = cut(found.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy("d", "y"))).filter(F.col("rank") <= CANDIDATES))
    pairs = ranked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")
    last = ranked.filter(F.col("rank") == CANDIDATES).select(F.col("x").alias("gid"), F.col("d").alias("beyond"))
    return pairs, last


def _complete_rounds(start: DataFrame, offset: int) -> list[DataFrame]:
    """Rounds on a sparse table of known distances between groups.

    A merge's distance to a third group is the greater of its parts' distances, so known distances stay
    exact without meeting items again. ``beyond`` bounds every distance that a group's list lacks; a
    group whose nearest known group is not below it is stale, and only stale groups meet the items again,
    once a quarter of all are stale or no merge is certain.
    """
    members = cut(start.select("id", "scope", "vec", F.col("id").alias("gid")))
    groups = cut(start.select(F.col("id").alias("gid"), "node", "scope", "w", F.lit(-1.0).alias("beyond")))
    pairs, steps = None, []
    while _too_many(groups, TAIL_GROUPS):
        sizes = groups.groupBy("scope").agg(F.count("*").alias("_n"))
        inf = F.lit(float("inf"))

        def nearest(pairs: DataFrame | None, groups: DataFrame, sizes: DataFrame = sizes) -> DataFrame:
            side = lambda a, b: F.struct(F.col(a).alias("id"), F.col("d").alias("cost"), F.col(b).alias("gid"))
            rows = groups.join(sizes, "scope").select(F.col("gid").alias("id"), "beyond", "_n")
            if pairs is None:
                return rows.select("id", "_n", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("long").alias("gid"), F.lit(False).alias("sure"))
            near = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*").groupBy("id").agg(F.min(F.struct("cost", "gid")).alias("m"))
            return rows.join(near, "id", "left").select("id", "_n", "m.cost", "m.gid", F.coalesce(F.col("m.cost") < F.col("beyond"), F.lit(False)).alias("sure"))

        near = cut(nearest(pairs, groups))
        stale = near.filter(~F.col("sure") & (F.col("_n") > 1)).select(F.col("id").alias("gid"))
        chosen = cut(_mutual_pairs(near.filter("sure")))
        if 4 * stale.count() > near.count() or chosen.isEmpty():
            stale = cut(stale)
            found, last = _candidates(stale, cut(_blocked(members)))
            pairs = cut((found if pairs is None else pairs.unionByName(found)).dropDuplicates(["a", "b"]))
            fresh = stale.join(last, "gid", "left").select("gid", F.coalesce("beyond", inf).alias("_new"))
            groups = cut(groups.join(fresh, "gid", "left").withColumn("beyond", F.coalesce("_new", "beyond")).drop("_new"))
            near = cut(nearest(pairs, groups))
            chosen = cut(_mutual_pairs(near.filter("sure")))
            if chosen.isEmpty():  # every list is tied from end to end: the first pair of all is certain
                chosen = pairs.orderBy("d", "a", "b").limit(1).withColumnRenamed("d", "cost")
        step = cut(_merge_rows(chosen, groups, offset))
        steps.append(step.select("scope", "node", "up", "height"))
        moved = cut(groups.join(step.select("node", "up", "to"), "node", "left").withColumn("new", F.coalesce("to", "gid")))
        parts = moved.groupBy("new").agg(F.count("*").alias("parts"))
        names = cut(moved.select("gid", "new").join(parts, "new"))
        for c in ("a", "b"):
            pairs = pairs.join(names.select(F.col("gid").alias(c), F.col("new").alias(f"_{c}"), F.col("parts").alias(f"_n{c}")), c)
        joined = pairs.filter("_a <> _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), (F.col("_na") * F.col("_nb")).alias("_all"))
        pairs = cut(joined.agg(F.max("d").alias("d"), F.count("*").alias("_known")).filter("_known = _all").select("a", "b", "d"))
        members = cut(members.join(names.select("gid", "new"), "gid").select("id", "scope", "vec", F.col("new").alias("gid")))
        groups = cut(moved.groupBy(F.col("new").alias("gid"), F.coalesce("up", "node").alias("node"), "scope").agg(
            F.sum("w").alias("w"), F.min("beyond").alias("beyond")))

    def far(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        lg, rg, d, _ = _farthest(lp, rp)
        i, j = np.nonzero(lg[:, None] < rg[None, :])
        return pd.DataFrame({"gid": lg[i], "other": rg[j], "d": d[i, j]})

    # scopes that are still single items bring their vectors; others the distances of their last few groups
    alone = cut(groups.join(members.groupBy("scope").agg((F.count("*") == F.countDistinct("gid")).alias("alone")), "scope"))
    rest = members.join(alone.filter("not alone").select("scope").distinct(), "scope", "left_semi")
    blocked = cut(_blocked(rest))
    rows = bl.over_tiles(blocked, blocked, far, "gid long, other long, d double").groupBy("gid", "other").agg(F.max("d").alias("d"))
    rows = rows.groupBy("gid").agg(F.collect_list(F.struct(F.col("other").alias("gid"), "d")).alias("far"))
    vecs = members.join(alone.filter("alone").select("gid"), "gid", "left_semi").select("gid", "vec")
    return [*steps, _tail(alone.join(rows, "gid", "left").join(vecs, "gid", "left").withColumn("far", F.col("far").cast(_FAR)), "complete", offset)]


def _tail(groups: DataFrame, method: str, offset: int) -> DataFrame:
    """Merge the last groups of every scope; at most ``TAIL_GROUPS`` (``SUMMARY_TAIL``) rows reach a task.

    Summaries go on with rounds until all costs between the groups that are left can be kept.
    ``low`` is what a group's nearest costs at the least: a merge is no nearer to a group than its parts were, so it
    is looked up again only when it is the least of all and ``at`` no longer costs that.
    """
    most = SQUARE_TAIL

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid")
        gids, names, size, out = pdf["gid"].tolist(), pdf["node"].tolist(), pdf["w"].to_numpy(float).copy(), []
        if method == "complete" and not pdf["alone"].all():
            place = {g: i for i, g in enumerate(gids)}
            d = np.full((len(gids), len(gids)), np.inf)
            for i, row in enumerate(pdf["far"]):
                for c in row if row is not None else ():
                    d[i, place[c["gid"]]] = d[place[c["gid"]], i] = c["d"]
        else:
            x = bl.matrix(pdf["vec"])
            if method != "complete":
                x, size, names, out = _rounds(x, size, np.array(names), method, most, offset)
                names = names.tolist()
            d = np.empty((len(x), len(x)))
            for lo in range(0, len(x), TAIL_ROWS):
                part = slice(lo, lo + TAIL_ROWS)
                d[part] = np.round(bl.cosine(x[part], x), DIGITS) if method == "complete" else (WARD if method == "ward" else AVERAGE).value(x[part], size[part, None], x, size[None, :])
        np.fill_diagonal(d, np.inf)
        alive = np.ones(len(names), bool)
        at = d.argmin(axis=1)
        low = d[np.arange(len(names)), at]
        for _ in range(len(names) - 1):
            while d[i := int(low.argmin()), at[i]] != low[i]:
                at[i] = d[i].argmin()
                low[i] = d[i, at[i]]
            i, j = sorted((i, int(at[i])))
            up = names[i] + offset
            out += [(n, up, float(d[i, j])) for n in (names[i], names[j])]
            a, b, rest = size[i], size[j], size
            if method == "ward":
                new = np.sqrt(((a + rest) * d[i] ** 2 + (b + rest) * d[j] ** 2 - rest * d[i, j] ** 2) / (a + b + rest))
            elif method == "average":
                new = (a * d[i] + b * d[j]) / (a + b)
            else:
                new = np.maximum(d[i], d[j])
            new = np.round(new, DIGITS)
            alive[j] = False
            new[~alive] = np.inf
            new[i] = np.inf
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            nearer = (new < low) | ((new == low) & (i < at))
            low[nearer], at[nearer] = new[nearer], i
            at[i] = new.argmin()
            low[i], low[j] = new[at[i]], np.inf
            size[i], names[i] = a + b, up
        return pd.DataFrame(out, columns=["node", "up", "height"]).assign(scope=int(pdf["scope"].iloc[0]))

    return groups.groupBy("scope").applyInPandas(finish, "node long, up long, height double, scope int").select("scope", "node", "up", "height")


def _merge_rows(pairs: DataFrame, groups: DataFrame, offset: int) -> DataFrame:
    """``(scope, node, up, height, to)``: both parts of every merge, and the first item that names it."""
    first = groups.select(F.col("gid").alias("a"), (F.col("node") + offset).alias("up"))
    both = pairs.join(first, "a").select("a", "up", "cost", F.explode(F.array("a", "b")).alias("gid"))
    return both.join(groups.select("gid", "node", "scope"), "gid").select("scope", "node", "up", F.col("cost").alias("height"), F.col("a").alias("to"))


def _mutual_pairs(near: DataFrame) -> DataFrame:
    """Pairs of groups that are each other's nearest, once each."""
    a, b = near.alias("a"), near.alias("b")
    return a.join(b, (F.col("a.gid") == F.col("b.id")) & (F.col("b.gid") == F.col("a.id"))).filter("a.id < b.id").select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.cost").alias("cost"))


def find_roots(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Follow ``(keys, node, up)`` to the end by pointer doubling; a root points to itself.

    Two doublings per written table, so the rounds are half the logarithm of the longest path.
    """
    def double(p: DataFrame) -> DataFrame:
        on = F.col("a.up") == F.col("b.node")
        for k in keys:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return p.alias("a").join(p.alias("b"), on).select(
            *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.node").alias("node"), F.col("b.up").alias("up"),
            (F.col("a.up") != F.col("b.up")).alias("_moved"))

    p = cut(pointers.select(*keys, "node", "up"))
    while True:
        p = cut(double(double(p)))
        if not p.filter("_moved").take(1):
            return p.drop("_moved")
        p = p.drop("_moved")


def cut_tree(items: DataFrame, tree: DataFrame, ks: list[int]) -> DataFrame:
    """``(id, scope, k, cluster)`` for every requested number of clusters that the scope can have.

    Cutting at k undoes the k - 1 highest merges. Every item is followed once to the part that it is in when all
    merges any k undoes are undone; those few parts are followed to their roots for all k at once, and clusters
    are numbered by their smallest item.
    """
    scoped = items.select("id", (F.col("scope") if "scope" in items.columns else F.lit(0)).alias("scope"))
    sizes = scoped.groupBy("scope").agg(F.count("*").alias("n"))
    wanted = sizes.select("scope", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "n").filter("k <= n").select("scope", "k")
    merges = tree.groupBy("scope", "up").agg(F.max("height").alias("height"))
    top = merges.withColumn("rank", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("height"), F.desc("up")))).filter(
        F.col("rank") <= max(ks) - 1)
    links = cut(tree.join(top.select("scope", "up", "rank"), ["scope", "up"], "left").select("scope", "node", "up", "rank"))
    apex = merges.join(tree.select("scope", F.col("node").alias("up")), ["scope", "up"], "left_anti").select(
        "scope", F.col("up").alias("node"), F.col("up"), F.lit(0).alias("rank"))
    lone = scoped.join(tree.select("scope", F.col("node").alias("id")), ["scope", "id"], "left_anti").select(
        "scope", F.col("id").alias("node"), F.col("id").alias("up"), F.lit(0).alias("rank"))
    ends = cut(apex.unionByName(lone))
    below = links.select("scope", "node", F.when(F.col("rank").isNull(), F.col("up")).otherwise(F.col("node")).alias("up"))
    parts = find_roots(below.unionByName(ends.select("scope", "node", "up")), ["scope"])
    leaves = parts.join(scoped.withColumnRenamed("id", "node"), ["scope", "node"]).select("scope", F.col("node").alias("id"), F.col("up").alias("part"))
    upper = links.filter("rank is not null").unionByName(ends).join(wanted, "scope")
    cutting = F.when(F.col("rank") < F.col("k"), F.col("node")).otherwise(F.col("up"))
    roots = find_roots(upper.select("scope", "k", "node", cutting.alias("up")), ["scope", "k"])
    found = leaves.join(roots.select("scope", "k", F.col("node").alias("part"), F.col("up").alias("root")), ["scope", "part"])
    return _dense(found.select("id", "scope", "k", "root"), ["scope", "k"])


def _dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace roots by cluster numbers from 0, in the order of their smallest item."""
    lows = rows.groupBy(*keys, "root").agg(F.min("id").alias("low"))
    numbered = lows.withColumn("cluster", F.row_number().over(W.partitionBy(*keys).orderBy("low")) - 1)
    return rows.join(cut(numbered.drop("low")), [*keys, "root"]).drop("root")


def agglomerative(items: DataFrame, method: str, ks: list[int]) -> DataFrame:
    """``(id, scope, k, cluster)`` by ward (euclidean), average or complete (cosine) linkage."""
    return cut_tree(items, dendrogram(items, method), ks)
