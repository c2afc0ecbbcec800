"""Queries on the embeddings table: centroids, distances and separation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import vectors as vx
from coppice.operators import vector_metrics as vm
from workload.tables import read


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), vx.as_doubles(F.col("embedding")).alias("features"))


def assignments(spark, sf):
    """Two labellings: the given one, and one with a dominant group and one-item groups."""
    e = read(spark, sf, "embeddings")
    odd = F.when(F.col("vec_id") % 100 == 7, F.col("vec_id").cast("int")).when(F.col("vec_id") % 3 == 0, 0).otherwise(F.col("label") % 4 + 1)
    both = F.array(F.struct(F.lit("given").alias("config_id"), F.col("label").alias("cluster")),
                   F.struct(F.lit("skewed").alias("config_id"), odd.alias("cluster")))
    return e.select(F.col("vec_id").alias("item_id"), F.explode(both).alias("c")).select("item_id", "c.*")


def groups(spark, sf):
    labelled = vectors(spark, sf).join(assignments(spark, sf).filter("config_id = 'given'"), "item_id")
    return vm.centroids(labelled, ["cluster"]).select(F.col("cluster").cast("long").alias("gid"), F.col("centroid").alias("vec"), "n")


_E = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
a AS (SELECT id, x, 'given' AS config_id, label AS cluster FROM e UNION ALL
 SELECT id, x, 'skewed', CASE WHEN id % 100 = 7 THEN CAST(id AS INT) WHEN id % 3 = 0 THEN 0 ELSE label % 4 + 1 END FROM e),
p AS (SELECT config_id, cluster, unnest(x) v, generate_subscripts(x, 1) i FROM a),
m AS (SELECT config_id, cluster, i, avg(v) v FROM p GROUP BY ALL),
c AS (SELECT config_id, cluster, list(v ORDER BY i) AS c FROM m GROUP BY ALL),
z AS (SELECT config_id, cluster, count(*) AS n FROM a GROUP BY ALL) """

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _cents(s, d):
    labelled = vectors(s, d).join(assignments(s, d), "item_id")
    return vm.centroids(labelled, ["config_id", "cluster"]).select(
        "config_id", "cluster", "n", F.posexplode("centroid").alias("pos", "v")).select(
        "config_id", "cluster", "n", "pos", F.round("v", 6).alias("v"))


register("centroids", _cents, _E + """SELECT m.config_id, m.cluster, n, CAST(i - 1 AS INT) AS pos, round(v, 6) AS v
FROM m JOIN z ON m.config_id = z.config_id AND m.cluster = z.cluster""")

register("median_distance", lambda s, d: vm.median_distance(
    vectors(s, d).join(assignments(s, d), "item_id"), ["config_id", "cluster"]).select(
    "config_id", "cluster", "n", F.round("median_distance", 6).alias("median_distance")), _E + """
SELECT a.config_id, a.cluster, count(*) AS n, round(median(1 - list_cosine_similarity(x, c)), 6) AS median_distance
FROM a JOIN c ON a.config_id = c.config_id AND a.cluster = c.cluster GROUP BY ALL""")


def _nearest(s, d, metric):
    e = vectors(s, d).join(assignments(s, d).filter("config_id = 'given'"), "item_id")
    rows = e.select(F.col("item_id").alias("id"), F.col("features").alias("vec"), F.col("cluster").cast("long").alias("own"))
    return vm.nearest_centroid(rows, groups(s, d), metric).select(F.col("id").alias("item_id"), "gid", F.round("cost", 6).alias("cost"))


_N = _E + """SELECT id AS item_id, CAST(b AS BIGINT) AS gid, round(d, 6) AS cost FROM (
SELECT a.id, c.cluster AS b, {} AS d FROM a JOIN c ON a.config_id = 'given' AND c.config_id = 'given' AND a.cluster <> c.cluster)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, b) = 1"""
register("nearest_centroid", lambda s, d: _nearest(s, d, "euclidean"), _N.format("list_distance(x, c)"))
register("nearest_centroid_cosine", lambda s, d: _nearest(s, d, "cosine"), _N.format("1 - list_cosine_similarity(x, c)"))

register("centroid_pairs", lambda s, d: vm.closest_groups(groups(s, d).select("gid", "vec")).select(
    "gid", "other", F.round("similarity", 6).alias("similarity")), _E + """
SELECT CAST(g AS BIGINT) AS gid, CAST(o AS BIGINT) AS other, round(s, 6) AS similarity FROM (
 SELECT x.cluster AS g, y.cluster AS o, list_cosine_similarity(x.c, y.c) AS s FROM c x JOIN c y
 ON x.config_id = 'given' AND y.config_id = 'given' AND x.cluster <> y.cluster)
QUALIFY row_number() OVER (PARTITION BY g ORDER BY s DESC, o) = 1""")

register("sibling_pairs", lambda s, d: vm.closest_groups(
    groups(s, d).select("gid", "vec", (F.col("gid") % 3).alias("scope"))).select(
    "gid", "other", F.round("similarity", 6).alias("similarity")), _E + """
SELECT CAST(g AS BIGINT) AS gid, CAST(o AS BIGINT) AS other, round(s, 6) AS similarity FROM (
 SELECT x.cluster AS g, y.cluster AS o, list_cosine_similarity(x.c, y.c) AS s FROM c x JOIN c y
 ON x.config_id = 'given' AND y.config_id = 'given' AND x.cluster <> y.cluster AND x.cluster % 3 = y.cluster % 3)
QUALIFY row_number() OVER (PARTITION BY g ORDER BY s DESC, o) = 1""")

_SIL = _E + """, d AS (SELECT e.id, a.config_id, a.cluster AS other, sum({}) AS t FROM e, a WHERE e.id <> a.id GROUP BY ALL),
v AS (SELECT a.id, a.config_id, z.n, (SELECT t / (z.n - 1) FROM d WHERE d.id = a.id AND d.config_id = a.config_id AND d.other = a.cluster) AS aa,
 (SELECT min(d.t / zo.n) FROM d JOIN z zo ON d.config_id = zo.config_id AND d.other = zo.cluster
  WHERE d.id = a.id AND d.config_id = a.config_id AND d.other <> a.cluster) AS bb
 FROM a JOIN z ON a.config_id = z.config_id AND a.cluster = z.cluster),
s AS (SELECT id, config_id, CASE WHEN n = 1 THEN 0 ELSE (bb - aa) / greatest(aa, bb) END AS s FROM v)
"""
register("silhouette_exact", lambda s, d: vm.silhouette_exact(vectors(s, d), assignments(s, d), 256).select(
    "config_id", F.round("silhouette", 6).alias("silhouette")),
    _SIL.format("list_distance(e.x, a.x)") + "SELECT config_id, round(avg(s), 6) AS silhouette FROM s GROUP BY 1")
register("silhouette_values", lambda s, d: vm.silhouette_values(vectors(s, d), assignments(s, d)).select(
    "item_id", "config_id", F.round("s", 6).alias("s")),
    _SIL.format("list_distance(e.x, a.x)") + "SELECT id AS item_id, config_id, round(s, 6) AS s FROM s")
register("silhouette_fast", lambda s, d: vm.silhouette_fast(vectors(s, d), assignments(s, d)).select(
    "config_id", F.round("silhouette", 6).alias("silhouette")),
    _SIL.format("list_distance(e.x, a.x) ** 2") + "SELECT config_id, round(avg(s), 6) AS silhouette FROM s GROUP BY 1")

register("calinski_harabasz", lambda s, d: vm.calinski_harabasz(vectors(s, d), assignments(s, d)).select(
    "config_id", F.round("calinski_harabasz", 6).alias("calinski_harabasz")), _E + """,
w AS (SELECT a.config_id, sum(list_distance(x, c) ** 2) AS w FROM a JOIN c ON a.config_id = c.config_id AND a.cluster = c.cluster GROUP BY 1),
mu AS (SELECT config_id, list(v ORDER BY i) AS mu FROM (SELECT config_id, i, avg(v) v FROM p GROUP BY ALL) GROUP BY 1),
b AS (SELECT c.config_id, sum(n * list_distance(c, mu) ** 2) AS b, count(*) AS k, sum(n) AS n FROM c
 JOIN z ON c.config_id = z.config_id AND c.cluster = z.cluster JOIN mu ON c.config_id = mu.config_id GROUP BY 1)
SELECT b.config_id, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b JOIN w ON b.config_id = w.config_id""")

register("davies_bouldin", lambda s, d: vm.davies_bouldin(vectors(s, d), assignments(s, d)).select(
    "config_id", F.round("davies_bouldin", 6).alias("davies_bouldin")), _E + """,
sp AS (SELECT a.config_id, a.cluster, avg(list_distance(x, c)) AS s, any_value(c) AS c FROM a
 JOIN c ON a.config_id = c.config_id AND a.cluster = c.cluster GROUP BY ALL),
r AS (SELECT x.config_id, x.cluster, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sp x JOIN sp y
 ON x.config_id = y.config_id AND x.cluster <> y.cluster GROUP BY ALL)
SELECT config_id, round(avg(r), 6) AS davies_bouldin FROM r GROUP BY 1""")
