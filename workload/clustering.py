"""Queries that cluster, repair, name and run the plans end to end.

Clusterings have no SQL counterpart; they are checked against brute force on small fixtures in
``tests``. The operators around them that SQL can express have their SQL here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions.text import compose_text, compose_variants
from coppice.operators import birch as bi
from coppice.operators import centers as ce
from coppice.operators import density as de
from coppice.operators import linkage as lk
from coppice.operators import naming as nm
from coppice.operators import repair as rp
from coppice.operators import report as rep
from coppice.operators import scores as sc
from coppice.operators import spectral as sp
from coppice.operators import sweep as sw
from coppice.operators import tag_metrics as tm
from coppice.plans import experiment, routes
from coppice.plans import tree as pt
from coppice.session import scratch_path
from coppice.sources import embeddings as em
from coppice.sources import sinks
from workload import hierarchy, routing, scoring, vectors
from workload.tables import read

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def points(spark, sf):
    return vectors.vectors(spark, sf).select(F.col("item_id").alias("id"), F.col("features").alias("vec"))


def grouped(spark, sf):
    """The vectors in three unequal scopes, one of them holding most of the table."""
    return points(spark, sf).withColumn("scope", F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 11 == 0, 2).otherwise(0))


register("kmeans", lambda s, d: ce.kmeans(points(s, d), 8, 3))
register("kmeans_sweep", lambda s, d: ce.kmeans_sweep(points(s, d), cfg.L1_KS))
register("kmeans_by_group", lambda s, d: ce.kmeans_sweep(grouped(s, d), cfg.L2_KS, 4))
register("ward", lambda s, d: lk.agglomerative(points(s, d), "ward", cfg.L1_KS))
register("average_linkage", lambda s, d: lk.agglomerative(points(s, d), "average", cfg.GRID_KS))
register("complete_linkage", lambda s, d: lk.agglomerative(points(s, d), "complete", cfg.GRID_KS))
register("gmm", lambda s, d: ce.gmm(points(s, d), 6, 2))
register("gmm_sweep", lambda s, d: ce.gmm_sweep(points(s, d), cfg.L1_KS))
register("birch", lambda s, d: bi.birch(points(s, d), cfg.L1_KS))
register("spectral", lambda s, d: sp.spectral_sweep(points(s, d), cfg.GRID_KS))
register("hdbscan", lambda s, d: de.hdbscan(points(s, d), cfg.SWEEP_MIN_SIZES))


def _noisy(spark, sf):
    """The given labels with every tenth item as noise, and a labelling that is noise only."""
    e = read(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 10 == 0, de.NOISE).otherwise(F.col("label"))
    both = F.array(F.struct(F.lit(5).alias("k"), label.alias("cluster")), F.struct(F.lit(8).alias("k"), F.lit(de.NOISE).alias("cluster")))
    return e.select(F.col("vec_id").alias("id"), F.lit(0).alias("scope"), F.explode(both).alias("c")).select("id", "scope", "c.*")


register("fold_noise", lambda s, d: de.fold_noise(points(s, d), _noisy(s, d)), """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
p AS (SELECT label, unnest(x) v, generate_subscripts(x, 1) i FROM e WHERE id % 10 <> 0), m AS (SELECT label, i, avg(v) v FROM p GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY i) c FROM m GROUP BY 1),
n AS (SELECT id, c.label FROM e, c WHERE id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(x, c), c.label) = 1)
SELECT id, 0 AS scope, 5 AS k, label AS cluster FROM e WHERE id % 10 <> 0 UNION ALL SELECT id, 0, 5, label FROM n""")


def vector_tree(spark, sf):
    """A tree over the vectors with small leaves: labels above, remainders below."""
    e = read(spark, sf, "embeddings")
    tiny = F.col("vec_id") % 19 == 0
    return e.select(
        F.col("vec_id").alias("item_id"), (F.col("label") % 4).alias("l1"), F.when(tiny, 100 + (F.col("vec_id") % 13).cast("int")).otherwise(F.col("label")).alias("l2"),
        F.when(~tiny & (F.col("label") < 4), (F.col("vec_id") % 23 % 5).cast("int")).alias("l3"))


_VT = """WITH t AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS x, label % 4 AS l1, CASE WHEN vec_id % 19 = 0 THEN CAST(100 + vec_id % 13 AS INT) ELSE label END AS l2,
 CASE WHEN vec_id % 19 <> 0 AND label < 4 THEN CAST(vec_id % 23 % 5 AS INT) END AS l3 FROM embeddings),
p AS (SELECT l1, l2, l3, unnest(x) v, generate_subscripts(x, 1) i FROM t), m AS (SELECT l1, l2, l3, i, avg(v) v FROM p GROUP BY ALL),
c AS (SELECT l1, l2, l3, list(v ORDER BY i) c FROM m GROUP BY ALL), z AS (SELECT l1, l2, l3, count(*) n FROM t GROUP BY ALL),
g AS (SELECT c.*, n, row_number() OVER (ORDER BY c.l1, c.l2, coalesce(c.l3, -1)) AS gid FROM c JOIN z ON c.l1 = z.l1 AND c.l2 = z.l2 AND c.l3 IS NOT DISTINCT FROM z.l3),
s AS (SELECT item_id, x, gid, 1 - list_cosine_similarity(x, c) AS d, median(1 - list_cosine_similarity(x, c)) OVER (PARTITION BY gid) AS med
 FROM t JOIN g ON t.l1 = g.l1 AND t.l2 = g.l2 AND t.l3 IS NOT DISTINCT FROM g.l3 WHERE n <= 3),
o AS (SELECT s.item_id, s.gid AS src, g.gid AS dst, s.d, 1 - list_cosine_similarity(s.x, g.c) AS nd FROM s, g
 WHERE s.d > 1.5 * s.med AND s.gid <> g.gid QUALIFY row_number() OVER (PARTITION BY s.item_id ORDER BY nd, g.gid) = 1) """
register("reassign_orphans", lambda s, d: rp.reassign_orphans(vector_tree(s, d), vectors.vectors(s, d))[0], _VT + """
SELECT t.item_id, coalesce(g.l1, t.l1) AS l1, coalesce(g.l2, t.l2) AS l2, CASE WHEN g.gid IS NULL THEN t.l3 ELSE g.l3 END AS l3
FROM t LEFT JOIN (SELECT * FROM o WHERE nd / d < 0.7) q ON t.item_id = q.item_id LEFT JOIN g ON q.dst = g.gid""")
register("merge_small_leaves", lambda s, d: rp.merge_small_leaves(vector_tree(s, d), vectors.vectors(s, d)))
register("consolidate_l1", lambda s, d: rp.consolidate_l1(vector_tree(s, d), vectors.vectors(s, d), 0.3)[0])


def _adoption(spark, sf):
    """Orphaned second-level groups of one first-level group, given to the next one."""
    t = vector_tree(spark, sf).select("l1", "l2").distinct()
    adopted = t.filter("l2 >= 100").withColumn("l1", (F.col("l1") + 1) % 4).distinct()
    return rp.next_child_ids(t.filter("l2 < 100"), adopted, "l1", "l2", ["l2"])


register("next_child_id", _adoption, _VT + """, u AS (SELECT DISTINCT l1, l2 FROM t), a AS (SELECT DISTINCT CAST((l1 + 1) % 4 AS INT) AS l1, l2 FROM u WHERE l2 >= 100)
SELECT a.l1, a.l2, CAST(coalesce(mx, -1) + row_number() OVER (PARTITION BY a.l1 ORDER BY a.l2) AS INT) AS new_id
FROM a LEFT JOIN (SELECT l1, max(l2) mx FROM u WHERE l2 < 100 GROUP BY 1) k ON a.l1 = k.l1""")


def part_items(spark, sf):
    """Parts with parsed tags and offline vectors."""
    return pt.prepared(scoring.items(spark, sf))


register("embed_items", lambda s, d: em.embed_items(scoring.items(s, d).select("item_id", compose_text().alias("text")), dims=64).select(
    "item_id", "features"))


def _cached(spark, sf):
    """Embed every document twice through the cache; only the texts that changed are embedded anew."""
    def length_model(texts):
        return [[float(len(t)), float(t.count(" ")), float(t.count(";"))] for t in texts]

    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    path = scratch_path(spark, "vectors")
    first = docs.withColumn("variant", F.lit("v1"))
    em.embed_missing(spark, first, path, "counts", length_model, max_chars=None)
    edited = first.withColumn("text", F.when(F.col("item_id") % 5 == 0, F.concat("text", F.lit("; more"))).otherwise(F.col("text")))
    got = em.embed_missing(spark, edited, path, "counts", length_model, max_chars=None)
    total = em._stored(spark, path).groupBy("item_id").agg(F.count("*").alias("kept"))
    return got.select("item_id", F.col("features")[0].alias("length"), F.col("features")[1].alias("spaces"), F.col("features")[2].alias("semicolons")).join(total, "item_id")


register("embed_missing", _cached, """
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, '; more') ELSE text END AS text FROM documents)
SELECT doc_id AS item_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
 CAST(length(text) - length(replace(text, ';', '')) AS DOUBLE) AS semicolons, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS kept FROM e""")


def vector_items(spark, sf):
    """The embeddings as items: their label makes the tags."""
    e = vectors.vectors(spark, sf).join(read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    text = F.concat(F.lit("label "), "label")
    return e.select(
        "item_id", "features", F.concat(F.lit("item "), "item_id").alias("technology_name"), text.alias("Technology_Description"),
        F.array(F.concat(F.lit("a"), F.col("label") % 3), F.concat(F.lit("b"), F.col("item_id") % 2)).alias("wos_jaccard"),
        F.array(F.concat(F.lit("c"), F.col("label") % 2)).alias("oecd_coherence"),
        F.array(F.concat(F.lit("d"), F.col("item_id") % 4)).alias("domain_overlap"),
        F.array(F.concat(F.lit("e"), F.col("label"))).alias("concept_coherence"))


def judge(members):
    """A repeatable judge: the rating follows from who is in the cluster."""
    return members.groupBy("ord", "cluster").agg((F.sum("item_id") % 5 + 1).cast("int").alias("score"))


register("candidate_sweep", lambda s, d: sw.candidate_sweep(vector_items(s, d), sc.sweep_rows(cfg.L1_KS), starts=4)[0])
register("pick_best", lambda s, d: sw.pick_best(vector_items(s, d), sc.sweep_rows([4, 6], [10]), starts=3)[0])
register("split_groups", lambda s, d: sw.split_groups(
    vector_items(s, d).withColumn("g", (F.col("item_id") % 3).cast("int")), "g", [2, 3], cfg.L2_MIN_SCORE, [10], starts=2))


def _quality(spark, sf):
    tree = vector_tree(spark, sf).select("item_id", "l1", "l2")
    q = sw.overall_quality(vector_items(spark, sf), tree)
    return tree.agg(F.count("*").alias("n"), F.round(F.lit(q), 6).alias("quality"))


register("overall_quality", _quality, _VT + """, lb AS (SELECT item_id, x, dense_rank() OVER (ORDER BY l1, l2) AS cl FROM t),
lz AS (SELECT cl, count(*) n FROM lb GROUP BY 1), e AS (SELECT vec_id, label FROM embeddings),
it AS (SELECT lb.*, ['a' || (label % 3), 'b' || (item_id % 2)] AS wos, ['c' || (label % 2)] AS oecd, ['d' || (item_id % 4)] AS dom, 'e' || label AS con FROM lb JOIN e ON vec_id = item_id),
pr AS (SELECT a.cl, avg(len(list_intersect(a.wos, b.wos)) / (4.0::DOUBLE - len(list_intersect(a.wos, b.wos)))) AS w,
 avg(CASE WHEN a.oecd = b.oecd THEN 1.0::DOUBLE ELSE 0 END) AS o, avg(CASE WHEN a.dom = b.dom THEN 1.0::DOUBLE ELSE 0 END) AS d FROM it a JOIN it b ON a.cl = b.cl AND a.item_id < b.item_id GROUP BY 1),
cn AS (SELECT cl, max(m) AS m FROM (SELECT cl, con, count(*) m FROM it GROUP BY ALL) GROUP BY 1),
tg AS (SELECT sum(coalesce(w, 0) * n) / sum(n) AS w, sum(coalesce(o, 0) * n) / sum(n) AS o, sum(coalesce(d, 0) * n) / sum(n) AS d, sum(cn.m) / sum(n) AS c
 FROM lz LEFT JOIN pr ON lz.cl = pr.cl JOIN cn ON lz.cl = cn.cl),
ds AS (SELECT a.item_id, a.cl, b.cl AS oc, sum(list_distance(a.x, b.x)) AS t FROM lb a, lb b WHERE a.item_id <> b.item_id GROUP BY ALL),
sv AS (SELECT lb.item_id, lz.n, (SELECT t / (lz.n - 1) FROM ds WHERE ds.item_id = lb.item_id AND oc = lb.cl) AS aa,
 (SELECT min(t / z2.n) FROM ds JOIN lz z2 ON z2.cl = oc WHERE ds.item_id = lb.item_id AND oc <> lb.cl) AS bb FROM lb JOIN lz ON lb.cl = lz.cl),
si AS (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (bb - aa) / greatest(aa, bb) END) AS s FROM sv)
SELECT (SELECT count(*) FROM t) AS n, round(0.3 * w + 0.25 * c + 0.2 * d + 0.15 * o + 0.1 * (s + 1) / 2, 6) AS quality FROM tg, si""")


def _judged(spark, sf):
    items = vector_items(spark, sf)
    assigned, _ = sw.candidate_sweep(items, [(a, None, k) for k in (4, 6, 8) for a in ("kmeans", "ward")], starts=2)
    assigned = sw.cut(assigned)
    short = sw.judged_shortlist(items, assigned, sw.score_candidates(items, assigned), 4, judge)
    return short.select("ord", "algo", "size", "stage1_score", "judge_coherence", "final_score", "stage1_rank", "final_rank")


register("judged_shortlist", _judged)


def _loop(spark, sf):
    labels, _, attempts = sw.correction_loop(vector_items(spark, sf), judge, [4, 6], [2, 3], [15], starts=2)
    best = attempts.agg(F.max("quality")).first()[0]
    return labels.groupBy("l1", "l2").agg(F.count("*").alias("n")).withColumn("quality", F.lit(best))


register("correction_loop", _loop)


def _built(spark, sf):
    """The whole plan on all parts with narrow ranges."""
    return pt.build_tree(scoring.items(spark, sf), judge=judge, ks=[4, 6], l2_ks=[2, 3], l3_ks=[2], min_sizes=[20], starts=2)


register("build_tree", lambda s, d: _built(s, d).summary)


def _named(spark, sf):
    t = hierarchy.tree(spark, sf)
    items = hierarchy.result(spark, sf).select("item_id", "technology_name", "Technology_Description")
    return nm.name_tree(t, items, lambda digests: [f"Group of {d.count(chr(10)) + 1} from {d[:24]}" for d in digests])


register("name_tree", _named)


def _written(spark, sf):
    """Write the three result tables of the customer tree and read the summary back."""
    result = hierarchy.identified(spark, sf)
    summary = hierarchy.hi.natural_order(hierarchy.summary(spark, sf), "id")
    out = sinks.write_tables({"items": result, "summary": summary, "overview": rep.overview_rows(result)}, scratch_path(spark, "results"))
    return spark.read.parquet(out["summary"]).select("position", "id", "category", "tech_count")


register("write_results", _written, hierarchy._R + """
SELECT row_number() OVER (ORDER BY r1, r2, r3) AS position, id, category, tech_count FROM s""")


def _winner(spark, sf):
    """The better of two given labellings of the parts by tag score, item by item."""
    lab = scoring.labelled(spark, sf)
    scored = tm.tag_metrics(lab, ["config_id"]).withColumn("z", F.lit(0)).withColumn(
        "ord", F.when(F.col("config_id") == "by-brand", 0).otherwise(1))
    best = sc.best_candidate(scored, ["z"], "wos_jaccard").first()["config_id"]
    return experiment.winner_details(scoring.items(spark, sf), lab.select("config_id", "item_id", "cluster"), best)


register("winner_details", _winner, scoring._I + scoring._LABM + """, b AS (SELECT config_id FROM tm ORDER BY wos_jaccard DESC LIMIT 1)
SELECT i.item_id, technology_name, Web_of_Science_Category, lab.cluster FROM i JOIN lab ON i.item_id = lab.item_id WHERE config_id = (SELECT config_id FROM b)""")


def _grid(spark, sf):
    """Two text variants of all parts, the offline vectors, a spread of clusterings."""
    items = scoring.items(spark, sf)
    texts = compose_variants(items, ["v1", "v4"])
    made = None
    for v in ("v1", "v4"):
        part = em.embed_items(texts.filter(F.col("variant") == v), dims=128).select("item_id", F.lit("offline").alias("model"), "variant", "features")
        made = part if made is None else made.unionByName(part)
    configs = [("agglomerative", "ward", 4), ("agglomerative", "average", 4), ("kmeans", None, 4), ("kmeans", None, 8), ("spectral", None, 4), ("hdbscan", None, 25)]
    return experiment.grid_experiment(items, sw.cut(made), judge, configs, top=6, starts=2)


register("grid_experiment", lambda s, d: _grid(s, d).results)


def _experiment_tables(spark, sf):
    items = scoring.items(spark, sf)
    made = em.embed_items(compose_variants(items, ["v4"]), dims=64).select("item_id", F.lit("offline").alias("model"), "variant", "features")
    grid = experiment.grid_experiment(items, sw.cut(made), judge, [("kmeans", None, 4), ("agglomerative", "ward", 5), ("kmeans", None, 7)], top=2, starts=2)
    out = grid.write(scratch_path(spark, "grid"))
    return spark.read.parquet(out["finalists"])


register("write_experiment", _experiment_tables)


def _routed(spark, sf):
    result = routing.result(spark, sf)
    return routes.route(result, routing.leaves(spark, sf), routing.ro.last_flags(routing.derive(spark, sf, routing.FLAGS))).review


register("route_documents", lambda s, d: _routed(s, d).select("domain", "sub_domain", "item_id", "item_flag", "cross_relevance"),
         routing._L + "SELECT domain, sub_domain, item_id, item_flag, cross_relevance FROM rv")
