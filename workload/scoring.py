"""Queries on parts as tagged items: text, tags, tag metrics, scores and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.functions import tags as tg
from coppice.functions import text as tx
from coppice.operators import hierarchy as hi
from coppice.operators import report as rp
from coppice.operators import scores as sc
from coppice.operators import tag_metrics as tm
from coppice.sources import items as src
from workload.tables import ITEMS, derive, plain, read


def items(spark, sf):
    return derive(spark, sf, ITEMS)


def tagged(spark, sf, keep=("item_id", "brand", "cluster")):
    return tm.tag_columns(items(spark, sf), list(keep))


# Two labellings of the same parts, as two candidate clusterings.
def labelled(spark, sf):
    two = F.array(F.struct(F.lit("by-brand").alias("config_id"), F.col("cluster").alias("cluster")),
                  F.struct(F.lit("by-size").alias("config_id"), (F.col("item_id") % 7).cast("int").alias("cluster")))
    t = tagged(spark, sf)
    return t.select("item_id", F.explode(two).alias("c"), *cfg.TAG_METRICS).select("item_id", "c.*", *cfg.TAG_METRICS)


_I = f"""WITH i AS ({plain(ITEMS)}),
g AS (SELECT *,
 CASE WHEN Web_of_Science_Category IS NULL OR trim(Web_of_Science_Category) IN ('', 'nan', 'None') THEN NULL ELSE Web_of_Science_Category END AS wos,
 CASE WHEN OECD_Research_Area IS NULL OR trim(OECD_Research_Area) IN ('', 'nan', 'None') THEN NULL ELSE OECD_Research_Area END AS oecd,
 CASE WHEN trim(emerging_tech_concepts) IN ('', 'nan', 'None') THEN NULL ELSE emerging_tech_concepts END AS con,
 CASE WHEN trim(applied_domain) IN ('', 'nan', 'None') THEN NULL ELSE applied_domain END AS dom FROM i),
t AS (SELECT item_id, brand, cluster,
 coalesce(list_distinct(list_filter(list_transform(string_split(wos, ';'), lambda x: trim(x)), lambda x: x <> '')), []) AS wos_jaccard,
 coalesce(list_distinct(list_filter(list_transform(string_split(oecd, ';'), lambda x: trim(x)), lambda x: x <> '')), []) AS oecd_coherence,
 coalesce(list_distinct(list_filter(list_transform(string_split(trim(trim(con), '[]'), ','), lambda x: trim(trim(x), '''"')), lambda x: x <> '')), []) AS concept_coherence,
 coalesce(list_distinct(list_filter(list_transform(string_split(trim(trim(dom), '[]'), ','), lambda x: trim(trim(x), '''"')), lambda x: x <> '')), []) AS domain_overlap
 FROM g) """


def _brute(field, keys="cluster", src_table="t"):
    """Mean Jaccard by comparing every pair: a different computation from the one under test."""
    return f"""SELECT {keys}, avg(j) AS jaccard FROM (
 SELECT a.{keys.replace(', ', ', a.')}, len(list_intersect(a.{field}, b.{field}))::DOUBLE
   / (len(a.{field}) + len(b.{field}) - len(list_intersect(a.{field}, b.{field}))) AS j
 FROM {src_table} a JOIN {src_table} b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND a.item_id < b.item_id
 WHERE len(a.{field}) > 0 AND len(b.{field}) > 0) GROUP BY {keys}"""


QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _scan(spark, sf):
    """Write the derived items as CSV to the shared folder and scan them back."""
    path = src.write_csv(items(spark, sf).select("item_id", *cfg.ITEM_COLUMNS), "items")
    return src.scan_items(spark, path)


register("scan_items", _scan, f"""SELECT item_id, technology_name, Technology_Description,
 nullif(Web_of_Science_Category, '') AS Web_of_Science_Category, OECD_Research_Area, emerging_tech_concepts,
 nullif(applied_domain, '') AS applied_domain FROM ({plain(ITEMS)})""")



def _scan_permuted(spark, sf):
    """Items in another column order, with a further column and without an id, written as CSV and scanned back."""
    cols = [*reversed(cfg.ITEM_COLUMNS), "brand"]
    return src.scan_items(spark, src.write_csv(items(spark, sf).select(*cols), "permuted")).drop("item_id")


register("scan_items_by_name", _scan_permuted, f"""SELECT technology_name, Technology_Description,
 nullif(Web_of_Science_Category, '') AS Web_of_Science_Category, OECD_Research_Area, emerging_tech_concepts,
 nullif(applied_domain, '') AS applied_domain FROM ({plain(ITEMS)})""")

register("require_columns", lambda s, d: src.require_columns(items(s, d), cfg.ITEM_COLUMNS).select("item_id", *cfg.BROWSE_COLUMNS),
         f"SELECT item_id, technology_name, Technology_Description FROM ({plain(ITEMS)})")

register("compose_text", lambda s, d: items(s, d).select("item_id", tx.compose_text().alias("text")), _I + """
SELECT item_id, concat('Technology: ', technology_name, CASE WHEN wos IS NULL THEN '' ELSE concat('. Scientific domains: ', wos) END,
 CASE WHEN oecd IS NULL THEN '' ELSE concat('. Research areas: ', oecd) END, '. Description: ', coalesce(Technology_Description, '')) AS text FROM g""")

register("compose_variants", lambda s, d: tx.compose_variants(items(s, d)), _I + """,
f AS (SELECT item_id, concat('Technology: ', technology_name) n, concat('. Description: ', coalesce(Technology_Description, '')) d,
 concat('. Scientific domains: ', coalesce(wos, '')) w, concat('. Research areas: ', coalesce(oecd, '')) o,
 concat('. Concepts: ', coalesce(con, '')) c, concat('. Domains: ', coalesce(dom, '')) a FROM g)
SELECT item_id, 'v1' AS variant, concat(n, d) AS text FROM f UNION ALL SELECT item_id, 'v2', concat(n, w, d) FROM f
UNION ALL SELECT item_id, 'v3', concat(n, c, a, d) FROM f UNION ALL SELECT item_id, 'v4', concat(n, w, o, d) FROM f
UNION ALL SELECT item_id, 'v5', concat(n, w, o, c, a, d) FROM f""")

register("truncate_text", lambda s, d: read(s, d, "documents").select(
    "doc_id", tx.shorten(F.col("text"), cfg.EMBED_CHARS).alias("embedded"),
    tx.shorten(F.col("text"), cfg.SEARCH_CHARS, "…").alias("excerpt"), F.length("text").cast("long").alias("n_text")), """
SELECT doc_id, substr(text, 1, 2048) AS embedded,
 CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 300), '…') ELSE text END AS excerpt, length(text) AS n_text FROM documents""")

register("parse_semicolon", lambda s, d: tagged(s, d).select(
    "item_id", F.array_join(F.array_sort("wos_jaccard"), "|").alias("wos"), F.array_join(F.array_sort("oecd_coherence"), "|").alias("oecd")),
    _I + "SELECT item_id, array_to_string(list_sort(wos_jaccard), '|') AS wos, array_to_string(list_sort(oecd_coherence), '|') AS oecd FROM t")

register("parse_list", lambda s, d: tagged(s, d).select(
    "item_id", F.array_join(F.array_sort("concept_coherence"), "|").alias("concepts"), F.array_join(F.array_sort("domain_overlap"), "|").alias("domains")),
    _I + "SELECT item_id, array_to_string(list_sort(concept_coherence), '|') AS concepts, array_to_string(list_sort(domain_overlap), '|') AS domains FROM t")


def _algebra(s, d):
    sets = tg.set_algebra(F.col("wos_jaccard"), F.col("concept_coherence"))
    out = [F.array_join(F.array_sort(c), "|").alias(k) for k, c in sets.items() if k != "jaccard"]
    return tagged(s, d).select("item_id", *out, F.round(sets["jaccard"], 6).alias("jaccard"))


register("set_algebra", _algebra, _I + """, u AS (SELECT item_id, list_distinct(list_concat(wos_jaccard, concept_coherence)) AS un,
 list_intersect(wos_jaccard, concept_coherence) AS inn, list_filter(wos_jaccard, lambda x: NOT list_contains(concept_coherence, x)) AS di FROM t)
SELECT item_id, array_to_string(list_sort(un), '|') AS "union", array_to_string(list_sort(inn), '|') AS intersection,
 array_to_string(list_sort(di), '|') AS difference, round(CASE WHEN len(un) > 0 THEN len(inn) / len(un) ELSE 0.0 END, 6) AS jaccard FROM u""")

register("search_name", lambda s, d: hi.search_name(
    items(s, d).withColumn("full_path", F.col("brand")), "RED .*7$|small").select("technology_name", "full_path", "excerpt"), _I + """
SELECT technology_name, brand AS full_path, CASE WHEN length(Technology_Description) > 300
 THEN concat(substr(Technology_Description, 1, 300), '…') ELSE Technology_Description END AS excerpt
FROM i WHERE regexp_matches(technology_name, 'RED .*7$|small', 'i')""")

register("cluster_digest", lambda s, d: rp.cluster_digest(items(s, d), ["cluster"]), _I + """
SELECT cluster, string_agg(concat('- ', technology_name, ': ', substr(coalesce(Technology_Description, ''), 1, 150)), chr(10) ORDER BY item_id) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY item_id) rn FROM i) WHERE rn <= 30 GROUP BY cluster""")

register("pairwise_jaccard", lambda s, d: tm.pairwise_jaccard(tagged(s, d), ["cluster"], "wos_jaccard").select(
    "cluster", F.round("jaccard", 6).alias("jaccard")),
    _I + f"SELECT cluster, round(jaccard, 6) AS jaccard FROM ({_brute('wos_jaccard')})")

register("tag_pair_overlap", lambda s, d: tm.overlap_histogram(tagged(s, d), ["cluster"], "wos_jaccard").select(
    "cluster", "shared", "n_pairs", F.round("jaccard_sum", 6).alias("jaccard_sum")), _I + """
SELECT cluster, CAST(c AS INT) AS shared, count(*) AS n_pairs, round(sum(c / (a + b - c)), 6) AS jaccard_sum FROM (
 SELECT x.cluster, len(list_intersect(x.wos_jaccard, y.wos_jaccard)) c, len(x.wos_jaccard) a, len(y.wos_jaccard) b
 FROM t x JOIN t y ON x.cluster = y.cluster AND x.item_id < y.item_id) WHERE c > 0 GROUP BY ALL""")

register("concept_coherence", lambda s, d: tm.concept_coherence(tagged(s, d), ["cluster"], "concept_coherence").select(
    "cluster", "n", F.round("coherence", 6).alias("coherence")), _I + """,
e AS (SELECT cluster, unnest(concept_coherence) tag FROM t), c AS (SELECT cluster, tag, count(*) m FROM e GROUP BY ALL)
SELECT t.cluster, count(*) AS n, round(coalesce((SELECT max(m) FROM c WHERE c.cluster = t.cluster), 0) / count(*), 6) AS coherence
FROM t GROUP BY t.cluster""")

_LAB = """, lab AS (SELECT item_id, 'by-brand' AS config_id, cluster, wos_jaccard, oecd_coherence, concept_coherence, domain_overlap FROM t
 UNION ALL SELECT item_id, 'by-size', CAST(item_id % 7 AS INT), wos_jaccard, oecd_coherence, concept_coherence, domain_overlap FROM t),
sz AS (SELECT config_id, cluster, count(*) n FROM lab GROUP BY ALL)"""
_LABM = _LAB + "".join(
    f", m_{m} AS ({_brute(m, 'config_id, cluster', 'lab')})" for m in ("wos_jaccard", "oecd_coherence", "domain_overlap")) + """,
ce AS (SELECT config_id, cluster, unnest(concept_coherence) tag FROM lab), cc AS (SELECT config_id, cluster, tag, count(*) m FROM ce GROUP BY ALL),
cm AS (SELECT config_id, cluster, max(m) AS m FROM cc GROUP BY ALL),
tm AS (SELECT sz.config_id, sum(coalesce(w.jaccard, 0) * n) / sum(n) AS wos_jaccard, sum(coalesce(o.jaccard, 0) * n) / sum(n) AS oecd_coherence,
 sum(coalesce(d.jaccard, 0) * n) / sum(n) AS domain_overlap, sum(coalesce(cm.m, 0)) / sum(n) AS concept_coherence
 FROM sz LEFT JOIN m_wos_jaccard w USING (config_id, cluster) LEFT JOIN m_oecd_coherence o USING (config_id, cluster)
 LEFT JOIN m_domain_overlap d USING (config_id, cluster) LEFT JOIN cm USING (config_id, cluster) GROUP BY 1)"""

register("tag_metrics", lambda s, d: tm.tag_metrics(labelled(s, d), ["config_id"]).select(
    "config_id", *[F.round(m, 6).alias(m) for m in cfg.TAG_METRICS]), _I + _LABM + """
SELECT config_id, round(wos_jaccard, 6) AS wos_jaccard, round(oecd_coherence, 6) AS oecd_coherence,
 round(domain_overlap, 6) AS domain_overlap, round(concept_coherence, 6) AS concept_coherence FROM tm""")

register("cluster_sizes", lambda s, d: hi.cluster_sizes(labelled(s, d)).select(
    "config_id", "cluster", "size", "pct", F.col("size_rank")), _I + _LAB + """
SELECT config_id, cluster, n AS size, round(n * 100.0 / sum(n) OVER (PARTITION BY config_id), 1) AS pct,
 CAST(row_number() OVER (PARTITION BY config_id ORDER BY n DESC, cluster) AS INT) AS size_rank FROM sz""")

register("cluster_distribution", lambda s, d: hi.cluster_distribution(labelled(s, d)), _I + _LAB + """
SELECT config_id, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_items, round(max(n) * 100.0 / sum(n), 1) AS max_cluster_pct
FROM sz GROUP BY config_id""")


# Parts stand in for candidate configurations of their brand: size and price give their scores.
def candidates(spark, sf):
    p = read(spark, sf, "part")
    f = lambda e, m: (F.expr(e) % m) / F.lit(float(m))
    return p.select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("ord"),
        f("p_size", 11).alias("wos_jaccard"), f("p_size * 3", 13).alias("concept_coherence"),
        f("p_partkey", 17).alias("domain_overlap"), f("p_partkey * 7", 19).alias("oecd_coherence"),
        (f("p_partkey * 5", 23) - 0.3).alias("silhouette"), (f("p_size * 7", 29) * 5).alias("judge_coherence"),
    ).withColumn("stage1_score", F.round(sc.stage1_score(), 9)).withColumn("final_score", F.round(sc.final_score(), 9))


_C = """WITH c0 AS (SELECT p_brand AS grp, p_partkey AS ord, (p_size % 11) / 11.0::DOUBLE AS wos, (p_size * 3 % 13) / 13.0::DOUBLE AS con,
 (p_partkey % 17) / 17.0::DOUBLE AS dom, (p_partkey * 7 % 19) / 19.0::DOUBLE AS oecd, (p_partkey * 5 % 23) / 23.0::DOUBLE - 0.3::DOUBLE AS sil,
 (p_size * 7 % 29) / 29.0::DOUBLE * 5 AS jc FROM part),
c AS (SELECT grp, ord, round(0.30::DOUBLE * wos + 0.25::DOUBLE * con + 0.20::DOUBLE * dom + 0.15::DOUBLE * oecd + 0.10::DOUBLE * (sil + 1) / 2, 9) AS stage1_score,
 round(0.40::DOUBLE * jc / 5.0 + 0.20::DOUBLE * wos + 0.15::DOUBLE * con + 0.10::DOUBLE * dom + 0.10::DOUBLE * oecd + 0.05::DOUBLE * (sil + 1) / 2, 9) AS final_score FROM c0),
top AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY stage1_score DESC, ord) AS s1, FROM c QUALIFY s1 <= 20),
rr AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final_score DESC, stage1_score DESC, ord) AS fr FROM top) """


def finalists(spark, sf):
    short = sc.shortlist_per_group(candidates(spark, sf), ["grp"], cfg.SHORTLIST_GRID, "stage1_score", "ord")
    return sc.rerank(short.drop("stage1_rank"), ["grp"])


register("stage1_score", lambda s, d: candidates(s, d).select("ord", F.round("stage1_score", 6).alias("stage1_score")),
         _C + "SELECT ord, round(stage1_score, 6) AS stage1_score FROM c")
register("final_score", lambda s, d: candidates(s, d).select("ord", F.round("final_score", 6).alias("final_score")),
         _C + "SELECT ord, round(final_score, 6) AS final_score FROM c")
register("best_candidate", lambda s, d: sc.best_candidate(candidates(s, d), ["grp"], "stage1_score").select(
    "grp", "ord", F.round("stage1_score", 6).alias("stage1_score")),
    _C + "SELECT grp, ord, round(stage1_score, 6) AS stage1_score FROM top WHERE s1 = 1")
register("shortlist", lambda s, d: sc.shortlist(candidates(s, d), cfg.SHORTLIST_TREE).select("ord"),
         _C + "SELECT ord FROM c ORDER BY stage1_score DESC, ord LIMIT 10")
register("rerank", lambda s, d: finalists(s, d).select("grp", "ord", "stage1_rank", "final_rank", "moved_up"), _C + """
SELECT grp, ord, CAST(s1 AS INT) AS stage1_rank, CAST(fr AS INT) AS final_rank, CAST(s1 - fr AS INT) AS moved_up FROM rr""")
register("accept_attempt", lambda s, d: sc.accept_attempt(
    finalists(s, d).withColumn("quality", F.round(F.col("wos_jaccard") * 0.7, 6)), ["grp"]).select("grp", "ord", "final_rank", "accepted"),
    _C + """, q AS (SELECT rr.grp, rr.ord, fr, round(wos * 0.7::DOUBLE, 6) AS quality FROM rr JOIN c0 ON rr.ord = c0.ord WHERE fr <= 3)
SELECT grp, ord, CAST(fr AS INT) AS final_rank, quality >= 0.40 AS accepted FROM q
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY quality >= 0.40 DESC, CASE WHEN quality >= 0.40 THEN fr ELSE 0 END, quality DESC, fr) = 1""")
register("rank_correlation", lambda s, d: sc.rank_correlation(finalists(s, d), ["grp"], "stage1_score", "final_score").select(
    "grp", "n", F.round("spearman", 6).alias("spearman")), _C + """,
a AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY stage1_score) + (count(*) OVER (PARTITION BY grp, stage1_score) - 1) / 2 AS x,
 rank() OVER (PARTITION BY grp ORDER BY final_score) + (count(*) OVER (PARTITION BY grp, final_score) - 1) / 2 AS y FROM rr)
SELECT grp, count(*) AS n, round(corr(x, y), 6) AS spearman FROM a GROUP BY grp""")


# Ratings come from the parts themselves; every fourth cluster stays unrated.
def rated(spark, sf):
    lab = labelled(spark, sf)
    sizes = lab.groupBy("config_id", "cluster").agg(F.count("*").alias("n"))
    marks = lab.groupBy("config_id", "cluster").agg((F.sum("item_id") % 5 + 1).cast("int").alias("score")).filter(F.col("cluster") % 4 != 0)
    return sc.apply_judge(sizes, marks, ["config_id"])


_J = _I + _LAB + """, ra AS (SELECT config_id, cluster, count(*) AS n, sum(item_id) % 5 + 1 AS mark FROM lab GROUP BY ALL),
rt AS (SELECT config_id, cluster, n, CASE WHEN cluster % 4 = 0 THEN 3 ELSE mark END AS score FROM ra)"""
register("apply_judge", lambda s, d: rated(s, d).select("config_id", "cluster", "n", "score"),
         _J + "SELECT config_id, cluster, n, CAST(score AS INT) AS score FROM rt")
register("judge_coherence", lambda s, d: sc.judge_coherence(rated(s, d), ["config_id"]).select(
    "config_id", F.round("judge_coherence", 6).alias("judge_coherence")),
    _J + "SELECT config_id, round(sum(score * n) / sum(n), 6) AS judge_coherence FROM rt GROUP BY 1")


def type_sizes(spark, sf):
    p = read(spark, sf, "part")
    return p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


register("splittable_groups", lambda s, d: sc.splittable_groups(type_sizes(s, d)),
         "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 8")
register("valid_configs", lambda s, d: sc.valid_configs(type_sizes(s, d), sc.sweep_rows(cfg.L1_KS), ["p_brand", "p_type"]).select(
    "p_brand", "p_type", "algo", "size"), """
WITH g AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
k AS (SELECT a AS algo, CAST(k AS INT) AS size FROM (SELECT unnest(['kmeans', 'ward', 'gmm', 'birch', 'spectral']) a), (SELECT unnest(range(4, 13)) k)
 UNION ALL SELECT 'hdbscan', CAST(unnest([5, 8, 10, 15, 20]) AS INT))
SELECT p_brand, p_type, algo, size FROM g, k
WHERE CASE WHEN algo = 'hdbscan' THEN size < n // 2 ELSE size < n AND (algo <> 'spectral' OR n <= 200) END""")
register("accept_split", lambda s, d: sc.accept_split(
    items(s, d).select("item_id", "cluster", (F.col("cluster") % 3 * 0.05).alias("score")), cfg.L2_MIN_SCORE).select("item_id", "cluster"),
    _I + "SELECT item_id, CASE WHEN cluster % 3 * 0.05::DOUBLE >= 0.10 THEN cluster ELSE 0 END AS cluster FROM i")


# Every source of the documents table plays an embedding model, so the grid grows with the data.
def grid(spark, sf):
    return sc.grid_configs(read(spark, sf, "documents").select(F.col("source").alias("model")).distinct())


_G = """WITH cl AS (SELECT 'agglomerative' AS algo, m AS method, k AS size FROM (SELECT unnest(['ward', 'complete', 'average']) m), (SELECT unnest(range(3, 13)) k)
 UNION ALL SELECT a, NULL, k FROM (SELECT unnest(['kmeans', 'spectral']) a), (SELECT unnest(range(3, 13)) k)
 UNION ALL SELECT 'hdbscan', NULL, unnest([5, 8, 10, 15, 20, 25])),
g AS (SELECT model, variant, CASE algo WHEN 'agglomerative' THEN concat('agg-', method, '-k', size)
 WHEN 'hdbscan' THEN concat('hdbscan-ms', size) ELSE concat(algo, '-k', size) END AS cluster_algo
 FROM (SELECT DISTINCT source AS model FROM documents), (SELECT unnest(['v1', 'v2', 'v3', 'v4', 'v5']) AS variant), cl) """
register("config_grid", lambda s, d: grid(s, d).select("config_id", "model", "variant", "cluster_algo"),
         _G + "SELECT concat(model, '_', variant, '_', cluster_algo) AS config_id, model, variant, cluster_algo FROM g")
register("config_label", lambda s, d: grid(s, d).groupBy("cluster_algo").agg(F.count("*").alias("n")),
         _G + "SELECT cluster_algo, count(*) AS n FROM g GROUP BY 1")


def _union(spark, sf):
    """Three labellings of the parts in one candidate list, in generation order."""
    p = read(spark, sf, "part")
    ways = [("brand", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")), ("size", F.col("p_size") % 7), ("type", F.length("p_type"))]
    parts = [p.select(F.lit(i).alias("ord"), F.lit(n).alias("config_id"), F.col("p_partkey").alias("item_id"), c.alias("cluster")) for i, (n, c) in enumerate(ways)]
    return reduce(lambda a, b: a.unionByName(b), parts)


register("candidate_union", _union, """
SELECT 0 AS ord, 'brand' AS config_id, p_partkey AS item_id, CAST(replace(p_brand, 'Brand#', '') AS INT) AS cluster FROM part
UNION ALL SELECT 1, 'size', p_partkey, p_size % 7 FROM part UNION ALL SELECT 2, 'type', p_partkey, CAST(length(p_type) AS INT) FROM part""")
