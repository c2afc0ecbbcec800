"""Queries on the customer tree: roll-ups, ids, look-ups and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import text as tx
from coppice.operators import hierarchy as hi
from coppice.operators import report as rp
from workload.tables import RESULT, derive, plain, read


def result(spark, sf):
    return hi.with_paths(derive(spark, sf, RESULT))


def identified(spark, sf):
    return hi.assign_ids(result(spark, sf))


def summary(spark, sf):
    return hi.taxonomy_summary(result(spark, sf))


def tree(spark, sf):
    """The same customers with numbers for node names."""
    return read(spark, sf, "customer").join(
        read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("item_id"), F.col("n_regionkey").alias("l1"),
        F.when(F.col("n_regionkey") == 2, 0).otherwise(F.col("n_nationkey")).alias("l2"),
        F.when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(F.length("c_mktsegment")).cast("int").alias("l3"),
    )


TREE_SQL = """SELECT c_custkey AS item_id, n_regionkey AS l1,
  CASE WHEN n_regionkey = 2 THEN 0 ELSE n_nationkey END AS l2,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(length(c_mktsegment) AS INT) END AS l3
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def node_names(t):
    """A name and a summary for every node, as a naming model would return them."""
    paths = t.select("l1", "l2", "l3").distinct()
    null = F.lit(None).cast("int")
    one = paths.select(F.lit(1).alias("level"), "l1", null.alias("l2"), null.alias("l3")).distinct()
    two = paths.select(F.lit(2).alias("level"), "l1", "l2", null.alias("l3")).distinct()
    three = paths.filter("l3 is not null").select(F.lit(3).alias("level"), "l1", "l2", "l3")
    nodes = one.unionByName(two).unionByName(three)
    label = F.concat_ws("-", F.lit("N"), "l1", "l2", "l3")
    return nodes.withColumn("name", label).withColumn("summary", F.concat(F.lit("about "), label))


_R = f"""WITH r0 AS ({plain(RESULT)}), r AS (SELECT *,
  concat_ws(' / ', category_level_1, nullif(category_level_2, ''), nullif(category_level_3, '')) AS full_path,
  coalesce(nullif(category_level_3, ''), nullif(category_level_2, ''), category_level_1) AS leaf_category FROM r0),
n1 AS (SELECT category_level_1 a, count(*) n, row_number() OVER (ORDER BY count(*) DESC, category_level_1) r1 FROM r GROUP BY 1),
n2 AS (SELECT category_level_1 a, category_level_2 b, count(*) n,
  row_number() OVER (PARTITION BY category_level_1 ORDER BY count(*) DESC, category_level_2) r2
  FROM r WHERE category_level_2 <> '' GROUP BY 1, 2),
n3 AS (SELECT category_level_1 a, category_level_2 b, category_level_3 c, count(*) n,
  row_number() OVER (PARTITION BY category_level_1, category_level_2 ORDER BY count(*) DESC, category_level_3) r3
  FROM r WHERE category_level_3 <> '' GROUP BY 1, 2, 3),
ri AS (SELECT r.*, CASE WHEN c IS NOT NULL THEN concat(r1, '.', coalesce(r2, 0), '.', r3)
   WHEN n2.b IS NOT NULL THEN concat(r1, '.', r2) ELSE concat(r1) END AS full_numeric_id,
   r1, CASE WHEN c IS NOT NULL THEN coalesce(r2, 0) ELSE coalesce(r2, -1) END AS r2, coalesce(r3, -1) AS r3
  FROM r JOIN n1 ON category_level_1 = n1.a
  LEFT JOIN n2 ON category_level_1 = n2.a AND category_level_2 = n2.b
  LEFT JOIN n3 ON category_level_1 = n3.a AND category_level_2 = n3.b AND category_level_3 = n3.c),
s AS (SELECT concat(r1) AS id, a AS category, '-' AS parent, 1 AS level, n AS tech_count, '' AS summary, r1, -1 AS r2, -1 AS r3 FROM n1
  UNION ALL SELECT concat(r1, '.', r2), b, n2.a, 2, n2.n, '', r1, r2, -1 FROM n2 JOIN n1 ON n2.a = n1.a
  UNION ALL SELECT concat(r1, '.', coalesce(r2, 0), '.', r3), c, CASE WHEN n3.b = '' THEN n3.a ELSE n3.b END, 3, n3.n, '', r1, coalesce(r2, 0), r3
  FROM n3 JOIN n1 ON n3.a = n1.a LEFT JOIN n2 ON n3.a = n2.a AND n3.b = n2.b) """

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


register("taxonomy_summary", summary,
         _R + "SELECT id, category, parent, level, tech_count, summary FROM s")

register("assign_ids", lambda s, d: identified(s, d).select("item_id", "full_numeric_id", "leaf_category"),
         _R + "SELECT item_id, full_numeric_id, leaf_category FROM ri")

register("full_path", lambda s, d: result(s, d).select("item_id", "full_path", "leaf_category"),
         _R + "SELECT item_id, full_path, leaf_category FROM r")

register("summary_levels", lambda s, d: hi.summary_levels(result(s, d)), _R + """
SELECT 1 AS level, category_level_1 AS category, count(*) AS tech_count FROM r GROUP BY 2
UNION ALL SELECT 2, category_level_2, count(*) FROM r WHERE category_level_2 <> '' GROUP BY 2
UNION ALL SELECT 3, category_level_3, count(*) FROM r WHERE category_level_3 <> '' GROUP BY 2""")

register("leaf_kpis", lambda s, d: hi.leaf_kpis(result(s, d)).select(
    F.col("n_l1"), "n_leaves", F.round("mean_leaf", 6).alias("mean_leaf"), "median_leaf", "min_leaf", "max_leaf",
    "small_leaves", F.round("largest_l1_pct", 6).alias("largest_l1_pct"), "depth"), _R + """,
lf AS (SELECT leaf_category, count(*) AS size FROM r GROUP BY 1)
SELECT (SELECT count(DISTINCT category_level_1) FROM r) AS n_l1, count(*) AS n_leaves, round(avg(size), 6) AS mean_leaf,
  median(size) AS median_leaf, min(size) AS min_leaf, max(size) AS max_leaf,
  CAST(count(*) FILTER (size <= 3) AS BIGINT) AS small_leaves,
  round((SELECT max(n) * 100.0 / sum(n) FROM n1), 6) AS largest_l1_pct,
  CASE WHEN (SELECT count(*) FROM r WHERE category_level_3 <> '') > 0 THEN 3 ELSE 2 END AS depth FROM lf""")

register("leaf_size_histogram", lambda s, d: hi.leaf_size_histogram(result(s, d)), _R + """
SELECT size, count(*) AS n_leaves FROM (SELECT leaf_category, count(*) AS size FROM r GROUP BY 1) GROUP BY 1""")

register("sunburst_levels", lambda s, d: hi.sunburst_levels(result(s, d)), _R + """
SELECT category_level_1 AS "L1", coalesce(nullif(category_level_2, ''), category_level_1) AS "L2",
  coalesce(nullif(category_level_3, ''), leaf_category) AS "L3" FROM r""")

register("sunburst_counts", lambda s, d: hi.sunburst_counts(result(s, d)), _R + """
SELECT category_level_1 AS "L1", coalesce(nullif(category_level_2, ''), category_level_1) AS "L2",
  coalesce(nullif(category_level_3, ''), leaf_category) AS "L3", count(*) AS n FROM r GROUP BY ALL""")

register("filter_l1", lambda s, d: hi.filter_l1(result(s, d), ["ASIA", "EUROPE"]).select("item_id", "category_level_1"),
         _R + "SELECT item_id, category_level_1 FROM r WHERE category_level_1 IN ('ASIA', 'EUROPE')")

register("non_empty_levels", lambda s, d: hi.non_empty(result(s, d), "category_level_3").select("item_id", "category_level_3"),
         _R + "SELECT item_id, category_level_3 FROM r WHERE category_level_3 <> ''")

register("leaf_members", lambda s, d: hi.leaf_members(result(s, d), F.col("category_level_3") == "").select(
    "leaf_category", "position", "technology_name", "Technology_Description"), _R + """
SELECT leaf_category, row_number() OVER (PARTITION BY leaf_category ORDER BY item_id) AS position,
  technology_name, Technology_Description FROM r WHERE category_level_3 = ''""")

register("children_of", lambda s, d: hi.children_of(summary(s, d), "EUROPE").select(
    "position", "id", "category", "tech_count", "has_children"), _R + """
SELECT row_number() OVER (ORDER BY r1, r2, r3) AS position, id, category, tech_count,
  category IN (SELECT parent FROM s) AS has_children FROM s WHERE parent = 'EUROPE'""")

register("leaf_nodes", lambda s, d: hi.leaf_nodes(summary(s, d)).select("id", "category", "level"),
         _R + "SELECT id, category, level FROM s WHERE category NOT IN (SELECT parent FROM s)")

register("natural_sort", lambda s, d: hi.natural_order(summary(s, d), "id").select("position", "id"),
         _R + "SELECT row_number() OVER (ORDER BY r1, r2, r3) AS position, id FROM s")

register("display_projection", lambda s, d: hi.display_projection(identified(s, d)), _R + """
SELECT item_id, full_numeric_id, technology_name, category_level_1, category_level_2, category_level_3, leaf_category,
  row_number() OVER (ORDER BY r1, r2, r3, item_id) AS position FROM ri""")

register("preview", lambda s, d: hi.preview(result(s, d)).select("item_id", "technology_name"),
         _R + "SELECT item_id, technology_name FROM r ORDER BY item_id LIMIT 10")

register("first_per_key", lambda s, d: hi.first_per_key(
    result(s, d).select("item_id", "leaf_category", "full_path"), ["leaf_category"]), _R + """
SELECT leaf_category, item_id, full_path FROM r QUALIFY row_number() OVER (PARTITION BY leaf_category ORDER BY item_id) = 1""")

register("leaf_item_lists", lambda s, d: hi.leaf_item_lists(result(s, d), 25).select(
    "leaf_category", "part_no", "n", F.array_join("values", "|").alias("names")), _R + """
SELECT leaf_category, part_no, count(*) AS n, string_agg(technology_name, '|' ORDER BY item_id) AS names
FROM (SELECT *, (row_number() OVER (PARTITION BY leaf_category ORDER BY item_id) - 1) // 25 AS part_no FROM r)
GROUP BY 1, 2""")

register("overview_rows", lambda s, d: rp.overview_rows(identified(s, d)), _R + """,
m AS (SELECT concat('header_', level) AS row_kind, level AS k, id, concat(id, '  ', category) AS title, '' AS description,
   -1 AS item_id, r1, r2, r3 FROM s
 UNION ALL SELECT 'item', 9, full_numeric_id, technology_name, Technology_Description, item_id, r1, r2, r3 FROM ri)
SELECT row_number() OVER (ORDER BY r1, r2, r3, k, item_id) AS row_no, row_kind, id, title, description FROM m""")

register("leaf_palette", lambda s, d: rp.leaf_palette(identified(s, d)), _R + """
SELECT leaf_category, (row_number() OVER (ORDER BY min(r1), min(r2), min(r3)) - 1) % 20 AS colour
FROM ri GROUP BY leaf_category""")

register("batch_id", lambda s, d: rp.batch_ids(result(s, d).select("item_id"), ["item_id"], 10), _R + """
SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 10 AS batch_id,
  (row_number() OVER (ORDER BY item_id) - 1) % 10 + 1 AS batch_pos FROM r""")

register("tree_leaves", lambda s, d: hi.tree_leaves(tree(s, d)),
         f"SELECT l1, l2, l3, count(*) AS n FROM ({TREE_SQL}) GROUP BY ALL")

register("attach_names", lambda s, d: hi.attach_names(tree(s, d), node_names(tree(s, d))).select(
    "item_id", "category_level_1", "category_level_2", "category_level_3", "full_path", "leaf_category"), f"""
WITH t AS ({TREE_SQL}), k AS (SELECT l1, count(DISTINCT l2) n FROM t GROUP BY 1),
x AS (SELECT item_id, concat('N-', t.l1) AS category_level_1,
  CASE WHEN n > 1 THEN concat('N-', t.l1, '-', l2) ELSE '' END AS category_level_2,
  CASE WHEN l3 IS NULL THEN '' ELSE concat('N-', t.l1, '-', l2, '-', l3) END AS category_level_3 FROM t JOIN k ON t.l1 = k.l1)
SELECT *, concat_ws(' / ', category_level_1, nullif(category_level_2, ''), nullif(category_level_3, '')) AS full_path,
  coalesce(nullif(category_level_3, ''), nullif(category_level_2, ''), category_level_1) AS leaf_category FROM x""")

register("naming_order", lambda s, d: rp.naming_order(tree(s, d)), f"""
WITH t AS ({TREE_SQL}), p AS (SELECT l1, l2, l3, count(*) AS n FROM t GROUP BY ALL),
q AS (SELECT l1, l2, CAST(sum(n) AS BIGINT) AS n, count(l3) AS kids FROM p GROUP BY ALL),
w AS (SELECT 1 AS phase, 3 AS level, l1, l2, l3, n, 'items' AS source FROM p WHERE l3 IS NOT NULL
 UNION ALL SELECT CASE WHEN kids > 0 THEN 3 ELSE 2 END, 2, l1, l2, NULL, n, CASE WHEN kids > 0 THEN 'children' ELSE 'items' END FROM q
 UNION ALL SELECT 4, 1, l1, NULL, NULL, CAST(sum(n) AS BIGINT), CASE WHEN count(*) > 1 THEN 'children' ELSE 'items' END FROM q GROUP BY l1)
SELECT *, row_number() OVER (PARTITION BY phase ORDER BY CASE WHEN phase = 4 THEN -n ELSE 0 END, l1, l2, l3) AS position FROM w""")

register("parent_digest", lambda s, d: rp.parent_digest(
    node_names(tree(s, d)).filter("level = 3"), ["l1", "l2"], "l3"), f"""
WITH t AS (SELECT DISTINCT l1, l2, l3 FROM ({TREE_SQL}) WHERE l3 IS NOT NULL)
SELECT l1, l2, string_agg(concat('- N-', l1, '-', l2, '-', l3, ': about N-', l1, '-', l2, '-', l3), chr(10) ORDER BY l3) AS digest
FROM t GROUP BY l1, l2""")


def same_names(spark, sf):
    """The numbered tree with one name for all nodes below the first level."""
    t = tree(spark, sf)
    names = node_names(t).withColumn("name", F.when(F.col("level") == 1, F.col("name")).otherwise("Unnamed Group"))
    return hi.assign_ids(hi.attach_names(t, names))


register("assign_ids_same_names", lambda s, d: same_names(s, d).select("item_id", "full_numeric_id"), f"""WITH t AS ({TREE_SQL}),
s AS (SELECT l1, count(DISTINCT l2) > 1 AS split FROM t GROUP BY l1),
n1 AS (SELECT l1, row_number() OVER (ORDER BY count(*) DESC, CAST(l1 AS VARCHAR)) AS r1 FROM t GROUP BY l1),
n2 AS (SELECT t.l1, l2, row_number() OVER (PARTITION BY t.l1 ORDER BY count(*) DESC, CAST(l2 AS VARCHAR)) AS r2
  FROM t JOIN s ON t.l1 = s.l1 WHERE split GROUP BY t.l1, l2),
n3 AS (SELECT l1, l2, l3, row_number() OVER (PARTITION BY l1, l2 ORDER BY count(*) DESC, CAST(l3 AS VARCHAR)) AS r3
  FROM t WHERE l3 IS NOT NULL GROUP BY l1, l2, l3)
SELECT item_id, CASE WHEN t.l3 IS NOT NULL THEN concat(r1, '.', coalesce(r2, 0), '.', r3) WHEN r2 IS NOT NULL THEN concat(r1, '.', r2) ELSE concat(r1) END AS full_numeric_id
FROM t JOIN n1 ON t.l1 = n1.l1 LEFT JOIN n2 ON t.l1 = n2.l1 AND t.l2 = n2.l2 LEFT JOIN n3 ON t.l1 = n3.l1 AND t.l2 = n3.l2 AND t.l3 = n3.l3""")
