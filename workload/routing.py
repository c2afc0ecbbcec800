"""Queries that route documents: a document's source is its leaf, labels are its flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import text as tx
from coppice.operators import report as rp
from coppice.operators import routing as ro
from coppice.session import scratch_path
from coppice.sources import sinks
from workload import hierarchy
from workload.tables import derive, plain, read

RESULT = """
SELECT doc_id AS item_id, concat('doc ', doc_id % 400) AS technology_name, text AS Technology_Description,
       concat('G', CAST(substr(source, 4) AS INT) % 3) AS category_level_1, source AS category_level_2, '' AS category_level_3,
       source AS leaf_category, concat('G', CAST(substr(source, 4) AS INT) % 3, ' / ', source) AS full_path
FROM {documents}
"""

# One row per leaf: plain, same-domain alternative, bridge, missing, blank and padded domains.
LEAVES = """
SELECT source AS leaf_category,
  CASE WHEN k = 13 THEN ' ' WHEN k = 14 THEN NULL WHEN k % 4 = 0 THEN concat(' Domain ', k % 4, ' ')
       WHEN k = 9 THEN 'Domian 1' ELSE concat('Domain ', k % 4) END AS primary_domain,
  CASE WHEN k % 5 = 4 THEN '' ELSE concat('sub ', k % 3) END AS primary_sub_domain,
  CASE WHEN k % 6 = 1 THEN concat('Domain ', k % 4) WHEN k % 6 = 2 THEN concat('Domain ', (k + 1) % 4)
       WHEN k % 6 = 3 THEN 'Domian 1' WHEN k % 6 = 5 THEN '' ELSE NULL END AS secondary_domain,
  CASE WHEN k % 6 IN (1, 2) AND k % 4 <> 1 THEN concat('sub ', k % 5) ELSE NULL END AS secondary_sub_domain,
  concat('because of ', n, ' items') AS reasoning,
  CASE WHEN k % 7 = 3 THEN ' Mixed ' WHEN k % 7 = 5 THEN 'diverse' WHEN k % 7 = 6 THEN 'banana' ELSE 'tight' END AS group_status
FROM (SELECT source, CAST(substr(source, 4) AS INT) AS k, count(*) AS n FROM {documents} GROUP BY source)
WHERE k <> 7
"""

FLAGS = """
SELECT source AS leaf_category, concat('doc ', doc_id % 400) AS name, doc_id AS ord,
  CASE WHEN toxic = 1 THEN 'red' ELSE 'yellow' END AS level
FROM (SELECT d.source, d.doc_id, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 0 OR l.toxic = 1)
"""


def result(spark, sf):
    return derive(spark, sf, RESULT)


def aliases(spark, sf):
    """Observed misspellings of the domains that the leaves really name."""
    wrong = derive(spark, sf, LEAVES).select(F.trim("primary_domain").alias("variant")).filter("variant like 'Domian%'")
    return wrong.distinct().withColumn("canonical", F.replace("variant", F.lit("Domian"), F.lit("Domain")))


def known(spark, sf):
    return derive(spark, sf, LEAVES).select(F.trim("primary_domain").alias("domain")).filter("domain like 'Domain%'").distinct()


def leaves(spark, sf):
    raw = derive(spark, sf, LEAVES)
    flags = F.array().cast("array<struct<name:string,level:string>>")
    return ro.normalize_flags(ro.normalize_domain(raw, aliases(spark, sf), known(spark, sf)).withColumn("anomalies", flags))


def flags(spark, sf):
    """Flags of unmixed leaves, the last per item name."""
    mixed = leaves(spark, sf).filter("group_status = 'mixed'").select("leaf_category")
    return ro.last_flags(derive(spark, sf, FLAGS)).join(mixed, "leaf_category", "left_anti")


def flagged(spark, sf):
    return ro.attach_item_flags(ro.attach_domains(result(spark, sf), leaves(spark, sf)), flags(spark, sf))


def routed(spark, sf):
    return ro.route_rows(flagged(spark, sf))


def review(spark, sf):
    return ro.review_table(routed(spark, sf))


_L = f"""WITH raw AS ({plain(LEAVES)}),
lv AS (SELECT leaf_category, replace(CASE WHEN primary_domain = '' THEN '' ELSE trim(primary_domain) END, 'Domian', 'Domain') AS primary_domain, primary_sub_domain,
 replace(trim(secondary_domain), 'Domian', 'Domain') AS secondary_domain, secondary_sub_domain, reasoning,
 CASE WHEN lower(trim(group_status)) IN ('tight', 'diverse', 'mixed') THEN lower(trim(group_status)) ELSE 'tight' END AS group_status FROM raw),
r AS ({plain(RESULT)}), f0 AS ({plain(FLAGS)}),
fl AS (SELECT leaf_category, name, level FROM f0 WHERE leaf_category NOT IN (SELECT leaf_category FROM lv WHERE group_status = 'mixed')
 QUALIFY row_number() OVER (PARTITION BY leaf_category, name ORDER BY ord DESC) = 1),
d AS (SELECT r.*, CASE WHEN lv.leaf_category IS NULL THEN 'לא מסווג' ELSE primary_domain END AS prim,
 coalesce(primary_sub_domain, '') AS psub, nullif(trim(secondary_domain), '') AS sec, coalesce(secondary_sub_domain, '') AS ssub
 FROM r LEFT JOIN lv ON r.leaf_category = lv.leaf_category
 WHERE lv.leaf_category IS NULL OR (primary_domain IS NOT NULL AND trim(primary_domain) <> '')),
df AS (SELECT d.*, CASE fl.level WHEN 'red' THEN '⛔ טכנולוגיה לא מתאימה בקבוצה (לבדוק ולשייך ידנית לבודק)'
  WHEN 'yellow' THEN '⚠️ טכנולוגיה חריגה בקבוצה (אותו בודק)' ELSE '' END AS item_flag
 FROM d LEFT JOIN fl ON d.leaf_category = fl.leaf_category AND d.technology_name = fl.name),
rt AS (SELECT *, prim AS domain, psub AS sub_domain, false AS is_referral, CASE WHEN sec = prim THEN ssub ELSE '' END AS alt_sub_domain,
  CASE WHEN sec <> prim THEN CASE WHEN ssub <> '' THEN concat(sec, ' / ', ssub) ELSE sec END ELSE '' END AS cross_relevance FROM df
 UNION ALL SELECT *, sec, ssub, true, '', concat('↪ הבית הראשי: ', prim, CASE WHEN psub <> '' THEN concat(' / ', psub) ELSE '' END) FROM df WHERE sec <> prim),
rv AS (SELECT *, coalesce(nullif(sub_domain, ''), psub) AS shown_sub FROM rt),
bk AS (SELECT domain, sub_domain, leaf_category, min(shown_sub) AS shown_sub FROM rv GROUP BY ALL),
b1 AS (SELECT *, lag(shown_sub) OVER w AS prev, row_number() OVER w AS rn FROM bk WINDOW w AS (PARTITION BY domain ORDER BY sub_domain, leaf_category)),
b2 AS (SELECT *, CASE WHEN rn = 1 OR shown_sub <> prev THEN 1 ELSE 0 END AS new_sub FROM b1),
b3 AS (SELECT *, sum(new_sub) OVER (PARTITION BY domain ORDER BY sub_domain, leaf_category) AS run FROM b2),
b4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain, run ORDER BY sub_domain, leaf_category) + 1 AS INT) % 2 AS band FROM b3) """

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


register("normalize_domain", lambda s, d: ro.normalize_domain(derive(s, d, LEAVES), aliases(s, d), known(s, d)).select(
    "leaf_category", "primary_domain", "secondary_domain", F.col("primary_domain_known").alias("is_known_domain")), _L + """
SELECT leaf_category, primary_domain, secondary_domain, coalesce(primary_domain LIKE 'Domain%', false) AS is_known_domain FROM lv""")

# against a list that lacks one of the domains
register("unknown_domains", lambda s, d: ro.unknown_domains(ro.normalize_domain(derive(s, d, LEAVES), aliases(s, d), known(s, d).filter("domain <> 'Domain 1'"))), _L + """
SELECT primary_domain AS domain, 'primary_domain' AS role, leaf_category FROM lv WHERE trim(primary_domain) <> '' AND (primary_domain = 'Domain 1' OR primary_domain NOT LIKE 'Domain%')
UNION ALL SELECT secondary_domain, 'secondary_domain', leaf_category FROM lv WHERE trim(secondary_domain) <> '' AND (secondary_domain = 'Domain 1' OR secondary_domain NOT LIKE 'Domain%')""")

register("normalize_flags", lambda s, d: leaves(s, d).select("leaf_category", "group_status"),
         _L + "SELECT leaf_category, group_status FROM lv")

register("suppress_mixed", lambda s, d: flags(s, d), _L + "SELECT leaf_category, name, level FROM fl")

register("unassigned_leaves", lambda s, d: ro.unassigned_leaves(result(s, d), leaves(s, d)),
         _L + "SELECT DISTINCT leaf_category FROM r WHERE leaf_category NOT IN (SELECT leaf_category FROM lv)")

register("attach_domains", lambda s, d: ro.attach_domains(result(s, d), leaves(s, d)).select(
    "item_id", "primary_domain", "primary_sub_domain", "secondary_domain", "secondary_sub_domain"), _L + """
SELECT item_id, prim AS primary_domain, psub AS primary_sub_domain, sec AS secondary_domain, ssub AS secondary_sub_domain FROM d""")

register("attach_item_flags", lambda s, d: flagged(s, d).select("item_id", "item_flag"), _L + "SELECT item_id, item_flag FROM df")

register("item_flag_label", lambda s, d: flags(s, d).groupBy(ro.item_flag_label(F.col("level")).alias("label")).agg(F.count("*").alias("n")),
         _L + """SELECT CASE level WHEN 'red' THEN '⛔ טכנולוגיה לא מתאימה בקבוצה (לבדוק ולשייך ידנית לבודק)'
 ELSE '⚠️ טכנולוגיה חריגה בקבוצה (אותו בודק)' END AS label, count(*) AS n FROM fl GROUP BY 1""")

register("route_home", lambda s, d: ro.route_home(flagged(s, d)).select("item_id", "domain", "sub_domain", "alt_sub_domain", "cross_relevance"),
         _L + "SELECT item_id, domain, sub_domain, alt_sub_domain, cross_relevance FROM rv WHERE NOT is_referral")

register("route_referral", lambda s, d: ro.route_referral(flagged(s, d)).select("item_id", "domain", "shown_sub", "cross_relevance"),
         _L + "SELECT item_id, domain, shown_sub, cross_relevance FROM rv WHERE is_referral")

register("home_and_referral", lambda s, d: routed(s, d).groupBy("domain", "is_referral").agg(F.count("*").alias("n")),
         _L + "SELECT domain, is_referral, count(*) AS n FROM rv GROUP BY ALL")

register("relation_note", lambda s, d: routed(s, d).groupBy("domain", "leaf_category", "cross_relevance", "alt_sub_domain").agg(F.count("*").alias("n")),
         _L + "SELECT domain, leaf_category, cross_relevance, alt_sub_domain, count(*) AS n FROM rv GROUP BY ALL")

_REVIEW_SQL = """SELECT domain, sub_domain, shown_sub, is_referral, item_id, technology_name, Technology_Description, category_level_1, category_level_2,
 category_level_3, leaf_category, alt_sub_domain, cross_relevance, item_flag, '' AS answer_exists, '' AS answer_name, '' AS answer_notes, '' AS answer_local"""
register("review_table", review, _L + _REVIEW_SQL + " FROM rv")

register("review_order", lambda s, d: ro.review_order(review(s, d)).select("domain", "position", "item_id"), _L + """
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY sub_domain, leaf_category, technology_name, item_id) AS position, item_id FROM rv""")

register("band_toggle", lambda s, d: ro.band_toggle(review(s, d)), _L + "SELECT domain, sub_domain, leaf_category, band FROM b4")

_ROWS = """, x AS (
 SELECT domain, sub_domain, leaf_category, 'spacer' AS row_kind, 0 AS k, '' AS text, '' AS nm, -1 AS item_id, NULL AS band FROM b4 WHERE new_sub = 1 AND rn > 1
 UNION ALL SELECT domain, sub_domain, leaf_category, 'sub_domain', 1, concat('📂  ', shown_sub), '', -1, NULL FROM b4 WHERE new_sub = 1
 UNION ALL SELECT domain, sub_domain, leaf_category, 'separator', 2, '', '', -1, NULL FROM b4 WHERE rn > 1
 UNION ALL SELECT domain, sub_domain, leaf_category, 'banner', 3, '⛔ קבוצה מעורבת — לבדוק ולשייך ידנית לבודקים', '', -1, NULL FROM b4
  WHERE leaf_category IN (SELECT leaf_category FROM lv WHERE group_status = 'mixed')
 UNION ALL SELECT rv.domain, rv.sub_domain, rv.leaf_category, CASE WHEN is_referral THEN 'referral' ELSE 'item' END, 9, technology_name, technology_name, item_id, band
  FROM rv JOIN b4 ON rv.domain = b4.domain AND rv.sub_domain = b4.sub_domain AND rv.leaf_category = b4.leaf_category)
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY sub_domain, leaf_category, k, nm, item_id) AS row_no, row_kind, text, leaf_category, band FROM x"""
register("report_rows", lambda s, d: ro.review_rows(review(s, d), leaves(s, d)), _L + _ROWS)

register("mixed_banner", lambda s, d: ro.review_rows(review(s, d), leaves(s, d)).filter("row_kind = 'banner'").select("domain", "leaf_category", "text"),
         _L + """SELECT domain, leaf_category, '⛔ קבוצה מעורבת — לבדוק ולשייך ידנית לבודקים' AS text FROM b4
 WHERE leaf_category IN (SELECT leaf_category FROM lv WHERE group_status = 'mixed')""")

register("flag_counts", lambda s, d: ro.flag_counts(leaves(s, d), flags(s, d)), _L + """
SELECT lv.leaf_category, group_status, CAST(count(*) FILTER (level = 'yellow') AS BIGINT) AS n_yellow, CAST(count(*) FILTER (level = 'red') AS BIGINT) AS n_red
FROM lv LEFT JOIN fl ON lv.leaf_category = fl.leaf_category GROUP BY ALL""")

_SUMMARY = _L + """, n AS (SELECT domain, leaf_category, count(*) AS n_items FROM rv GROUP BY ALL),
s0 AS (SELECT n.*, primary_domain AS p, coalesce(primary_sub_domain, '') AS ps, nullif(trim(secondary_domain), '') AS sc, coalesce(secondary_sub_domain, '') AS ss,
 coalesce(reasoning, '') AS reasoning, group_status FROM n LEFT JOIN lv ON n.leaf_category = lv.leaf_category),
s1 AS (SELECT *, coalesce(sc <> p AND domain = sc, false) AS away FROM s0),
s2 AS (SELECT *, CASE WHEN away THEN concat('↪ הבית הראשי: ', p, CASE WHEN ps <> '' THEN concat(' / ', ps) ELSE '' END)
  WHEN sc = p THEN concat('תת-תחום חלופי', CASE WHEN ss <> '' THEN concat(': ', ss) ELSE '' END)
  WHEN sc IS NOT NULL THEN concat('רלוונטי גם ל: ', sc, CASE WHEN ss <> '' THEN concat(' / ', ss) ELSE '' END) ELSE '' END AS note0 FROM s1),
sm AS (SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY n_items DESC, leaf_category) AS INT) AS position,
 CASE WHEN group_status = 'mixed' THEN concat('⛔ ', leaf_category) ELSE leaf_category END AS leaf_label,
 CASE WHEN away THEN ss ELSE ps END AS sub_domain, n_items,
 CASE WHEN group_status = 'mixed' THEN concat('⛔ קבוצה מעורבת — לבדוק ולשייך ידנית לבודקים', CASE WHEN note0 <> '' THEN concat(' · ', note0) ELSE '' END) ELSE note0 END AS note,
 reasoning FROM s2)
SELECT * FROM sm"""
register("domain_leaf_summary", lambda s, d: ro.domain_leaf_summary(routed(s, d), leaves(s, d)), _SUMMARY)


def _files(spark, sf):
    """Write the reviewer tables to the shared folder and read the item table back."""
    rows = ro.review_order(review(spark, sf))
    out = sinks.write_review_files(rows, ro.domain_leaf_summary(routed(spark, sf), leaves(spark, sf)), scratch_path(spark, "review"), rows_per_file=300)
    return spark.read.parquet(out["items"]).select("domain", "position", "item_id", "technology_name", "item_flag")


register("write_review_files", _files, _L + """SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY sub_domain, leaf_category, technology_name, item_id) AS position,
 item_id, technology_name, item_flag FROM rv""")


def _context(spark, sf, chunk=20):
    summary = hierarchy.hi.taxonomy_summary(result(spark, sf)).withColumn(
        "summary", F.when(F.col("tech_count") % 2 == 0, F.repeat(F.concat(F.col("category"), F.lit(" is a group. ")), 30)).otherwise(""))
    return ro.leaf_context(result(spark, sf), summary, chunk)


_CTX = f"""WITH r AS ({plain(RESULT)}), c AS (SELECT leaf_category, count(*) AS n,
 CASE WHEN count(*) % 2 = 0 THEN repeat(concat(leaf_category, ' is a group. '), 30) ELSE '' END AS summary, any_value(full_path) AS full_path FROM r GROUP BY 1),
p AS (SELECT leaf_category, (row_number() OVER (PARTITION BY leaf_category ORDER BY item_id) - 1) // 20 AS part_no, item_id, technology_name FROM r),
q AS (SELECT leaf_category, part_no, count(*) AS n, string_agg(technology_name, ', ' ORDER BY item_id) AS names FROM p GROUP BY ALL)
"""
register("leaf_context", lambda s, d: _context(s, d).select("leaf_category", "full_path", "summary", "part_no", "n", F.array_join("names", ", ").alias("names")),
         _CTX + "SELECT c.leaf_category, full_path, summary, part_no, q.n, names FROM c JOIN q ON c.leaf_category = q.leaf_category")
register("leaf_prompt_rows", lambda s, d: ro.leaf_prompt_rows(_context(s, d)), _CTX + """, b AS (SELECT *, row_number() OVER (ORDER BY leaf_category) - 1 AS i FROM c)
SELECT i // 7 AS batch_id, i % 7 + 1 AS batch_pos, b.leaf_category, part_no, concat(i % 7 + 1, '. Group: ', b.leaf_category, chr(10), '   Path: ', full_path,
 CASE WHEN summary <> '' THEN concat(chr(10), '   About: ', substr(summary, 1, 400)) ELSE '' END, chr(10), '   Members: ', names) AS prompt
FROM b JOIN q ON b.leaf_category = q.leaf_category""")

# Review replies in every shape a model returns, one per document.
_OBJ = """concat('{"group_status": "', st, '", "majority_theme": "about ', source, '", "anomalies": [{"name": "doc ', doc_id, '", "level": "', lv, '"}, "odd ', lang, '", " "]}')"""
REPLIES = f"""
SELECT doc_id, CASE sh WHEN 0 THEN {_OBJ} WHEN 1 THEN concat('```json\n', {_OBJ}, '\n```') WHEN 2 THEN concat({_OBJ}, ' That is my view of ', lang, '.')
  WHEN 3 THEN concat('Here you go: ', {_OBJ}, ' ')
  WHEN 4 THEN concat('{{"group_status": "', st, '" "majority_theme": "x", "anomalies": [{{"name": "doc ', doc_id, '", "level": "', lv, '"}}]}}')
  WHEN 5 THEN '  ' WHEN 6 THEN concat('I cannot judge ', source) WHEN 7 THEN concat('[', {_OBJ}, ']')
  WHEN 8 THEN concat('{{"group_status": "', st, '", "anomalies": [{{"name": "doc ', doc_id, '", "level": "', lv, '"}}, {{"name": "cut')
  ELSE concat('{{"majority_theme": "t", "anomalies": ["doc ', doc_id, '"]}}') END AS raw
FROM (SELECT doc_id, lang, source, doc_id % 10 AS sh, CASE doc_id % 4 WHEN 0 THEN 'tight' WHEN 1 THEN 'Diverse' WHEN 2 THEN 'mixed' ELSE 'unsure' END AS st,
  CASE WHEN n_chars % 3 = 0 THEN 'red' WHEN n_chars % 3 = 1 THEN 'yellow' ELSE 'orange' END AS lv FROM {{documents}})
"""


def _flat(c):
    return F.array_join(F.transform(c, lambda a: F.concat_ws("=", a["name"], a["level"])), "; ")


register("parse_flags", lambda s, d: ro.parse_flags(derive(s, d, REPLIES)).select(
    "doc_id", "parse_step", "group_status", "majority_theme", _flat("anomalies").alias("flags")), """
WITH b AS (SELECT doc_id, lang, source, doc_id % 10 AS sh, CASE doc_id % 4 WHEN 1 THEN 'diverse' WHEN 2 THEN 'mixed' ELSE 'tight' END AS st,
 CASE WHEN n_chars % 3 = 0 THEN 'red' ELSE 'yellow' END AS lv FROM documents)
SELECT doc_id, CASE WHEN sh IN (0, 1, 2, 9) THEN 'object' WHEN sh = 3 THEN 'block' WHEN sh IN (4, 8) THEN 'salvage' ELSE 'empty' END AS parse_step,
 CASE WHEN sh IN (5, 6, 7, 9) THEN 'tight' ELSE st END AS group_status,
 CASE WHEN sh < 4 THEN concat('about ', source) WHEN sh = 9 THEN 't' ELSE '' END AS majority_theme,
 CASE WHEN sh = 9 THEN concat('doc ', doc_id, '=yellow') WHEN sh IN (5, 6, 7) OR st = 'mixed' THEN ''
  WHEN sh < 4 THEN concat('doc ', doc_id, '=', lv, '; odd ', lang, '=yellow') ELSE concat('doc ', doc_id, '=', lv) END AS flags FROM b""")

ASSIGN_REPLIES = """
SELECT doc_id AS batch_id, CASE doc_id % 5 WHEN 4 THEN concat('Sorry, no answer for ', source)
  WHEN 3 THEN concat('{"assignments": [{"leaf_category": "', source, '" ') ELSE concat(CASE doc_id % 5 WHEN 1 THEN '```json\n' WHEN 2 THEN 'Sure: ' ELSE '' END,
  '{"assignments": [{"leaf_category": "', source, '", "primary": {"domain": "D', doc_id % 4, '", "sub_domain": "s', n_chars % 7, '"}',
  CASE WHEN doc_id % 2 = 0 THEN concat(', "secondary": {"domain": "D', doc_id % 3, '", "sub_domain": "t"}, "reasoning": "', lang, '"') ELSE ', "secondary": null' END,
  '}, {"leaf_category": "', source, ' ', lang, '", "primary": {"domain": "D1", "sub_domain": "x"}}]}', CASE doc_id % 5 WHEN 1 THEN '\n```' ELSE '' END) END AS raw
FROM {documents}
"""
register("parse_assignments", lambda s, d: ro.parse_assignments(derive(s, d, ASSIGN_REPLIES))[0].drop("anomalies"), """
WITH g AS (SELECT * FROM documents WHERE doc_id % 5 < 3),
x AS (SELECT doc_id, 0 AS pos, source AS leaf_category, concat('D', doc_id % 4) AS primary_domain, concat('s', n_chars % 7) AS primary_sub_domain,
  CASE WHEN doc_id % 2 = 0 THEN concat('D', doc_id % 3) END AS secondary_domain, CASE WHEN doc_id % 2 = 0 THEN 't' END AS secondary_sub_domain,
  CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS reasoning FROM g
 UNION ALL SELECT doc_id, 1, concat(source, ' ', lang), 'D1', 'x', NULL, NULL, '' FROM g)
SELECT leaf_category, primary_domain, primary_sub_domain, secondary_domain, secondary_sub_domain, reasoning, 'tight' AS group_status FROM x
QUALIFY row_number() OVER (PARTITION BY leaf_category ORDER BY doc_id DESC, pos DESC) = 1""")
register("quarantined_replies", lambda s, d: ro.parse_assignments(derive(s, d, ASSIGN_REPLIES))[1].select("batch_id"),
         "SELECT doc_id AS batch_id FROM documents WHERE doc_id % 5 >= 3")

# Naming replies and the audit of the names in them, from the conversations.
NAMES = """
SELECT conv_id * 1000 + turn AS node_id, conv_id % 40 AS parent_id,
  concat(CASE WHEN turn % 3 = 0 THEN 'Advanced ' WHEN turn % 3 = 1 THEN 'Next-Gen ' ELSE '' END, upper(substr(role, 1, 1)), substr(role, 2), ' Storage ', conv_id % 7) AS name,
  CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN concat('User Storage ', conv_id % 7) ELSE 'Energy storage and use' END AS parent_name
FROM {conversations}
"""
register("name_guard_audit", lambda s, d: rp.name_guard_audit(derive(s, d, NAMES)), f"""
WITH n AS ({plain(NAMES)}), w AS (SELECT *, list_distinct(string_split(lower(name), ' ')) AS ws, list_filter(string_split(lower(coalesce(parent_name, '')), ' '), lambda x: length(x) > 3) AS pw FROM n)
SELECT node_id, name, array_to_string(list_sort(list_filter(ws, lambda x: x IN ('advanced', 'next-gen'))), ' ') AS generic_words,
 count(*) OVER (PARTITION BY parent_id, lower(name)) > 1 AS shared_with_sibling,
 array_to_string(list_sort(list_filter(ws, lambda x: list_contains(pw, x))), ' ') AS parent_words, coalesce(lower(name) = lower(parent_name), false) AS equals_parent FROM w""")

NAME_REPLIES = """
SELECT conv_id * 1000 + turn AS node_id, CASE turn % 4 WHEN 0 THEN concat(' "Category Name: ', role, ' ', conv_id, '" ') WHEN 1 THEN concat('Category:', role) WHEN 2 THEN '' ELSE role END AS plain,
  CASE turn % 4 WHEN 0 THEN concat('```json\n{"cluster_name": " \\\\"', role, '\\\\" ", "summary": " sum ', conv_id, ' "}\n```') WHEN 1 THEN concat('{"cluster_name": "', role, '"}')
   WHEN 2 THEN 'no json' ELSE '{"summary": "only"}' END AS reply
FROM {conversations}
"""
register("clean_name", lambda s, d: derive(s, d, NAME_REPLIES).select(
    "node_id", tx.clean_name(F.col("plain")).alias("plain_name"), tx.named_reply(F.col("reply")).alias("r")).select(
    "node_id", "plain_name", F.col("r.cluster_name").alias("cluster_name"), F.col("r.summary").alias("summary")), """
SELECT conv_id * 1000 + turn AS node_id, CASE turn % 4 WHEN 0 THEN concat(role, ' ', conv_id) WHEN 2 THEN 'Unnamed Group' ELSE role END AS plain_name,
 CASE WHEN turn % 4 IN (0, 1) THEN role ELSE 'Unnamed Group' END AS cluster_name,
 CASE turn % 4 WHEN 0 THEN concat('sum ', conv_id) WHEN 3 THEN 'only' ELSE '' END AS summary FROM conversations""")
