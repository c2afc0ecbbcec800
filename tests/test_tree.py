"""Ids, reports, repair and the plans on small fixtures."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coppice import settings as cfg
from coppice.functions import text as tx
from coppice.operators import hierarchy as hi
from coppice.operators import naming as nm
from coppice.operators import repair as rp
from coppice.plans import tree as pt
from coppice.session import number_rows
from coppice.sources import embeddings as em
from coppice.operators import vector_metrics as vm
from coppice.sources import items as src
from workload import clustering, hierarchy, scoring

LEVELS = "item_id long, technology_name string, Technology_Description string, category_level_1 string, category_level_2 string, category_level_3 string"


def test_number_rows_matches_a_window(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("x"), "id")
    got = number_rows(df, ["x", "id"], "n", within=["g"]).toPandas().sort_values(["g", "x", "id"])
    assert (got.groupby("g").cumcount() + 1 == got["n"]).all()
    whole = number_rows(df, ["id"], "n").toPandas()
    assert (whole["n"] == whole["id"] + 1).all()


def test_natural_order_of_ids(spark):
    ids = ["10", "2", "1.10", "1.2", "1"]
    got = hi.natural_order(spark.createDataFrame([(i,) for i in ids], "id string"), "id").orderBy("position")
    assert [r["id"] for r in got.collect()] == ["1", "1.2", "1.10", "2", "10"]


def test_ids_and_summary_are_consistent(spark, sf):
    result = hierarchy.identified(spark, sf)
    assert result.filter("full_numeric_id is null").count() == 0
    summary = hi.taxonomy_summary(result).toPandas()
    assert summary["id"].is_unique and summary["tech_count"].sum() > 0
    for _, row in summary[summary["level"] < 3].iterrows():
        below = summary[(summary["parent"] == row["category"]) & (summary["level"] > row["level"])]
        assert below["tech_count"].sum() <= row["tech_count"]
    assert summary[summary["level"] == 1]["tech_count"].sum() == result.count()


def test_third_level_without_second_has_its_own_id(spark):
    rows = [(i, f"t{i}", "", "A", "", "x" if i < 2 else "") for i in range(5)]
    got = hi.assign_ids(spark.createDataFrame(rows, LEVELS))
    assert {(r["category_level_3"], r["full_numeric_id"]) for r in got.collect()} == {("x", "1.0.1"), ("", "1")}


def test_equal_sibling_names_are_two_nodes(spark):
    rows = [(i, 0, i % 2, None) for i in range(5)]
    tree = spark.createDataFrame(rows, "item_id long, l1 int, l2 int, l3 int")
    names = spark.createDataFrame([(1, 0, None, None, "A", "top"), (2, 0, 0, None, cfg.UNNAMED, "s0"), (2, 0, 1, None, cfg.UNNAMED, "s1")], "level int, l1 int, l2 int, l3 int, name string, summary string")
    items = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "item_id long, technology_name string")
    out = pt.result_tables(items, tree, names, None, None)
    assert {(r["item_id"], r["full_numeric_id"]) for r in out.result.collect()} == {(0, "1.1"), (1, "1.2"), (2, "1.1"), (3, "1.2"), (4, "1.1")}
    assert {(r["id"], r["tech_count"], r["summary"]) for r in out.summary.collect()} == {("1", 5, "top"), ("1.1", 3, "s0"), ("1.2", 2, "s1")}


def test_texts(spark):
    df = spark.createDataFrame([("n", "d", None, "nan", "['a']", "x"), ("m", None, "w", "o", "", "None")], ", ".join(f"{c} string" for c in cfg.ITEM_COLUMNS))
    rows = [r[0] for r in df.select(tx.compose_text()).collect()]
    assert rows == ["Technology: n. Description: d", "Technology: m. Scientific domains: w. Research areas: o. Description: "]
    v3 = [r["text"] for r in tx.compose_variants(df.withColumn("item_id", F.lit(1)), ["v3"]).collect()]
    assert v3 == ["Technology: n. Concepts: ['a']. Domains: x. Description: d", "Technology: m. Concepts: . Domains: . Description: "]


def test_name_cleaning(spark):
    raw = [('"Category Name: Salt Stores"',), ("Category: X ",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(raw, "r string").select(tx.clean_name(F.col("r"))).collect()] == ["Salt Stores", "X", cfg.UNNAMED, cfg.UNNAMED]
    js = [('```json\n{"cluster_name": "\\"A\\"", "summary": " s "}\n```',), ("oops",)]
    got = [tuple(r[0]) for r in spark.createDataFrame(js, "r string").select(tx.named_reply(F.col("r"))).collect()]
    assert got == [("A", "s"), (cfg.UNNAMED, "")]


def test_missing_columns_are_listed(spark, tmp_path):
    with pytest.raises(src.MissingColumns) as e:
        src.require_columns(spark.createDataFrame([(1,)], "technology_name int"), cfg.ITEM_COLUMNS)
    assert e.value.missing == cfg.ITEM_COLUMNS[1:]
    (tmp_path / "a.csv").write_text('item_id,technology_name,Technology_Description\n1,"a, b","say ""hi""\nthere"\n')
    row = src.scan_items(spark, str(tmp_path / "a.csv"), schema="item_id long, technology_name string, Technology_Description string", line_breaks=True).first()
    assert (row[1], row[2]) == ("a, b", 'say "hi"\nthere')


def test_scan_by_header_name(spark, tmp_path):
    rows = 'extra,Technology_Description,technology_name\nx,about a,a\ny,about b,b\nz,about a,a\n'
    (tmp_path / "b.csv").write_text(rows)
    (tmp_path / "c.csv").write_text("extra,Technology_Description,technology_name\n" + "\n".join(rows.splitlines()[:0:-1]) + "\n")
    got = src.scan_items(spark, str(tmp_path / "b.csv")).collect()
    assert sorted((r.technology_name, r.Technology_Description) for r in got) == [("a", "about a"), ("a", "about a"), ("b", "about b")]
    assert len({r.item_id for r in got}) == 3
    assert {r.item_id for r in got} == {r.item_id for r in src.scan_items(spark, str(tmp_path / "c.csv")).collect()}
    (tmp_path / "d.csv").write_text("item_id,name\n1,a\n")
    with pytest.raises(src.MissingColumns):
        src.scan_items(spark, str(tmp_path / "d.csv"))


def test_silhouette_kind_does_not_follow_the_size(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(3, 1, (30, 3))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.vstack([x, rng.normal(0, 1, (5200, 3))]))]
    vec = spark.createDataFrame(rows, "item_id long, features array<double>")
    lab = spark.createDataFrame([(i, "a", i // 30) for i in range(60)] + [(60 + i, "b", i % 2) for i in range(5200)], "item_id long, config_id string, cluster int")
    alone = {r.config_id: r for r in vm.silhouette(vec.filter("item_id < 60"), lab.filter("config_id = 'a'")).collect()}["a"]
    beside = {r.config_id: r for r in vm.silhouette(vec, lab).collect()}["a"]
    assert alone.silhouette_kind == beside.silhouette_kind == "euclidean" and abs(alone.silhouette - beside.silhouette) < 1e-12


def grown(spark, spec):
    rng, tree, vec = np.random.default_rng(3), [], []
    for l1, l2, l3, centre, n in spec:
        for _ in range(n):
            tree.append((len(tree), l1, l2, l3))
            vec.append((len(vec), [float(v) for v in np.array(centre, float) + rng.normal(size=4) * 0.02]))
    return (spark.createDataFrame(tree, "item_id long, l1 int, l2 int, l3 int"),
            spark.createDataFrame(vec, "item_id long, features array<double>"))


def sizes(tree):
    return {(r["l1"], r["l2"], r["l3"]): r["n"] for r in hi.tree_leaves(tree).collect()}


def test_small_leaves_merge_into_siblings(spark):
    tree, vec = grown(spark, [
        (0, 0, 0, [1, 0, 0, 0], 5), (0, 0, 1, [1, .2, 0, 0], 2), (0, 0, 2, [.2, 1, 0, 0], 4), (0, 1, None, [0, 0, 1, 0], 6), (0, 2, None, [1, .1, 0, .1], 1),
        (1, 0, 0, [0, 0, 0, 1], 2), (1, 0, 1, [0, 0, .3, 1], 2), (1, 1, None, [0, 1, 0, 1], 7), (2, 0, None, [1, 1, 1, 1], 2)])
    got = rp.merge_small_leaves(tree, vec)
    assert sizes(got) == {(0, 0, 0): 7, (0, 0, 2): 4, (0, 0, 3): 1, (0, 1, None): 6, (1, 0, None): 4, (1, 1, None): 7, (2, 0, None): 2}
    before, after = (t.groupBy("l1").count().orderBy("l1").collect() for t in (tree, got))
    assert before == after  # nothing crosses the first level


def test_orphans_move_once_on_a_snapshot(spark):
    tree, vec = grown(spark, [(0, 0, None, [1, 0, 0, 0], 6), (0, 1, None, [0, 1, 0, 0], 5), (1, 0, None, [-1, 0, 0, 0], 2)])
    stray = spark.createDataFrame([(13, 1, 0, None)], tree.schema), spark.createDataFrame([(13, [0.0, 1.0, 0.0, 0.0])], vec.schema)
    got, moves = rp.reassign_orphans(tree.unionByName(stray[0]), vec.unionByName(stray[1]))
    assert [(r["item_id"]) for r in moves.collect()] == [13]
    assert sizes(got) == {(0, 0, None): 6, (0, 1, None): 6, (1, 0, None): 2}
    again, _ = rp.reassign_orphans(got, vec.unionByName(stray[1]))
    assert sum(sizes(again).values()) == 14


def test_consolidation_keeps_the_lower_id_and_renumbers(spark):
    tree, vec = grown(spark, [(0, 0, None, [1, 0, 0, 0], 3), (0, 4, None, [1, .1, 0, 0], 3), (1, 0, None, [0, 1, 0, 0], 3), (2, 0, None, [1, .05, 0, 0], 2), (2, 1, None, [1, 0, .1, 0], 2)])
    got, log = rp.consolidate_l1(tree, vec)
    assert [(r["kept"], r["merged"]) for r in log.collect()] == [(0, 2)]
    assert sizes(got) == {(0, 0, None): 3, (0, 4, None): 3, (0, 5, None): 2, (0, 6, None): 2, (1, 0, None): 3}


def test_naming_goes_bottom_up(spark):
    tree = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, None), (3, 1, 0, None)], "item_id long, l1 int, l2 int, l3 int")
    items = spark.createDataFrame([(i, f"T{i}", f"about {i}") for i in range(4)], "item_id long, technology_name string, Technology_Description string")

    def fn(digests):
        return [json.dumps({"cluster_name": "<" + d.replace("\n", "|") + ">", "summary": "s"}) for d in digests]

    got = {(r["level"], r["l1"], r["l2"], r["l3"]): r["name"] for r in nm.name_tree(tree, items, fn).collect()}
    assert got[(3, 0, 0, 1)] == "<- T1: about 1>"
    assert got[(2, 0, 0, None)] == "<- <- T0: about 0>: s|- <- T1: about 1>: s>"
    assert got[(1, 0, None, None)].startswith("<- <- <- T0") and got[(1, 1, None, None)] == "<- T3: about 3>"
    audit = {r["node_id"]: r for r in hi_audit(nm.named_pairs(nm.name_tree(tree, items)))}
    assert audit["0"]["generic_words"] == "" and not audit["0.0"]["shared_with_sibling"]


def hi_audit(names):
    from coppice.operators.report import name_guard_audit

    return name_guard_audit(names).collect()


def test_embedding_cache_only_computes_new_texts(spark, tmp_path):
    texts = spark.createDataFrame([(i, "v1", f"text {i}") for i in range(23)], "item_id long, variant string, text string")

    def fn(batch):
        assert len(batch) <= 10
        return [[float(len(t))] for t in batch]

    path = str(tmp_path / "vectors")
    assert em.embed_missing(spark, texts, path, "m", fn).count() == 23
    changed = texts.withColumn("text", F.when(F.col("item_id") < 3, "new").otherwise(F.col("text")))
    assert em.embed_missing(spark, changed, path, "m", fn).count() == 23
    assert spark.read.parquet(path).count() == 26
    with pytest.raises(ValueError):
        em.embed_missing(spark, texts, path, "m")


def test_build_tree_end_to_end(spark, sf, tmp_path):
    items = scoring.items(spark, sf)
    out = pt.build_tree(items, judge=clustering.judge, ks=[4], l2_ks=[2], l3_ks=[2], min_sizes=[40], starts=2)
    n = items.count()
    assert out.result.count() == n and out.result.select("item_id").distinct().count() == n
    assert out.summary.filter("level = 1").agg(F.sum("tech_count")).first()[0] == n
    assert out.summary.select("id").distinct().count() == out.summary.count()
    small = hi.tree_leaves(out.tree).withColumn("kin", F.count("*").over(hi.W.partitionBy("l1"))).filter("n <= 2 and kin > 1 and l3 is null")
    assert small.count() == 0
    written = out.write(str(tmp_path))
    assert spark.read.parquet(written["overview"]).filter("row_kind = 'item'").count() == n


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _small_tree(spark):
    paths = [(0, 0, 0), (0, 0, 1), (0, 1, None), (1, 0, None), (1, 1, None), (2, 0, None)]
    tree = spark.createDataFrame([(2 * i + j, *p) for i, p in enumerate(paths) for j in (0, 1)], "item_id long, l1 int, l2 int, l3 int")
    items = spark.range(12).select(F.col("id").alias("item_id"), F.concat(F.lit("thing "), "id").alias("technology_name"), F.lit("text").alias("Technology_Description"))
    return tree, items


def test_names_are_asked_for_again_with_their_context(spark):
    tree, items = _small_tree(spark)
    bad = cfg.GENERIC_WORDS[0]

    def fn(digests):
        """A generic name at first; told what to avoid, one of its own."""
        return [f"No {zlib.crc32(d.encode()) % 10**6}" if "Words to avoid: " in d else f"{bad} {d[:12]}" for d in digests]

    first = nm.name_tree(tree, items, fn)
    names, audit = nm.repair_names(tree, items, first, fn, rounds=3)
    assert {r.generic_words for r in audit.collect()} == {""} and names.count() == first.count() == 10
    kept, left = nm.repair_names(tree, items, first, None)
    assert {(r.level, r.l1, r.l2, r.l3, r.name) for r in kept.collect()} == {(r.level, r.l1, r.l2, r.l3, r.name) for r in first.collect()}
    assert left.filter("generic_words <> ''").count() == 10


def test_only_offending_names_are_asked_for(spark, tmp_path):
    tree, items = _small_tree(spark)
    start = [(1, 0, None, None, "Harbour Works"), (2, 0, 0, None, "Harbour Cranes"), (3, 0, 0, 0, "Twin"), (3, 0, 0, 1, "twin"), (2, 0, 1, None, "Lamps"),
             (1, 1, None, None, "Looms"), (2, 1, 0, None, "Wool"), (2, 1, 1, None, "Silk"), (1, 2, None, None, "Kilns"), (2, 2, 0, None, "Kilns")]
    names = spark.createDataFrame([(*r, f"about {r[-1]}") for r in start], "level int, l1 int, l2 int, l3 int, name string, summary string")
    seen = {(r.level, r.l1, r.l2, r.l3): r.context for r in nm.offenders(names).collect()}
    assert set(seen) == {(2, 0, 0, None), (3, 0, 0, 1), (2, 2, 0, None)}
    assert "Parent group: Harbour Works" in seen[2, 0, 0, None] and "harbour" in seen[2, 0, 0, None] and "Names already taken: Lamps" in seen[2, 0, 0, None]
    assert "Twin" in seen[3, 0, 0, 1].split("taken: ")[1]
    stubborn, left = nm.repair_names(tree, items, names, lambda ds: ["" for _ in ds], rounds=2)
    assert {r.name for r in stubborn.collect()} == {r[-1] for r in start} and left.filter("parent_words <> '' or equals_parent or shared_with_sibling").count() == 4
