"""Flag normalisation, domain repair, prompts and the reviewers' tables."""

import pytest
from pyspark.sql import functions as F

from coppice import settings as cfg
from coppice.operators import routing as ro
from coppice.plans import routes
from coppice.sources.sinks import write_review_files

ITEMS = "item_id long, technology_name string, Technology_Description string, category_level_1 string, category_level_2 string, category_level_3 string, leaf_category string, full_path string"
FLAGS = "array<struct<name:string,level:string>>"
MAP = f"leaf_category string, primary_domain string, primary_sub_domain string, secondary_domain string, secondary_sub_domain string, reasoning string, group_status string, anomalies {FLAGS}"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, n, "text", a, b, "", leaf, f"{a} / {b} / {leaf}") for i, (n, a, b, leaf) in enumerate(rows)], ITEMS)


@pytest.fixture(scope="module")
def result(spark):
    return rows_of(spark, [
        ("Ion trap grid", "Physics", "Traps", "Trap hardware"), ("Atom chip sensor", "Physics", "Traps", "Trap hardware"),
        ("Cochlear gene patch", "Life", "Senses", "Hearing repair"),
        ("Legged courier", "Machines", "Odds", "Odds and ends"), ("Salt heat store", "Machines", "Odds", "Odds and ends")])


@pytest.fixture(scope="module")
def leaves(spark):
    return spark.createDataFrame([
        ("Trap hardware", "D1", "a", None, None, "core is trapping", "tight", [("Atom chip sensor", "yellow")]),
        ("Hearing repair", "D2", "b", "D4", "d", "gene therapy with a device", "tight", []),
        ("Odds and ends", "D4", "d", None, None, "no majority", "mixed", [("Salt heat store", "red")])], MAP)


@pytest.fixture(scope="module")
def routed(result, leaves):
    return routes.route(result, leaves)


def flags(spark, status, anomalies, incoherent=None):
    kind = FLAGS if anomalies and isinstance(anomalies[0], tuple) else "array<string>"
    df = spark.createDataFrame([(status, incoherent, anomalies)], f"group_status string, incoherent boolean, anomalies {kind}")
    r = ro.normalize_flags(df).first()
    return r["group_status"], [tuple(a) for a in r["anomalies"]]


def test_current_shape(spark):
    assert flags(spark, "diverse", [("A", "red")]) == ("diverse", [("A", "red")])


def test_bare_names_are_yellow(spark):
    assert flags(spark, "tight", ["A", "B"])[1] == [("A", "yellow"), ("B", "yellow")]


def test_older_boolean_shape(spark):
    assert flags(spark, None, ["A"], True) == ("mixed", [])
    assert flags(spark, None, [], False)[0] == "tight"


def test_unknown_status_is_tight(spark):
    assert flags(spark, "banana", [])[0] == "tight"


def test_mixed_drops_item_flags(spark):
    assert flags(spark, "mixed", [("A", "red")]) == ("mixed", [])


def test_blank_names_are_dropped(spark):
    assert flags(spark, "tight", ["", "  ", "Real"])[1] == [("Real", "yellow")]


def test_domain_repair(spark):
    raw = spark.createDataFrame([("l", "  D1  ", "D2"), ("m", None, ""), ("n", "Done", None)], "leaf_category string, primary_domain string, secondary_domain string")
    aliases = spark.createDataFrame([("Done", "D1")], "variant string, canonical string")
    known = spark.createDataFrame([("D1",), ("D2",)], "domain string")
    got = {r["leaf_category"]: r for r in ro.normalize_domain(raw, aliases, known).collect()}
    assert (got["l"]["primary_domain"], got["l"]["secondary_domain"], got["l"]["primary_domain_known"]) == ("D1", "D2", True)
    assert (got["m"]["primary_domain"], got["m"]["secondary_domain"], got["m"]["primary_domain_known"]) == (None, "", False)
    assert got["n"]["primary_domain"] == "D1"
    assert raw.filter("leaf_category = 'l'").first()["primary_domain"] == "  D1  "


def test_unknown_domains_are_listed(spark, routed):
    raw = spark.createDataFrame([("l", "D1", "Dx"), ("m", None, " "), ("n", "Done", None), ("o", "Dx", "D1")], "leaf_category string, primary_domain string, secondary_domain string")
    aliases = spark.createDataFrame([("Done", "D1")], "variant string, canonical string")
    named = ro.normalize_domain(raw, aliases, spark.createDataFrame([("D1",)], "domain string"))
    want = [("Dx", "primary_domain", "o"), ("Dx", "secondary_domain", "l")]
    assert sorted(map(tuple, ro.unknown_domains(named).collect())) == want
    assert ro.unknown_domains(raw).count() == 0 == ro.unknown_domains(named.limit(0)).count()
    assert routed.unknown.columns == ["domain", "role", "leaf_category"]


def test_prompt_carries_the_evidence(spark):
    ctx = spark.createDataFrame([("Trap hardware", "A / B / Trap hardware", "shared core", 0, 2, ["Alpha", "Beta"]), ("Z", "p", "", None, None, None)],
                                "leaf_category string, full_path string, summary string, part_no long, n long, names array<string>")
    got = {r["leaf_category"]: r["prompt"] for r in ro.leaf_prompt_rows(ctx).collect()}
    assert got["Trap hardware"] == "1. Group: Trap hardware\n   Path: A / B / Trap hardware\n   About: shared core\n   Members: Alpha, Beta"
    assert got["Z"] == "2. Group: Z\n   Path: p"


def test_bridge_reaches_both_domains(routed):
    got = {(r["domain"], r["is_referral"]): r["cross_relevance"] for r in routed.review.filter("technology_name = 'Cochlear gene patch'").collect()}
    assert got == {("D2", False): "D4 / d", ("D4", True): cfg.HOME_NOTE + "D2 / b"}


def test_one_table_per_domain(routed, spark, tmp_path):
    assert {r[0] for r in routed.review.select("domain").distinct().collect()} == {"D1", "D2", "D4"}
    out = routed.write(str(tmp_path), headers=True)
    back = spark.read.parquet(out["items"])
    assert set(cfg.REVIEW_HEADERS.values()) <= set(back.columns) and back.count() == 6
    assert spark.read.parquet(out["leaves"]).count() == 4


def test_item_flag_is_visible(routed):
    got = [(r["technology_name"], r["item_flag"]) for r in routed.review.filter("domain = 'D1' and item_flag <> ''").collect()]
    assert got == [("Atom chip sensor", cfg.ITEM_YELLOW)]


def test_mixed_group_has_banner_and_no_item_flags(routed):
    rows = [r for r in routed.rows.filter("domain = 'D4'").orderBy("row_no").collect()]
    assert [r["row_kind"] for r in rows] == ["sub_domain", "referral", "separator", "banner", "item", "item"]
    assert routed.review.filter("domain = 'D4' and item_flag <> ''").count() == 0
    label = {r["leaf_label"]: r["note"] for r in routed.summary.filter("domain = 'D4'").collect()}
    assert label["⛔ Odds and ends"] == cfg.MIXED_BANNER


def test_unassigned_leaves_do_not_break(result, leaves):
    none = routes.route(result, leaves.limit(0))
    assert {r[0] for r in none.review.select("domain").distinct().collect()} == {cfg.UNCLASSIFIED}
    assert none.unassigned.count() == 3


def test_last_duplicate_flag_wins(spark):
    df = spark.createDataFrame([("l", [("A", "red"), ("A", "yellow"), ("B", "red")])], f"leaf_category string, anomalies {FLAGS}")
    assert {(r["name"], r["level"]) for r in ro.flag_rows(df).collect()} == {("A", "yellow"), ("B", "red")}


def test_reply_parsing_steps(spark):
    good = '{"group_status": "diverse", "majority_theme": "t", "anomalies": ["A", {"name": "B", "level": "RED"}]}'
    raws = [good, f"```json\n{good}\n```", good + " and that is all", "Well: " + good, '{"group_status": "mixed" "anomalies": []}',
            '{"group_status": "tight" "anomalies": [{"name": "X, Y", "level": "red"}', "", "nothing here", f"[{good}]", '{"anomalies": ["A"]}', None]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = {r["i"]: (r["parse_step"], r["group_status"], [tuple(a) for a in r["anomalies"]]) for r in ro.parse_flags(df).collect()}
    pair = [("A", "yellow"), ("B", "red")]
    assert [got[i] for i in range(4)] == [("object", "diverse", pair)] * 3 + [("block", "diverse", pair)]
    assert got[4] == ("salvage", "mixed", []) and got[5] == ("salvage", "tight", [("X, Y", "red")])
    assert all(got[i] == ("empty", "tight", []) for i in (6, 7, 8, 10)) and got[9] == ("object", "tight", [("A", "yellow")])


def test_domain_map_from_replies(spark):
    replies = spark.createDataFrame([(1, 'Sure {"assignments": [{"leaf_category": "L", "primary": {"domain": " D1 ", "sub_domain": "s"}}]}'), (2, "no")], "batch_id long, raw string")
    checks = spark.createDataFrame([("L", '{"group_status": "diverse", "anomalies": ["A"]}')], "leaf_category string, raw string")
    aliases = spark.createDataFrame([("x", "D1")], "variant string, canonical string")
    leaves, bad = routes.domain_map(replies, checks, aliases, spark.createDataFrame([("D1",)], "domain string"))
    r = leaves.first()
    assert (r["leaf_category"], r["primary_domain"], r["group_status"], len(r["anomalies"])) == ("L", "D1", "diverse", 1)
    assert [b["batch_id"] for b in bad.collect()] == [2]


def test_repeated_sub_domain_titles_and_bands(spark):
    """A blank referral sub-domain shows the home one, so titles follow the shown name."""
    rows = [("D", s, shown, False, i, f"n{i}", leaf) for i, (s, shown, leaf) in enumerate(
        [("", "x", "l1"), ("", "y", "l2"), ("", "x", "l3"), ("z", "z", "l4"), ("z", "z", "l5")])]
    df = spark.createDataFrame(rows, "domain string, sub_domain string, shown_sub string, is_referral boolean, item_id long, technology_name string, leaf_category string")
    st = spark.createDataFrame([("l1", "tight")], "leaf_category string, group_status string")
    kinds = [r["row_kind"] for r in ro.review_rows(df, st).orderBy("row_no").collect()]
    assert kinds == ["sub_domain", "item", "spacer", "sub_domain", "separator", "item", "spacer", "sub_domain", "separator", "item",
                     "spacer", "sub_domain", "separator", "item", "separator", "item"]
    assert {r["leaf_category"]: r["band"] for r in ro.band_toggle(df).collect()} == {"l1": 0, "l2": 0, "l3": 0, "l4": 0, "l5": 1}


def test_review_files_of_one_large_domain(spark, tmp_path):
    """Most rows in one domain: several tasks write it, and its files follow one another in order."""
    review = spark.range(1000).select(F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "mid").otherwise("small").alias("domain"), (F.col("id") + 1).alias("position"), F.col("id").alias("item"))
    summary = spark.createDataFrame([("big", 1, "x"), ("small", 1, "y")], "domain string, position int, leaf string")
    out = write_review_files(review.repartition(5), summary, str(tmp_path / "r"), rows_per_file=100)
    files = sorted((tmp_path / "r/items/domain=big").glob("*.parquet"))
    assert len(files) >= 5
    read = [r.item for f in files for r in spark.read.parquet(str(f)).collect()]
    assert read == list(range(900)) and spark.read.parquet(out["items"]).count() == 1000
    assert spark.read.parquet(out["leaves"]).count() == 2
