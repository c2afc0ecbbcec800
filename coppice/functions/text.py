"""Text and name expressions. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice import settings as cfg

BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    """The value, or null when it is null, blank, ``nan`` or ``None``."""
    return F.when(~strip(c).isin("", "nan", "None"), c)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def compose_text() -> Column:
    """The text an item is embedded by; absent categories leave their label out."""
    wos, oecd = present(F.col("Web_of_Science_Category")), present(F.col("OECD_Research_Area"))
    return F.concat_ws(
        ". ",
        F.concat(F.lit("Technology: "), F.coalesce(F.col("technology_name"), F.lit(""))),
        F.concat(F.lit("Scientific domains: "), wos),
        F.concat(F.lit("Research areas: "), oecd),
        F.concat(F.lit("Description: "), F.coalesce(present(F.col("Technology_Description")), F.lit(""))),
    )


def variant_text(variant: str) -> Column:
    """One of the experiment's field templates; an absent field keeps its label."""
    def field(label: str) -> Column:
        value = F.coalesce(present(F.col(cfg.TEXT_FIELDS[label])), F.lit(""))
        return F.concat(F.lit(f"{label}: "), value)

    return F.concat_ws(". ", *[field(label) for label in ["Technology", *cfg.TEXT_VARIANTS[variant]]])


def compose_variants(items: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """``(item_id, variant, text)`` for every item and template, in one scan."""
    texts = [F.struct(F.lit(v).alias("variant"), variant_text(v).alias("text")) for v in variants or cfg.TEXT_VARIANTS]
    return items.select("item_id", F.explode(F.array(*texts)).alias("t")).select("item_id", "t.variant", "t.text")


def shorten(c: Column, n: int, mark: str = "") -> Column:
    """The first ``n`` characters, followed by ``mark`` when something was cut off."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(head, F.lit(mark))).otherwise(head) if mark else head


def full_path(levels: list[Column]) -> Column:
    return F.concat_ws(" / ", *[blank_to_null(c) for c in levels])


def leaf_of(levels: list[Column]) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in reversed(levels[1:])], levels[0])


def natural_key(dotted: Column) -> Column:
    """``1.10`` as ``[1, 10]``: arrays of integers order the way people read ids."""
    return F.transform(F.filter(F.split(dotted, r"\."), lambda p: p.rlike(r"^[0-9]+$")), lambda p: p.cast("int"))


def config_label(algo: Column, method: Column, size: Column) -> Column:
    return (
        F.when(algo == "agglomerative", F.format_string("agg-%s-k%d", method, size))
        .when(algo == "hdbscan", F.format_string("hdbscan-ms%d", size))
        .otherwise(F.format_string("%s-k%d", algo, size))
    )


def clean_name(reply: Column) -> Column:
    """A bare group name out of a plain-text naming reply."""
    text = F.regexp_replace(strip(reply), '"', "")
    text = F.replace(F.replace(text, F.lit("Category Name:"), F.lit("")), F.lit("Category:"), F.lit(""))
    return F.coalesce(blank_to_null(strip(text)), F.lit(cfg.UNNAMED))


def unfence(reply: Column) -> Column:
    """Drop a Markdown code fence around a reply."""
    text = strip(reply)
    body = F.regexp_replace(F.element_at(F.split(text, "```"), F.lit(2)), r"^json", "")
    return F.when(text.startswith("```"), strip(body)).otherwise(text)


def named_reply(reply: Column) -> Column:
    """``struct(cluster_name, summary)`` out of a JSON naming reply."""
    parsed = F.from_json(unfence(reply), "cluster_name string, summary string")
    name = F.btrim(strip(parsed["cluster_name"]), F.lit('"'))
    return F.struct(
        F.coalesce(blank_to_null(name), F.lit(cfg.UNNAMED)).alias("cluster_name"),
        F.coalesce(strip(parsed["summary"]), F.lit("")).alias("summary"),
    )


def search_condition(c: Column, query: str, literal: bool = False) -> Column:
    """Case-insensitive regular-expression (or literal) containment; null never matches."""
    pattern = f"(?i)\\Q{query}\\E" if literal else f"(?i){query}"
    return F.coalesce(c.rlike(pattern), F.lit(False))
