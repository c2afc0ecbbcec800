"""Tag sets: parsing and set algebra as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coppice.functions.text import present, strip


def _tag_set(parts: Column) -> Column:
    tags = F.array_distinct(F.filter(parts, lambda t: t != ""))
    return F.coalesce(tags, F.array().cast("array<string>"))


def parse_semicolon(c: Column) -> Column:
    """``"A, B; C"`` as ``[A, B | C]``: only semicolons separate tags."""
    return _tag_set(F.transform(F.split(present(c), ";"), strip))


def parse_list(c: Column) -> Column:
    """``"['a', 'b']"`` as ``[a | b]``; a comma inside quotes separates too."""
    inner = F.btrim(strip(present(c)), F.lit("[]"))
    return _tag_set(F.transform(F.split(inner, ","), lambda t: F.btrim(strip(t), F.lit("'\""))))


PARSERS = {"semicolon": parse_semicolon, "list": parse_list}


def subsets(tags: Column) -> Column:
    """All ``2^t`` subsets of a small sorted array, the empty one first."""
    empty = F.array(F.array().cast("array<string>"))
    return F.aggregate(tags, empty, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))))


def set_algebra(a: Column, b: Column) -> dict[str, Column]:
    """Union, intersection, difference and Jaccard of two tag sets."""
    shared, joined = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {
        "union": F.array_union(a, b),
        "intersection": F.array_intersect(a, b),
        "difference": F.array_except(a, b),
        "jaccard": F.when(joined > 0, shared / joined).otherwise(0.0),
    }
