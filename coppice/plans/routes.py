"""From a finished tree and model replies to the reviewers' tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.replies import ANOMALIES
from coppice.operators import routing as ro
from coppice.session import cut
from coppice.sources.sinks import write_review_files


@dataclass
class ReviewTables:
    review: DataFrame
    summary: DataFrame
    rows: DataFrame
    leaves: DataFrame
    unassigned: DataFrame
    quarantine: DataFrame
    unknown: DataFrame  # domains outside the known list, to be settled before the files go out

    def write(self, path: str, **kw) -> dict[str, str]:
        return write_review_files(ro.review_order(self.review), self.summary, path, **kw)


def domain_map(assignment_replies: DataFrame, flag_replies: DataFrame, aliases: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaf map from raw replies: domains, status, theme, flags; and the unreadable replies.

    ``assignment_replies(batch_id, raw)``, ``flag_replies(leaf_category, raw)``.
    """
    assigned, quarantine = ro.parse_assignments(assignment_replies)
    named = ro.normalize_domain(assigned.drop("group_status", "anomalies"), aliases, known)
    checked = ro.parse_flags(flag_replies).select("leaf_category", "group_status", "majority_theme", "anomalies")
    leaves = named.join(checked, "leaf_category", "left")
    return leaves.withColumn("group_status", F.coalesce("group_status", F.lit("tight"))).withColumn(
        "majority_theme", F.coalesce("majority_theme", F.lit(""))).withColumn(
        "anomalies", F.coalesce("anomalies", F.array().cast(ANOMALIES))), quarantine


def route(result: DataFrame, leaves: DataFrame, flags: DataFrame | None = None, quarantine: DataFrame | None = None) -> ReviewTables:
    """Send every item to its reviewers.

    ``leaves`` is a leaf map; ``flags(leaf_category, name, level)`` replaces its anomaly arrays where
    a leaf has too many to hold in one row.
    """
    leaves = cut(ro.normalize_flags(leaves))
    flags = ro.flag_rows(leaves) if flags is None else flags
    mixed = leaves.filter("group_status = 'mixed'").select("leaf_category")
    flags = flags.join(mixed, "leaf_category", "left_anti")
    routed = ro.route_rows(ro.attach_item_flags(ro.attach_domains(result, leaves), flags))
    review = cut(ro.review_table(routed))
    empty = leaves.select(F.lit(0).cast("long").alias("batch_id"), F.lit("").alias("raw")).limit(0)
    return ReviewTables(
        review, ro.domain_leaf_summary(review, leaves), ro.review_rows(review, leaves), leaves,
        ro.unassigned_leaves(result, leaves), empty if quarantine is None else quarantine, ro.unknown_domains(leaves))
