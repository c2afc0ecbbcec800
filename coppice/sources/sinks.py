"""Writing result tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from coppice import settings as cfg
from coppice.session import cut

ROWS_PER_FILE = 500_000


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every table to its own folder under ``path``."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").option("header", True).format(fmt).save(out[name])
    return out


def write_review_files(review: DataFrame, summary: DataFrame, path: str, headers: bool = False, rows_per_file: int = ROWS_PER_FILE) -> dict[str, str]:
    """The reviewer tables, one folder per domain, rows in reading order.

    Rows are range-partitioned by domain and position into about one part per ``rows_per_file`` rows, so
    a domain that holds most of the rows is written by many tasks, and its files follow one another in
    order. ``headers`` renames the columns to the reviewers' wording.
    """
    out = {"items": f"{path.rstrip('/')}/items", "leaves": f"{path.rstrip('/')}/leaves"}
    for name, df in (("items", cut(review)), ("leaves", cut(summary))):
        parts = max(1, math.ceil(df.count() / rows_per_file))
        spread = df.repartitionByRange(parts, "domain", "position").sortWithinPartitions("domain", "position")
        if headers and name == "items":
            spread = spread.withColumnsRenamed(cfg.REVIEW_HEADERS)
        spread.write.mode("overwrite").partitionBy("domain").parquet(out[name])
    return out
