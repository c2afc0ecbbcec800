"""Test inputs derived from the given tables, in SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


_MARK = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run a derivation on Spark; ``{name}`` marks a given table."""
    return spark.sql(_MARK.sub(lambda m: f"parquet.`{sf}/{m[1]}.parquet`", sql))


def plain(sql: str) -> str:
    """The same derivation as DuckDB reads it."""
    return _MARK.sub(lambda m: m[1], sql)


# Customers as items of a three-level tree: region, nation, market segment. One segment has no
# third level and one region has no second level, so that every kind of path occurs.
RESULT = """
SELECT c_custkey AS item_id, c_name AS technology_name,
       concat('balance ', c_acctbal, ' in ', c_mktsegment) AS Technology_Description,
       r_name AS category_level_1,
       CASE WHEN r_name = 'ASIA' THEN '' ELSE n_name END AS category_level_2,
       CASE WHEN c_mktsegment = 'MACHINERY' OR (r_name = 'ASIA' AND c_mktsegment <> 'BUILDING') THEN ''
            ELSE concat(n_name, ' ', c_mktsegment) END AS category_level_3
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Parts as described items with tag columns, including the ways a tag cell can be missing.
ITEMS = """
SELECT p_partkey AS item_id,
       concat(p_name, ' ', p_partkey) AS technology_name,
       CASE WHEN p_partkey % 17 = 3 THEN NULL
            ELSE concat(p_brand, ' makes ', p_name, ' of type ', p_type, ' in size ', p_size) END AS Technology_Description,
       CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 'nan' WHEN p_size % 10 = 2 THEN '  '
            ELSE concat(replace(p_name, ' ', '; '), ';; ', p_type, ', ', 'Multidisciplinary; ', p_type) END AS Web_of_Science_Category,
       CASE WHEN p_size % 12 = 0 THEN 'None' ELSE concat(p_type, '; ', p_size % 5, '.1 Sciences ;', p_size % 3) END AS OECD_Research_Area,
       CASE WHEN p_size % 9 = 0 THEN '[]' ELSE concat(' [''', replace(p_name, ' ', ''', '''), ''']') END AS emerging_tech_concepts,
       CASE WHEN p_size % 11 = 0 THEN '' ELSE concat('["', p_type, ' Secure", ''Size ', p_size % 4, ''', ''Size ', p_size % 4, ''']') END AS applied_domain,
       p_brand AS brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS cluster
FROM {part}
"""
