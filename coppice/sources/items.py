"""Reading, checking and writing item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice import settings as cfg
from coppice.session import number_rows, scratch_path

ITEM_SCHEMA = T.StructType(
    [T.StructField("item_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in cfg.ITEM_COLUMNS])


class MissingColumns(ValueError):
    def __init__(self, missing: list[str]):
        super().__init__(f"missing columns: {', '.join(missing)}")
        self.missing = missing


def require_columns(df: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """``df`` itself, or an error listing every column it lacks."""
    missing = [c for c in needed or cfg.BROWSE_COLUMNS if c not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df


def scan_items(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str = ITEM_SCHEMA, line_breaks: bool = False) -> DataFrame:
    """Items from CSV (quoted commas and quotes in fields) or Parquet, with the columns of ``schema``.

    Columns are found by the names in the header, in any order; others are left out, ones that are
    not there are null, and an error lists required ones that are missing. Without an ``item_id`` the
    rows get one from their content and, among equal rows, a running number: it stays the same
    whatever the order of rows and files. ``line_breaks`` allows line breaks inside quoted fields; a
    file then is one task.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if fmt == "parquet":
        found = spark.read.parquet(path)
    else:
        found = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_breaks).csv(path)
    require_columns(found)
    named = found.select(*[(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    if "item_id" in found.columns:
        return named
    content = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\0")) for f in wanted if f.name != "item_id"]
    numbered = number_rows(named.withColumn("_content", F.xxhash64(*content)), [], "_copy", within=["_content"])
    return numbered.withColumn("item_id", F.xxhash64("_content", "_copy")).select(*[f.name for f in wanted])


def write_csv(df: DataFrame, name: str) -> str:
    """Write to a fresh place in the shared folder and return it."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
