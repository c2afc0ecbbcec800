"""Session helpers: the shared folder, lineage cuts and distributed row numbers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("coppice")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A temporary folder is used only by a local master, where driver and executors share a disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="coppice-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    _ship(spark, folder)
    return folder


def _ship(spark: SparkSession, folder: str) -> None:
    """Give this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if any(f.endswith("coppice.zip") for f in sc._python_includes):
        return
    package, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/code-{uuid.uuid4().hex}/coppice.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(target).toString())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan starts over from files every executor can reach, so a lost executor costs a re-read.
    Unlike a checkpoint the table keeps its true size in the plan, which lets the optimizer
    broadcast it when it is small, and later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list, name: str = "row_no", within: list[str] | None = None) -> DataFrame:
    """``row_number()`` over a total order without gathering a group in one task.

    The rows are range-sorted across the cluster; a row's number is its offset in its sorted
    partition plus the number of rows in the partitions before it. Only one count per sorted
    partition reaches the driver. ``within`` restarts the numbering for each group, so a group
    that holds most of the table is still spread over many partitions.
    """
    within = within or []
    keys: list[Column] = [F.col(c) for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.orderBy(*keys).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33)
    starts, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts += [total] * (p + 1 - len(starts))
        total += n
    if not starts:
        return placed.drop("_slot").withColumn(name, F.lit(None).cast("long"))
    base = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), part.cast("int") + 1)
    placed = placed.withColumn(name, base + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_slot")
    if not within:
        return placed
    # Written, so that its size is known and a short list of groups is broadcast to the rows.
    firsts = cut(placed.groupBy(*within).agg((F.min(name) - 1).alias("_first")))
    same = None
    for c in within:
        hit = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = hit if same is None else same & hit
    return (
        placed.alias("a")
        .join(firsts.alias("b"), same)
        .select("a.*", "b._first")
        .withColumn(name, F.col(name) - F.col("_first"))
        .drop("_first")
    )
