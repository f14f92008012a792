"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "reportlens") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="reportlens-")
    sc.setCheckpointDir(folder)
    return folder


PART_ROWS = 50_000      # below this a part is not worth splitting


def cached(df: DataFrame) -> DataFrame:
    """Persist rows for many passes; large parts are spread over the cores first."""
    rows = df.persist()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = rows.rdd.getNumPartitions()
    if parts >= cores or rows.count() <= parts * PART_ROWS:
        return rows
    spread = rows.repartition(cores).persist()
    spread.count()
    rows.unpersist()
    return spread


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and written rows that nothing refers to any more.

    It does so when the driver's memory is collected; a driver that has room left may not do that for hours, while the
    rounds of a loop fill the disks and its memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def constant(one_row: DataFrame) -> Column:
    """The value of a one-row table as a column.

    It is computed once and written, so Python functions and lambdas can use it whether or not the
    rows it came from are cached; a bare subquery over cached rows fails there.
    """
    return cut_lineage(one_row).scalar()
