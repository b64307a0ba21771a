"""Session settings and the shared folder for data that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MARKET_ZONE = "Asia/Tehran"


def build_session(app: str = "navpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session in the market's time zone with adaptive execution on.

    Partition counts are left to the cluster: AQE coalesces small shuffle partitions and
    splits skewed ones, so only the upper bound matters.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": MARKET_ZONE,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        # Batches sent to Python are bounded by bytes too, because texts differ in length.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="navpulse-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For small intermediates whose values must not change if an executor is lost and a
    stage runs again (sketch results, range boundaries).
    """
    path = scratch_path(df.sparkSession, "frozen")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a stored table; one that does not exist is fine."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> set[str]:
    """Names directly below a folder, by one listing; none if it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in files.listStatus(where)} if files.exists(where) else set()


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name that is free: readers see all of it or nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if files.exists(path(target)) or not files.rename(path(source), path(target)):
        raise RuntimeError(f"{source} could not be moved to {target}")
