"""Session helper and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Wide aggregates over computed columns generate methods above the JVM's default limit for compiling them.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def build_session(app: str = "harvestlens", master: str | None = None, shuffle_partitions: int | None = None):
    """A session with adaptive execution on. On a cluster, master and partition counts come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        # on a cluster these come from spark-submit and are left alone
        builder = builder.config("spark.driver.extraJavaOptions", JVM_OPTIONS).config("spark.executor.extraJavaOptions", JVM_OPTIONS)
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("HARVESTLENS_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; a local one only where none is configured (tests)."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="harvestlens-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def _path(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them, for stores that only Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def file_state(spark: SparkSession, path: str) -> tuple | None:
    """Names, sizes and times of a file or of the files of a folder; None if there is nothing."""
    fs, place = _path(spark, path)
    if not fs.exists(place):
        return None
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)))


# the folder of each application under its scratch root
_OWN: dict[tuple[str, str], str] = {}


def own_folder(spark: SparkSession) -> str:
    """This application's folder under the scratch root. The driver's JVM removes it when it ends."""
    root = scratch_root(spark)
    key = (spark.sparkContext.applicationId, root)
    if key not in _OWN:
        folder = f"{root}/harvestlens-{uuid.uuid4().hex}"
        fs, place = _path(spark, folder)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _OWN[key] = folder
    return _OWN[key]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder path that all executors reach."""
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage of a table that a loop reads many times: Parquet in the shared folder, so that readers prune columns, and with
    `partition_by` the folders of other values."""
    path = fresh_folder(df.sparkSession, "table")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
