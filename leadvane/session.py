"""Session settings every job relies on."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: UTC timestamps, AQE re-planning, and skew handling for joins that feed further operators.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide projections generate methods the JVM refuses to compile; beyond its limit use per-operator code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The driver keeps the printed plan of every execution, with all expressions of a wide design several MB each.
    "spark.sql.maxPlanStringLength": "32768",
}
#: Shuffles begin with at least so many partitions; AQE joins the small ones. In a session of few partitions a task would
#: otherwise read, sort and spill a share that grows with the input.
INITIAL_PARTITIONS = 200
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` and ``INITIAL_PARTITIONS`` to a session somebody else created, and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    spark.conf.set(_INITIAL, str(max(INITIAL_PARTITIONS, shuffle_partitions(spark))))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle without a number of its own begins with, at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "leadvane") -> SparkSession:
    """A session for tests and the local benchmark."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only where none is set (tests) fall back to a scratch one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="leadvane-checkpoint-")
    sc.setCheckpointDir(shared)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/leadvane/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the plan and survives lost executors."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Moves the parquet files of the folder ``source`` into ``target``, named with ``prefix``, and returns their number; 0 if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    found = [f.getPath() for f in fs.listStatus(path(source))] if fs.exists(path(source)) else []
    files = [f for f in found if f.getName().endswith(".parquet")]
    for f in files:
        if not fs.rename(f, path(target, prefix + f.getName())):
            raise OSError(f"{f.toString()} could not be moved to {target}")
    return len(files)
