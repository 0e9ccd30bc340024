"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES, MOST_PARTS = 8 << 20, 100_000
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators assume.

    Only options that change *meaning* are set here (canonical timestamps are
    UTC). Sizing (shuffle partitions, memory) is left to the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    ``spark.checkpoint.dir`` as named by the cluster; a private temporary folder
    is used only when nothing is configured and all tasks run in this process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, task_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Use all cores for row-wise CPU work, in tasks whose length does not grow with the input.

    A scan of few files, or of large pieces, is dealt into parts of ``task_bytes`` of the stored
    table, at least one per core. Does nothing when the scan already has that many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(cores, min(-(-stored // task_bytes), MOST_PARTS))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and freezes the rows, so that two later reads agree even when
    executors are lost in between.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once its last reader is done."""
    for table in tables:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
