"""Session settings and the reliable lineage cut used by the few multi-pass operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Shuffles start with partitions of about this size; AQE merges those that turn out small.
PARTITION_BYTES = 256 << 20


def initial_partitions(input_bytes: int) -> int:
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "pulsegrid", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE stays on (runtime coalescing, skew splits, size-checked broadcast); the time zone is
    pinned because recordings carry zone-less timestamps. `input_bytes` sizes the shuffles.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if input_bytes:
        defaults["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions(input_bytes))
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without one is
    an error, since a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-checkpoint-"))
    return context.getCheckpointDir()


def in_few_tasks(df: DataFrame) -> DataFrame:
    """`df` in at most four partitions per core, side by side as they come and without a shuffle: a small table of many
    shuffle partitions costs the start of a task for each of them, in each stage that reads it."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` to the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
