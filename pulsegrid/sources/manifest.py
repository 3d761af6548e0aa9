"""Manifests: which recordings a stage has finished, and from which input.

A stage is written first and its manifest after that, into a folder of its own for each run. A run counts only
once its folder has the mark of a finished write, so a run that is broken off anywhere leaves its recordings to be
done again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schema import KEYS

# What is known of the inputs of a recording: one row for each of its input files, or for its part of the stage before.
ENTRY = "grp string, record string, input string, size long, mtime timestamp, output string, run string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """The folders of the runs whose manifest was committed."""
    place, store = _folder(spark, path)
    if not store.exists(place):
        return []
    runs = [s.getPath() for s in store.listStatus(place) if s.isDirectory()]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(str(r) for r in runs if r.getName().startswith("run-") and store.exists(mark(r, "_SUCCESS")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries of all finished runs, None before the first."""
    runs = finished_runs(spark, path)
    return spark.read.schema(ENTRY).parquet(*runs) if runs else None


def latest(entries: DataFrame) -> DataFrame:
    """The entries of each recording's last run. Runs are named by their time."""
    last = entries.groupBy(*KEYS).agg(F.max("run").alias("run"))
    return entries.join(last, [*KEYS, "run"])


def versions(inputs: DataFrame) -> DataFrame:
    """(grp, record, version): the number of inputs of each recording, and their names, sizes and times in one sum.

    A file that is replaced, added or taken away gives another version. Nulls are values like others.
    """
    one = F.xxhash64("input", "size", F.coalesce(F.col("size").cast("string"), F.lit("?")), "mtime")
    total = F.sum(one.cast("decimal(38,0)")).cast("string")
    return inputs.groupBy(*KEYS).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total).alias("version"))


def changed(inputs: DataFrame, entries: DataFrame | None) -> DataFrame:
    """(grp, record) of the recordings whose inputs are not those of their last finished run."""
    wanted = versions(inputs)
    if entries is None:
        return wanted.select(*KEYS)
    return wanted.join(versions(latest(entries)), [*KEYS, "version"], "left_anti").select(*KEYS)


def pending(spark: SparkSession, path: str, inputs: DataFrame, force: bool = False) -> DataFrame:
    return changed(inputs, None if force else read_manifest(spark, path))


def commit(spark: SparkSession, path: str, inputs: DataFrame, output: str) -> str:
    """Record that `output` holds what follows from `inputs` (grp, record, input, size, mtime). Call it after the write."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = inputs.select(*KEYS, "input", F.col("size").cast("long").alias("size"), "mtime", F.lit(output).alias("output"), F.lit(run).alias("run"))
    rows.write.parquet(f"{path.rstrip('/')}/run-{run}")
    return run


def as_inputs(entries: DataFrame, setting: str = "") -> DataFrame:
    """The last runs of one stage as the inputs of the next; `setting` tells results of different settings apart."""
    name = F.concat_ws("?", F.col("output"), F.lit(setting)) if setting else F.col("output")
    return latest(entries).select(*KEYS, "run", "output").distinct().select(
        *KEYS, name.alias("input"), F.lit(None).cast("long").alias("size"),
        F.timestamp_micros(F.floor(F.substring("run", 1, 20).cast("decimal(20,0)") / 1000).cast("long")).alias("mtime"),
    )
