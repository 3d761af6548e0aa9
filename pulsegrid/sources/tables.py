"""Parquet stages between the steps of the pipeline."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pulsegrid.schema import KEYS, TIME
from pulsegrid.session import cut_lineage, shared_folder


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """The stage at `path`, or None if it has not been written yet.

    Folder names are text: a record called 007 must not become 7.
    """
    try:
        found = spark.read.parquet(path).schema
        text = [StructField(f.name, StringType()) if f.name in KEYS else f for f in found]
        return spark.read.schema(StructType(text)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_stage(df: DataFrame, path: str, order: str | None = TIME, by: list[str] = KEYS, whole: bool = False) -> None:
    """Zstd Parquet, one folder per recording, rows in time order inside a file.

    Rows are spread by (recording, time cell), so a long recording is written by many tasks
    instead of one. Only the recordings in `df` are replaced, unless the stage is written `whole`;
    that leaves a mark when it is finished.
    """
    if order:
        cell = F.floor(F.col(order) / 86_400)
        df = df.repartition(*by, cell).sortWithinPartitions(*by, order)
    (
        df.write.mode("overwrite").partitionBy(*by)
        .option("partitionOverwriteMode", "static" if whole else "dynamic").option("compression", "zstd").parquet(path)
    )


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the last whole write to `path` was committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stage_version(stage: DataFrame) -> str:
    """A name for the files a stage is read from: their number, paths, sizes and times."""
    about = stage.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = about.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def footer_counts(spark: SparkSession, path: str, cols: list[str]) -> tuple[int, dict[str, int]]:
    """(rows, non-null values per column) of the Parquet files at `path`, from the statistics in their footers.

    Tasks add up the counts of the row groups and read no data; the counts are exact. The pushdown belongs to the
    second version of the Parquet reader, which a session of its own is told to use.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    row = footer_plan(own.read.parquet(path), cols).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(cols)}


def footer_plan(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])


def footer_null_share(spark: SparkSession, path: str, cols: list[str]) -> dict[str, float | None]:
    """The share of nulls of each column; None in a table without rows."""
    n, counts = footer_counts(spark, path, cols)
    return {c: (n - v) / n if n else None for c, v in counts.items()}


def parked(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet below the shared checkpoint folder, read again; and where it is."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def versioned(path: str, **settings) -> str:
    """A cache path of its own for every combination of settings."""
    text = repr(sorted(settings.items()))
    return f"{path.rstrip('/')}/v={hashlib.sha1(text.encode()).hexdigest()[:12]}"


def cached_stage(
    spark: SparkSession, path: str, build, order: str | None = "time", force: bool = False, droppable=None, **settings
) -> DataFrame:
    """The stage for `settings`: read back if present and finished, otherwise built, written and read back.

    `droppable` names, from the columns' shares of nulls, those that are not to be read; the shares come from
    the footers of what was written, so that the table is computed once.
    """
    place = versioned(path, **settings)
    found = read_stage(spark, place) if not force and finished(spark, place) else None
    if found is None:
        write_stage(build(), place, order, whole=True)
        found = read_stage(spark, place)
    if droppable is None:
        return found
    return found.drop(*droppable(footer_null_share(spark, place, [c for c in found.columns if c not in KEYS])))


class Kept:
    """Tables by name below one folder, each computed at most once: one that was finished, by this driver or one
    before it, is read back. `version` tells runs on different input apart."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path = spark, versioned(path, version=version)

    def table(self, name: str, build) -> DataFrame:
        place = f"{self.path}/{name}"
        if not finished(self.spark, place):
            build().write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)


def kept_or_cut(store: Kept | None, name: str, build) -> DataFrame:
    return cut_lineage(build()) if store is None else store.table(name, build)
