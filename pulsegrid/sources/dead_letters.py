"""What a run could not use, with a reason, in a table beside its results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lenient_int

# kind: row, file or fit; place: whose it is; position: where in it; content: as it was
LETTER = "kind string, place string, position long, content string, reason string"


def _letters(df: DataFrame, kind: str, place: Column, position: Column, content: Column, reason: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), place.cast("string").alias("place"), position.cast("long").alias("position"),
        content.cast("string").alias("content"), reason.alias("reason"),
    )


def annotation_reason() -> Column:
    """Why a line of an annotation (as text) cannot be labelled with; null if it can."""
    onset, duration = lenient_int("onset"), lenient_int("duration")
    return (
        F.when(F.coalesce("onset", F.lit("")) == "", "no onset").when(onset.isNull(), "onset is not a number")
        .when(F.coalesce("duration", F.lit("")) == "", "no duration").when(duration.isNull(), "duration is not a number")
    )


def split_annotations(notes: DataFrame, place: str = "ann_key") -> tuple[DataFrame, DataFrame]:
    """(lines that can be used, letters of the others); every line is in one of the two."""
    reason = annotation_reason()
    content = F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in ("onset", "duration", "description") if c in notes.columns])
    bad = _letters(notes.where(reason.isNotNull()), "row", F.col(place), F.col("ann_pos"), content, reason)
    return notes.where(reason.isNull()), bad


def bad_ticks(raw: DataFrame) -> DataFrame:
    """Letters of the lines of recordings whose clock is there but is not a number."""
    text = F.trim("ticks")
    odd = raw.where((text != "") & F.col("ticks").try_cast("double").isNull())
    return _letters(odd, "row", F.concat_ws("/", "grp", "record"), F.col("file_pos"), F.col("ticks"), F.lit("clock is not a number"))


def files_without(files: DataFrame, reason: str) -> DataFrame:
    """Letters of the files in `files` (path)."""
    return _letters(files, "file", F.col("path"), F.lit(None), F.lit(None), F.lit(reason))


def failed_fits(spark: SparkSession, failures: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(failures.items()), "model string, error string")  # a row per model
    return _letters(rows, "fit", F.col("model"), F.lit(None), F.lit(None), F.col("error"))


def write_letters(path: str, *letters: DataFrame) -> None:
    """Add letters to the table at `path`, under the time of this run."""
    rows = reduce(DataFrame.unionByName, letters)
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
