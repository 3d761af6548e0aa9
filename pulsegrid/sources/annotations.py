"""Annotation texts: a preamble, a header line with a free delimiter, one event per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.blocks import global_rank
from pulsegrid.schema import ANNOTATION_SCHEMA
from pulsegrid.sources.recordings import file_path, file_stem

_REQUIRED = ("onset", "duration", "description")
_DELIMITERS = ("\t", ";", "|", ",")


def _is_header(line: Column) -> Column:
    low = F.lower(line)
    return F.contains(low, F.lit("onset")) & F.contains(low, F.lit("duration")) & F.contains(low, F.lit("description"))


def _cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; delimiters inside double quotes do not split."""
    pattern = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    return F.transform(F.split(line, pattern), lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per file: (path, lines, head) with `head` the 1-based line of the header, 0 if none.

    Annotation files list the events of one recording, so one file is a small row.
    """
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(file_path().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    )
    head = F.coalesce(F.array_position(F.transform("lines", _is_header), True), F.lit(0))
    return texts.withColumn("head", head)


def bad_files(files: DataFrame) -> DataFrame:
    """Files without a usable header."""
    return files.where(F.col("head") == 0).select("path")


def read_annotations(spark: SparkSession, path: str, pattern: str = "*.txt", strict: bool = False) -> DataFrame:
    """(ann_key, ann_pos, onset, duration, description, generalization) as text, one row per line.

    Columns are found by name in the header, whatever their order. `ann_pos` keeps the order of
    files (by path) and of lines. strict: a file without a header fails the job instead of giving no rows.
    """
    files = read_files(spark, path, pattern)
    if strict:
        told = F.concat(F.lit("no annotation header in "), F.col("path"))
        files = files.withColumn("head", F.when(F.col("head") > 0, F.col("head")).otherwise(F.raise_error(told).cast("bigint")))
    files = files.where(F.col("head") > 0)
    header = F.lower(F.element_at("lines", F.col("head").cast("int")))
    delimiter = F.coalesce(*[F.when(F.contains(header, F.lit(d)), F.lit(d)) for d in _DELIMITERS], F.lit(" "))
    parsed = files.withColumn("_d", delimiter).withColumn("_h", _cells(header, F.col("_d")))

    def place(name: str, exact: bool = False) -> Column:
        test = (lambda c: c == name) if exact else (lambda c: F.contains(c, F.lit(name)))
        return F.array_position(F.transform("_h", test), True).cast("int")

    located = parsed.withColumns({f"_{n}": place(n) for n in _REQUIRED}).withColumn(
        "_generalization", place("generalization", exact=True)
    )
    lines = located.select(
        "path", "head", "_d", *[f"_{n}" for n in (*_REQUIRED, "generalization")],
        F.posexplode("lines").alias("_n", "_line"),
    ).where((F.col("_n") >= F.col("head")) & (F.trim("_line") != ""))
    lines = lines.withColumn("_cells", _cells(F.col("_line"), F.col("_d")))

    def cell(name: str) -> Column:
        place = F.col(f"_{name}")
        return F.nullif(F.when(place > 0, F.try_element_at("_cells", place)), F.lit("")).alias(name)

    lines = lines.join(global_rank(files, "path", "_file"), "path")
    return lines.select(
        F.substring_index(file_stem(F.col("path")), "_", 1).alias("ann_key"),
        (F.shiftleft("_file", 31) + F.col("_n")).alias("ann_pos"),
        *[cell(n) for n in (*_REQUIRED, "generalization")],
    ).to(ANNOTATION_SCHEMA)
