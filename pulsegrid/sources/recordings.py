"""Raw recordings: CSV files whose headers differ from file to file, read in one pass.

Files are cut into ranges of bytes. The task that reads a range looks at the header of its file, reads the lines
that begin in its range, and hands on the same few text columns whatever the layout is: nothing about headers
or paths passes through the driver, and a plan does not grow with the number of layouts.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.operators.cleaning import any_core_filter, canonical_names, canonicalise, elapsed_from_ticks
from pulsegrid.schema import CHANNELS, KEYS, TIME
from pulsegrid.session import cut_lineage

RANGE_BYTES = 64 << 20  # of a file that one task reads
CHUNK_BYTES = 8 << 20  # parsed at a time
HEADER_BYTES = 1 << 16  # looked at first for the end of the header

RAW_SCHEMA = "grp string, record string, file_pos long, ticks string, " + ", ".join(f"{c} string" for c in CHANNELS)


def file_path() -> Column:
    """Path of the file a row comes from, with the percent escapes of `_metadata` undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def raw_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(grp, record, path, size, mtime) of every file that is not empty, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.col("path")
    return found.where("length > 0").select(
        parent_folder(name).alias("grp"), file_stem(name).alias("record"), "path", F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


# ---- one range of one file ----

def open_file(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, by the path a listing gives."""
    local = re.match(r"(?:file:/*)?(/.*)", path)
    if local and not re.match(r"(?!file:)\w+:", path):
        return pafs.LocalFileSystem().open_input_file("/" + local[1].lstrip("/"))
    store, place = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(place)


def _header(file: pa.NativeFile) -> tuple[list[str], int]:
    """The cells of the first line, and where the next one begins."""
    file.seek(0)
    line = b""
    while b"\n" not in line and (more := file.read(HEADER_BYTES)):
        line += more
    line = line.partition(b"\n")[0]
    text = line.decode("utf-8", "replace").lstrip("﻿").rstrip("\r")
    return next(csv.reader([text]), []), len(line) + 1


def _chunks(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """Whole lines that begin in [start, stop), some megabytes at a time."""
    file.seek(start)
    at, rest = start, b""
    while at < stop:
        more = file.read(min(CHUNK_BYTES, stop - at))
        if not more:
            break
        at += len(more)
        whole, end, rest = (rest + more).rpartition(b"\n")
        if end:
            yield whole + end
    while rest and not rest.endswith(b"\n") and (more := file.read(HEADER_BYTES)):  # the last line goes on behind the range
        line, end, _ = more.partition(b"\n")
        rest += line + end
    if rest:
        yield rest


def _table(lines: bytes, width: int) -> list[pa.Array]:
    """Text columns of some lines. Short lines are filled with nulls, what is beyond the header's width is left out."""
    names = [f"c{i}" for i in range(width)]
    try:
        table = pacsv.read_csv(
            io.BytesIO(lines),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(lines), 1)),
            parse_options=pacsv.ParseOptions(),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), null_values=[], strings_can_be_null=False),
        )
        return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    except pa.ArrowInvalid:  # a line of another width, or bytes that are not text: line by line
        rows = [r for r in csv.reader(io.StringIO(lines.decode("utf-8", "replace"), newline="")) if r]
        return [pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(width)]


def read_range(path: str, start: int, stop: int, opened: Callable[[str], pa.NativeFile] = open_file) -> Iterator[pa.RecordBatch]:
    """The canonical text columns of the lines that begin in [start, stop); none for a file without a
    known channel. `file_pos` grows along the file: the range's first byte, plus the lines before in the range."""
    with opened(path) as file:
        header, body = _header(file)
        names = canonical_names(header) if header else {}
        place = {name: header.index(h) for h, name in names.items()}
        if not set(place) & set(CHANNELS):
            return
        parts = Path(path).parts
        group, record = parts[-2], re.sub(r"\.[^.]*$", "", parts[-1])
        begin = body
        if start > body:  # the line that holds the byte before belongs to the range before
            file.seek(start - 1)
            begin = start - 1
            while (more := file.read(HEADER_BYTES)) and b"\n" not in more:
                begin += len(more)
            begin += more.find(b"\n") + 1
        done = 0
        for lines in _chunks(file, begin, stop) if begin < stop else ():
            columns = _table(lines, len(header))
            n = len(columns[0])
            absent = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * n), pa.array([record] * n), pa.array(range(start + done, start + done + n), pa.int64()), columns[0],
                 *[columns[place[c]] if c in place else absent for c in CHANNELS]],
                ["grp", "record", "file_pos", "ticks", *CHANNELS])
            done += n


# ---- as a data source, and for the files of a table ----

class FileRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*.csv")
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[FileRange]:
        """Ranges of all files below the path; only the listing is read."""
        scheme = re.match(r"(\w+://[^/]*)?", self.path)[0]
        store, place = (pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", self.path)) if not scheme or scheme.startswith("file") else pafs.FileSystem.from_uri(quote(self.path, safe=":/@"))
        files = store.get_file_info(pafs.FileSelector(place, recursive=True))
        wanted = [f for f in files if f.is_file and f.size and fnmatch.fnmatch(f.base_name, self.pattern)]
        name = lambda f: f.path if isinstance(store, pafs.LocalFileSystem) else f"{scheme}/{f.path.lstrip('/')}"
        return [FileRange(name(f), at, min(at + self.size, f.size)) for f in wanted for at in range(0, f.size, self.size)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition.path, partition.start, partition.stop)


class RecordingSource(DataSource):
    """`spark.read.format("recordings").load(folder)`: the raw text columns of every recording below a folder.

    Options: `pathGlobFilter` (default *.csv) and `rangeBytes`.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def on_workers_path(spark: SparkSession) -> None:
    """Workers that share the file system find this checkout; a cluster gets the package with --py-files."""
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])


def read_raw(files: DataFrame, size: int = RANGE_BYTES, opened: Callable[[str], pa.NativeFile] = open_file) -> DataFrame:
    """The raw text columns of the files in `files` (path, size), as a data source over the whole folder gives
    them. Paths go from the table to the tasks; each file is opened once for each of its ranges."""
    spark = files.sparkSession
    on_workers_path(spark)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))
    ranges = files.select("path", "size", start.alias("start")).select("path", "start", F.least(F.col("start") + size, "size").alias("stop"))
    ranges = cut_lineage(ranges)
    tasks = min(max(ranges.count(), 1), 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_range(row["path"], row["start"], row["stop"], opened)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, RAW_SCHEMA)


def cleaned(raw: DataFrame) -> DataFrame:
    """Raw text columns -> seconds since the first tick and numbers; rows without any value go.

    The rows are checkpointed in between, so that texts are read and parsed once.
    """
    rows = cut_lineage(canonicalise(raw))
    return any_core_filter(elapsed_from_ticks(rows)).select(*KEYS, TIME, *CHANNELS, "file_pos")


def read_recordings(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Every recording under `path`, canonical: seconds since the first tick, four channels, rows
    with at least one value. Files without a known channel, rows or ticks drop out."""
    on_workers_path(spark)
    spark.dataSource.register(RecordingSource)
    return cleaned(spark.read.format("recordings").option("pathGlobFilter", pattern).load(path))
