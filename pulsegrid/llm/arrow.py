"""Texts of Arrow batches as flat byte, word and hash arrays, for the operators that run in tasks.

Every helper works on slices of a batch that hold a bounded number of text bytes (a single longer
text stays whole), so that the temporary arrays of a task do not grow with the batch.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pulsegrid import session

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the published splitmix64 finaliser)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(256, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def byte_table(keep: Callable[[int], bool], fold: Callable[[int], int] = int) -> np.ndarray:
    """256 entries: the (folded) byte where it belongs to a word, 0 where it separates words."""
    return np.array([fold(b) if keep(b) else 0 for b in range(256)], dtype=np.uint8)


def ascii_lower(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


# Digits, letters folded A-Z to a-z, and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
FOLDED_WORDS = byte_table(lambda b: b >= 128 or chr(b).isalnum(), ascii_lower)
# Whatever is not ASCII white space: [^\x20\x09-\x0D]. A zero byte is an ordinary character there, so it
# is folded onto 255, a byte that UTF-8 never has.
SPACED_WORDS = byte_table(lambda b: not (b == 32 or 9 <= b <= 13), lambda b: b or 255)
SPACED_FOLDED_WORDS = byte_table(lambda b: not (b == 32 or 9 <= b <= 13), lambda b: ascii_lower(b) or 255)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    values = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts: `doc`, byte `start` and `end`, `hash`; `first` has the index of
    the first word of each text and, at the end, the number of words."""

    def __init__(self, column: pa.Array, table: np.ndarray, kinds: np.ndarray | None = None):
        """`kinds` (256 entries) cuts words also where the kind of byte changes."""
        self.raw, self.offsets = flat_bytes(column)
        self.bytes = table[self.raw]
        inside = self.bytes != 0
        same = inside[1:] & inside[:-1]
        if kinds is not None:
            kind = kinds[self.raw]
            same &= kind[1:] == kind[:-1]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~same
        closes[:-1] &= ~same
        full = np.flatnonzero(np.diff(self.offsets))
        heads, tails = self.offsets[full], self.offsets[full + 1] - 1
        opens[heads] = inside[heads]
        closes[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        up, down = _power_tables(len(self.raw) + 1)
        self._sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[self.bytes] * up[: len(self.raw)], out=self._sums[1:])
        self._down = down
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal spans have equal hashes wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def characters(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each window of n code points inside one text."""
        heads = np.flatnonzero((self.raw & 0xC0) != 0x80)
        text = np.searchsorted(self.offsets, heads, side="right") - 1
        if len(heads) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = np.append(heads, len(self.raw))[n:]
        whole = text[: len(ends)] == text[n - 1 :]
        return text[: len(ends)][whole], self.span_hash(heads[: len(ends)][whole], ends[whole])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window of n words inside one text."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 :])
        value = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            value = mix(value ^ self.hash[at + j])
        return at, value


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; `first` has the start of each run and the total length."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def lists_of(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def give_back() -> None:
    """Return freed memory to the machine: a worker outlives its task, and the next task may be another's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, with this checkout on the workers' path where they share the file system; a cluster
    that does not gets the package with --py-files. Workers give back freed memory when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    df.sparkSession.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    return df.mapInArrow(task, schema)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """Apply `work` to bounded slices of the partitions of `df`; one task, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def append_columns(df: DataFrame, column: str, names: str, work: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """`df` with further columns worked out from bounded slices; columns of the same name are replaced."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(names)
    kept = [f for f in df.schema.fields if f.name not in added.fieldNames()]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = work(batch)
        arrays = [batch.column(batch.schema.names.index(f.name)) for f in kept] + list(new.values())
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + list(new))

    return map_slices(df, step, StructType([*kept, *added.fields]), column)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`, of `rows` rows or one group at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


_made: list[str] = []  # folders written by this driver that nothing has removed yet


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder for written tables, below the checkpoint folder that all machines share."""
    path = f"{session.shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts the lineage, survives lost
    executors, and gives later joins the real size. It stays until `removed` or the end of the driver."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def removed(spark: SparkSession) -> Iterator[None]:
    """Remove the folders written inside the block when it ends. What is to stay must be written elsewhere by then:
    a table that is not computed yet cannot be read any more."""
    before = len(_made)
    try:
        yield
    finally:
        _remove(spark, before)


def _remove(spark: SparkSession, after: int = 0) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    while len(_made) > after:
        place = hadoop.Path(_made.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        _remove(spark)
