"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.arrow import FOLDED_WORDS, Words, append_columns, lists_of, mix, slices
from pulsegrid.session import cut_lineage

LANE = 512  # window ends that one lane of the scan walks through
STEPS = 8  # a part of the benchmark is put together from slices of at most two steps
SUM_BLOCK = 50_000  # rows whose bytes are summed in one sort


def _block_codes(hashes: np.ndarray, block: int) -> np.ndarray:
    """For each word a code of the `block` words that end there."""
    if block == 1 or len(hashes) < 2:
        return hashes
    return np.append(hashes[:1], mix(hashes[:-1] * np.uint64(3) ^ hashes[1:]))


@dataclass
class Items:
    """The words of all items in one buffer: the folded words themselves, each followed by a zero byte."""

    names: list[str]
    first: np.ndarray  # number of the first word of each item, and the number of words
    raw: bytes
    at: np.ndarray  # byte each word begins at, and the end

    def text(self, word: int, length: int) -> bytes:
        return self.raw[self.at[word] : self.at[word + length]]

    def item_of(self, word: int) -> int:
        return int(np.searchsorted(self.first, word, side="right")) - 1


@dataclass
class WuManber:
    """Patterns of `length` words: shifts by block of words, and buckets by the last block. All arrays are flat; a
    pattern is the number of its first word."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray  # half of the code of each pattern's last block, ascending
    word: np.ndarray
    again: np.ndarray  # patterns that stand in further items, ascending, and ..
    again_item: np.ndarray  # .. those items
    check: np.ndarray  # half of the hash of each word, shared by all matchers

    @classmethod
    def build(cls, length: int, starts: np.ndarray, hashes: np.ndarray, items: Items, check: np.ndarray) -> WuManber:
        """`starts` are the first words of all windows, `hashes` those of all words."""
        block = min(2, length)
        value = np.zeros(len(starts), dtype=np.uint64)
        for j in range(length):
            value = mix(value ^ hashes[starts + j])
        order = np.argsort(value, kind="stable")
        head = np.append(True, value[order][1:] != value[order][:-1])
        kept, group = starts[order[head]], np.cumsum(head) - 1
        more: set[tuple[int, int]] = set()
        odd = []
        for i in np.flatnonzero(~head).tolist():  # a window that stands twice: its item belongs to the first one
            one, two = int(kept[group[i]]), int(starts[order[i]])
            if items.text(one, length) != items.text(two, length):
                odd.append(two)  # equal hashes by chance
            elif items.item_of(one) != items.item_of(two):
                more.add((one, items.item_of(two)))
        kept = np.concatenate([kept, np.array(odd, dtype=np.int64)])
        codes = _block_codes(hashes, block)
        bits = max(12, (8 * len(kept)).bit_length())
        shift = np.full(1 << bits, length - block + 1, dtype=np.uint8 if length < 256 else np.uint32)
        for j in range(block - 1, length):
            np.minimum.at(shift, (codes[kept + j] >> np.uint64(64 - bits)).astype(np.int64), length - 1 - j)
        key = (codes[kept + length - 1] >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(key, kind="stable")
        found = sorted(more)
        return cls(length, block, bits, shift, key[order], kept[order].astype(np.int32), np.array([w for w, _ in found], np.int32), np.array([i for _, i in found], np.int32), check)

    def find(self, words: Words, items: Items) -> list[tuple[int, int]]:
        """(index of the first word, pattern) of every occurrence."""
        codes = _block_codes(words.hash, self.block)
        long = np.flatnonzero(words.count >= self.length)
        lanes = -(-(words.count[long] - self.length + 1) // LANE)
        text = np.repeat(long, lanes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = words.first[text] + self.length - 1 + step * LANE
        stop = np.minimum(at + LANE, words.first[text + 1])
        ends = []
        while len(at):
            shift = self.shift[codes[at] >> np.uint64(64 - self.bits)].astype(np.int64)
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return self._confirm(words, ends, codes, items)

    def _confirm(self, words: Words, ends: np.ndarray, codes: np.ndarray, items: Items) -> list[tuple[int, int]]:
        key = (codes[ends] >> np.uint64(32)).astype(np.uint32)
        low, high = (np.searchsorted(self.suffix, key, side=s) for s in ("left", "right"))
        many = high - low
        ends, bucket = np.repeat(ends, many), np.repeat(low, many)
        bucket = bucket + np.arange(len(bucket)) - np.repeat(np.cumsum(many) - many, many)
        begin, pattern = ends - self.length + 1, self.word[bucket].astype(np.int64)
        for j in range(self.length):
            same = (words.hash[begin + j] >> np.uint64(32)).astype(np.uint32) == self.check[pattern + j]
            begin, pattern = begin[same], pattern[same]
        found = []
        for b, p in zip(begin.tolist(), pattern.tolist()):
            span = words.bytes[words.start[b] : words.end[b + self.length - 1]].tobytes()
            if b"".join(w + b"\0" for w in span.split(b"\0") if w) == items.text(p, self.length):
                found.append((b, p))
        return found

    def items_of(self, pattern: int, items: Items) -> list[str]:
        low, high = np.searchsorted(self.again, [pattern, pattern + 1])
        return [items.names[items.item_of(pattern)], *[items.names[i] for i in self.again_item[low:high]]]


def index_items(items: list[tuple[str, str]], window: int) -> tuple[Items, list[WuManber]]:
    """The items' words, and one matcher for each pattern length that occurs: `window`, and less for shorter items.

    Memory is bounded by the items' bytes: about 16 bytes a word beside the words, and 8 to 16 for the shifts.
    """
    counts, hashes, raw, sizes = [], [], [], []
    for piece in slices(pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in items], pa.string())], ["text"])):
        words = Words(piece.column("text"), FOLDED_WORDS)
        counts.append(words.count)
        hashes.append(words.hash)
        wide = words.end - words.start
        sizes.append(wide + 1)
        flat = np.zeros(int(wide.sum()) + len(wide), dtype=np.uint8)
        flat[np.arange(int(wide.sum())) + np.repeat(np.arange(len(wide)), wide)] = words.bytes[words.bytes != 0]
        raw.append(flat.tobytes())
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    held = Items([name for name, _ in items], first, b"".join(raw), at.astype(np.int32 if at[-1] < 1 << 31 else np.int64))
    check = (hashes >> np.uint64(32)).astype(np.uint32)
    matchers = []
    for size in sorted({min(window, int(c)) for c in count} - {0}):
        mine = np.flatnonzero(count >= window) if size == window else np.flatnonzero(count == size)
        many = count[mine] - size + 1
        starts = np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        matchers.append(WuManber.build(size, starts, hashes, held, check))
    return held, matchers


def _scan(batch: pa.RecordBatch, index: tuple[Items, list[WuManber]]) -> dict[str, pa.Array]:
    held, matchers = index
    words = Words(batch.column("text"), FOLDED_WORDS)
    texts = len(words.count)
    edge = np.zeros(len(words.hash) + 1, dtype=np.int32)
    items: list[set] = [set(x) for x in batch.column("hit_items").to_pylist()]
    for name, sign in (("hit_starts", 1), ("hit_ends", -1)):  # what earlier parts of the benchmark have hit
        column = batch.column(name)
        lengths = np.diff(column.offsets.to_numpy())
        np.add.at(edge, column.flatten().to_numpy() + np.repeat(words.first[:-1], lengths), sign)
    for matcher in matchers:
        known: dict[int, list[str]] = {}
        for begin, pattern in matcher.find(words, held):
            edge[begin] += 1
            edge[begin + matcher.length] -= 1
            if pattern not in known:
                known[pattern] = matcher.items_of(pattern, held)
            items[words.doc[begin]].update(known[pattern])
    hit = np.cumsum(edge)[:-1] > 0
    same = hit[1:] & hit[:-1] & (words.doc[1:] == words.doc[:-1])
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~same
    closes[:-1] &= ~same
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, words.first)
    base = np.repeat(words.first[:-1], np.diff(first))
    return {
        "n_words": pa.array(words.count, pa.int64()),
        "hit_starts": lists_of(starts - base, first, pa.int32()),
        "hit_ends": lists_of(ends - base, first, pa.int32()),
        "hit_items": pa.array([sorted(s) for s in items], pa.list_(pa.string())),
    }


def _parts(items: DataFrame, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct (item, text), in lists of at most `part_bytes` UTF-8 bytes; a longer row is alone."""
    items = items.distinct().withColumn("_bytes", (F.octet_length("item") + F.octet_length("text")).cast("long"))
    facts = items.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if facts["b"] <= part_bytes:
        yield [tuple(r) for r in items.select("item", "text").collect()]
        return
    step = max(1, part_bytes // STEPS)
    blocks = max(16, facts["n"] // SUM_BLOCK, facts["b"] // part_bytes)
    items = cut_lineage(items.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))
    long = items.where(F.col("_bytes") > step).withColumn("_slice", -1 - F.monotonically_increasing_id())
    # the others fall into steps of their running sum: inside blocks, plus the bytes of the blocks before
    short = items.where(F.col("_bytes") <= step)
    sums = sorted(tuple(r) for r in short.groupBy("_block").agg(F.sum("_bytes")).collect())  # bounded like the parts
    starts = accumulate([0, *[n for _, n in sums]])
    offsets = items.sparkSession.createDataFrame([(block, at) for (block, _), at in zip(sums, starts)], "_block long, _before long")
    inside = Window.partitionBy("_block").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_bytes").over(inside), F.lit(0))
    short = short.join(offsets, "_block").withColumn("_slice", F.floor(start / step)).drop("_before")
    sliced = cut_lineage(long.unionByName(short).select("item", "text", "_bytes", "_slice"))
    parts, held = [], part_bytes + 1
    for r in sorted(sliced.groupBy("_slice").agg(F.sum("_bytes").alias("b")).collect()):  # bounded by total / part_bytes
        if held + r["b"] > part_bytes:
            parts.append([])
            held = 0
        parts[-1].append(r["_slice"])
        held += r["b"]
    for slices in parts:
        yield [tuple(r) for r in sliced.where(F.col("_slice").isin(slices)).select("item", "text").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """`docs` with n_words, the word ranges hit (hit_starts, hit_ends; merged) and hit_items.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A pattern is `window` consecutive words
    of an item, or the whole item if it has fewer, but not none. Every word inside an occurrence is
    hit; hit_items are the ids of the items with an occurring pattern, as strings in string order.

    The patterns of at most `part_bytes` of distinct ids and texts, or of one longer item, are indexed and sent to the
    tasks at once, in at most 6 bytes for each of text (200 MB for 32 MB, tested); a larger benchmark is searched for part by part, in chained passes that carry the
    hits on.

    A null text has no words. Items without words match nothing; items of equal text are all found; a
    null item_id is called "null". Repeated rows get equal results, an empty table stays empty, an
    empty benchmark hits nothing. Columns of the same names are replaced, others kept.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    none = F.array().cast("array<int>")
    names = {"hit_starts": none, "hit_ends": none, "hit_items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")}
    out = docs.withColumns(names)
    for part in _parts(items, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index_items(part, window))
        out = append_columns(
            out, "text", "n_words long, hit_starts array<int>, hit_ends array<int>, hit_items array<string>",
            lambda batch, shared=shared: _scan(batch, shared.value),
        )
    return out


def hit_words() -> Column:
    """The number of words inside the ranges."""
    return F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
