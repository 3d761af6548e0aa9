"""A Bloom filter of keys in a table: built in pieces by hash range, each in one task, with room for every key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import map_arrow

KEY_BITS = 16  # of filter for each key
MOST_WORDS = 1 << 24  # 128 MB, the bound of what is broadcast
_PIECE = 1 << 13  # 64-bit words that one task fills at a time


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A blocked Bloom filter: a hash owns up to four bits of one 64-bit word."""
    at = (hashes >> np.uint64(32)) % np.uint64(words)
    mask = np.zeros(len(hashes), dtype=np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return at.astype(np.int64), mask


class Twice:
    """Two Bloom filters, of hashes seen once and of hashes seen twice. `add` gives the hashes that it sees for the
    second time, as far as the filters know. When a pair of filters holds as many hashes as it has room for, a
    pair of twice the size is begun, so that few pairs do for any number and few hashes are taken for others."""

    def __init__(self, words: int):
        self.words = words
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.free = 0

    def add(self, hashes: np.ndarray) -> np.ndarray:
        hashes, counts = np.unique(hashes, return_counts=True)
        once, twice = (self._known(k, hashes) for k in (0, 1))
        new = np.flatnonzero(~once)
        while len(new):
            if not self.free:
                size = self.words << len(self.pairs)
                self.pairs.append((np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)))
                self.free = 64 * size // KEY_BITS
            part, new = new[: self.free], new[self.free :]
            self.free -= len(part)
            self._mark(0, hashes[part])
        again = np.flatnonzero((once | (counts > 1)) & ~twice)
        if len(again):
            self._mark(1, hashes[again])
        return hashes[again]

    def _mark(self, which: int, hashes: np.ndarray) -> None:
        bits = self.pairs[-1][which]
        np.bitwise_or.at(bits, *places(hashes, len(bits)))

    def _known(self, which: int, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        for pair in self.pairs:
            out |= known(pair[which], hashes)
        return out


def bloom_filter(keys: DataFrame, count: int) -> np.ndarray:
    """The filter of the column `hash` (well-mixed longs). Keys are dealt by the piece of the filter they fall
    in, so no pieces have to be merged. With more than 67 million keys the filter lets more strangers
    through, never fewer keys."""
    words = 1 << max(10, min(count * KEY_BITS // 64, MOST_WORDS).bit_length())
    words = min(words, MOST_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, mask = places(batch.column("hash").to_numpy().view(np.uint64), words)
            for piece in np.unique(at // _PIECE).tolist():
                part = at // _PIECE == piece
                bits = held.setdefault(piece, np.zeros(_PIECE, dtype=np.uint64))
                np.bitwise_or.at(bits, at[part] % _PIECE, mask[part])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["piece", "bits"])

    place = F.shiftrightunsigned("hash", 32) % F.lit(words)
    dealt = keys.select("hash").repartition(F.floor(place / _PIECE))
    out = np.zeros(max(words, _PIECE), dtype=np.uint64)
    table = map_arrow(dealt, run, "piece long, bits binary").toArrow()  # `words` * 8 bytes at most
    for piece, bits in zip(table.column("piece").to_pylist(), table.column("bits").to_pylist()):
        out[piece * _PIECE : (piece + 1) * _PIECE] = np.frombuffer(bits, dtype=np.uint64)
    return out[:words]


def known(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, mask = places(hashes, len(bloom))
    return (bloom[at] & mask) == mask
