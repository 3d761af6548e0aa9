"""Interning of n-grams: an open-addressed NumPy table with xxhash64 keys and byte verification."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# --- fixed values: the primes of the published XXH64 ---
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_EDGE = 40  # bytes behind the buffer that a look at eight bytes may touch


def _crc_tables() -> list[np.ndarray]:
    """What one to four bytes do to a CRC-32 (the reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    tables = [table]
    for _ in range(3):
        tables.append(table[tables[-1] & 255] ^ (tables[-1] >> 8))
    return tables


_CRC = _crc_tables()
FAR = 64  # bytes by which a CRC-32 is moved on at once, at most


def _shift_tables() -> np.ndarray:
    """What 0 to FAR zero bytes make of each byte of a CRC-32."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    steps = [now]
    for _ in range(FAR):
        now = _CRC[0][now & 255] ^ (now >> 8)
        steps.append(now)
    return np.stack(steps).reshape(-1)


_SHIFTS = _shift_tables()


def crc32_joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of pairs of texts from those of their halves; `size` is the right half's, FAR at most."""
    base = size.astype(np.int64) << 10
    moved = _SHIFTS[base + (left & 255)] ^ _SHIFTS[base + 256 + ((left >> 8) & 255)]
    moved ^= _SHIFTS[base + 512 + ((left >> 16) & 255)] ^ _SHIFTS[base + 768 + (left >> 24)]
    return moved ^ right


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


class Spans:
    """Byte spans of one buffer, to be hashed and compared many at a time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(_EDGE, np.uint8)])
        self._eight = np.ndarray(len(data) + _EDGE - 8, dtype="<u8", buffer=padded, strides=(1,))
        self._four = np.ndarray(len(data) + _EDGE - 8, dtype="<u4", buffer=padded, strides=(1,))
        self._one = padded

    def xxhash64(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XXH64 with seed 0 of each span."""
        with np.errstate(over="ignore"):
            value = np.full(len(start), _P5, dtype=np.uint64)
            at = start.copy()
            wide = np.flatnonzero(size >= 32)
            if len(wide):
                value[wide], at[wide] = self._stripes(start[wide], size[wide])
            value += size.astype(np.uint64)
            end = start + size
            while (k := np.flatnonzero(end - at >= 8)).size:
                lane = self._eight[at[k]]
                value[k] = _rotl(value[k] ^ _round(np.uint64(0), lane), 27) * _P1 + _P4
                at[k] += 8
            if (k := np.flatnonzero(end - at >= 4)).size:
                value[k] = _rotl(value[k] ^ self._four[at[k]].astype(np.uint64) * _P1, 23) * _P2 + _P3
                at[k] += 4
            while (k := np.flatnonzero(at < end)).size:
                value[k] = _rotl(value[k] ^ self._one[at[k]].astype(np.uint64) * _P5, 11) * _P1
                at[k] += 1
            value = (value ^ (value >> np.uint64(33))) * _P2
            value = (value ^ (value >> np.uint64(29))) * _P3
            return value ^ (value >> np.uint64(32))

    def _stripes(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whole stripes of 32 bytes of long spans, before the size is added."""
        sums = [np.full(len(start), v, dtype=np.uint64) for v in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        at, last = start.copy(), start + size - 32
        while (k := np.flatnonzero(at <= last)).size:
            for lane in range(4):
                sums[lane][k] = _round(sums[lane][k], self._eight[at[k] + 8 * lane])
            at[k] += 32
        value = _rotl(sums[0], 1) + _rotl(sums[1], 7) + _rotl(sums[2], 12) + _rotl(sums[3], 18)
        for one in sums:
            value = (value ^ _round(np.uint64(0), one)) * _P1 + _P4
        return value, at

    def crc32(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The CRC-32 of each span, four bytes at a time with the published tables of that many steps."""
        t0, t1, t2, t3 = _CRC
        value = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
        at, end = start.copy(), start + size
        live = np.flatnonzero(size >= 4)
        while live.size:
            x = value[live] ^ self._four[at[live]]
            value[live] = t3[x & 255] ^ t2[(x >> 8) & 255] ^ t1[(x >> 16) & 255] ^ t0[x >> 24]
            at[live] += 4
            live = live[end[live] - at[live] >= 4]
        live = np.flatnonzero(at < end)
        while live.size:
            x = value[live]
            value[live] = t0[(x ^ self._one[at[live]]) & 255] ^ (x >> 8)
            at[live] += 1
            live = live[at[live] < end[live]]
        return ~value

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of `size` bytes at a and at b have the same bytes."""
        same = np.ones(len(a), dtype=bool)
        live, done = np.arange(len(a)), 0
        while live.size:
            left = size[live] - done
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            good = (self._eight[a[live] + done] ^ self._eight[b[live] + done]) & mask == 0
            same[live[~good]] = False
            done += 8
            live = live[good & (left > 8)]
        return same


class Interned:
    """The distinct spans among many: `slot` of each occurrence, and per slot the span's `start`, `size`,
    `count` and `bucket`. Slots of the table that stay empty have count 0.

    The table holds at least twice as many slots as spans; a span goes to the slot its key names, or to the
    next one that is free or holds the same bytes. All spans take a step together: of those that
    find a free slot one settles there, and all compare themselves with whoever holds it.
    """

    def __init__(self, spans: Spans, start: np.ndarray, size: np.ndarray, buckets: int, crc32: Callable[[np.ndarray], np.ndarray] | None = None):
        """`crc32` gives the checksums of the spans of these numbers, if there is a shorter way than over their bytes."""
        slots = 1 << max(4, int(2 * len(start)).bit_length())
        mask = np.int32(slots - 1)
        key = spans.xxhash64(start, size)
        holder = np.full(slots, -1, dtype=np.int32)
        self.slot = (key & np.uint64(mask)).astype(np.int32)
        live = np.arange(len(start), dtype=np.int32)
        while live.size:
            at = self.slot[live]
            free = np.flatnonzero(holder[at] < 0)
            holder[at[free]] = live[free]
            held = holder[at]
            other = np.flatnonzero(held != live)  # the rest have settled
            held, at, live = held[other], at[other], live[other]
            same = (key[held] == key[live]) & (size[held] == size[live])
            sure = np.flatnonzero(same)
            same[sure] = spans.equal(start[held[sure]], start[live[sure]], size[live[sure]])
            live = live[~same]
            self.slot[live] = (at[~same] + 1) & mask
        self.count = np.bincount(self.slot, minlength=slots)
        self.used = np.flatnonzero(self.count)
        first = holder[self.used]
        self.bucket = np.zeros(slots, dtype=np.int32)
        checks = spans.crc32(start[first], size[first]) if crc32 is None else crc32(first)
        self.bucket[self.used] = checks % np.uint32(buckets)
