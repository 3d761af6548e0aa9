"""Piece vocabularies as tries over arrays, which the encoder and the token counter walk for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"  # the visible space of piece files
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5  # fixed values: kinds of pieces in the files
_EMPTY = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool  # scores are an order of merges, not weights to be added
    dummy_prefix: bool
    squeeze: bool  # runs of spaces count as one
    byte_fallback: bool
    character_map: bytes = b""  # the file's compiled map, for the normaliser

    @property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.kinds == UNKNOWN)[0])

    def byte_ids(self) -> np.ndarray:
        out = np.full(256, self.unknown)
        for i in np.flatnonzero(self.kinds == BYTE):
            out[int(self.pieces[i][3:5], 16)] = i
        return out


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model file; what this package cannot do the same way is refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = np.array([p.type for p in model.pieces])
    norm, trainer = model.normalizer_spec, model.trainer_spec
    if not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix or (kinds == USER).any():
        raise ValueError("plain or trailing spaces and user-defined pieces are not supported")
    return Vocabulary(
        [p.piece for p in model.pieces], np.array([p.score for p in model.pieces], dtype=np.float32), kinds,
        trainer.model_type == 2, norm.add_dummy_prefix, norm.remove_extra_whitespaces, trainer.byte_fallback,
        norm.precompiled_charsmap,
    )


class Table:
    """Whole numbers to whole numbers, by open addressing; -1 where a key is not there."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(4, (8 * len(entries)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        for key, value in entries.items():
            slot = (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> (64 - self.bits)
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.values[slot] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


class PieceTrie:
    """A trie over strings: `step` follows one character from many nodes at once; `piece` is the id
    that ends at a node, or -1. Node 0 is the root."""

    def __init__(self, strings: dict[str, int]):
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for text, number in strings.items():
            node = 0
            for c in text:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
            ends[node] = number
        self.table = Table({node << 21 | c: to for (node, c), to in edges.items()})
        self.piece = np.full(len(edges) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, strings), default=0)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return self.table.get(nodes.astype(np.uint64) << np.uint64(21) | chars.astype(np.uint64))


def unknown_score(v: Vocabulary) -> np.float32:
    """The weight of a character without a piece: ten below the worst piece, as in the format's library."""
    normal = v.scores[v.kinds == NORMAL]
    return np.float32(normal.min() - 10) if len(normal) else np.float32(-10)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, offsets)."""
    chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return chars, np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))])


def utf8_length(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


def ragged(flat: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of `flat` one after the other, and their lengths."""
    lengths = (first[1:] - first[:-1])[which]
    ends = np.cumsum(lengths)
    at = np.repeat(first[which] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], lengths
