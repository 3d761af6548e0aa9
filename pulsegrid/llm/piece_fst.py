"""SentencePiece encoding and decoding by weighted transducers.

The normaliser (a trie of what the file's character map rewrites, whose final states write the result; dummy prefix,
visible spaces), the pieces (a trie whose final states write ids) and the byte fallback are compiled once. Composing them with a text gives a lattice whose arcs are
pieces; the encoding is its shortest path in the tropical semiring. For unigram files an arc weighs
minus the piece's score. For merge files (BPE) the weights sit on pairs of arcs: 0 if two pieces
stay apart when the merges are applied to them side by side, infinite if a merge reaches across. One
path alone has a finite weight then, and it is what merging gives.

No piece has a space behind another character, so a text falls apart before every space, and equal
parts have equal encodings: a task composes each distinct part once, all parts of a batch in step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pulsegrid.llm.arrow import append_columns, lists_of
from pulsegrid.llm.normaliser import Normaliser
from pulsegrid.llm.pieces import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, PieceTrie, Table, Vocabulary, code_points, ragged, unknown_score

MEMO_CHARS = 4 << 20  # characters of distinct parts that a task remembers


def merge_up(text: str, rank: dict[str, int]) -> list[tuple]:
    """Apply merges, best rank first, then leftmost; a node is (text, left node, right node)."""
    nodes = [(c, None, None) for c in text]
    while len(nodes) > 1:
        best = min((rank.get(a[0] + b[0], 1 << 60), i) for i, (a, b) in enumerate(zip(nodes, nodes[1:])))
        if best[0] == 1 << 60:
            break
        i = best[1]
        nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], nodes[i], nodes[i + 1])]
    return nodes


@dataclass
class MergePairs:
    """Which two pieces may stand side by side in the result of merging.

    Merging `a` and `b` apart passes through the right ends of `a` and the left ends of `b`, each there
    from the rank it is made at until the rank it is used up at. A merge z = xy reaches across if x
    and y are there together and z ranks before what uses them up (left before right at equal rank).
    """

    right: np.ndarray  # pieces x depth: right ends, -1 beyond the last
    left: np.ndarray
    right_gone: np.ndarray  # the rank at which each is used up
    left_gone: np.ndarray
    rank: np.ndarray
    merged: Table

    @classmethod
    def build(cls, ids: dict[str, int], rank_of: dict[str, int], size: int) -> tuple[MergePairs, dict[str, int]]:
        """Also the pieces that merging can make; the others never occur."""
        never = 1 << 30
        spines, whole = {}, {}
        for text, number in ids.items():
            nodes = merge_up(text, rank_of)
            if len(nodes) == 1:
                whole[text] = number
                spines[number] = [cls._spine(nodes[0], side, ids, rank_of, never) for side in (2, 1)]
        depth = max((len(s) for pair in spines.values() for s in pair), default=1)
        shape = (size, depth)
        arrays = [np.full(shape, -1, dtype=np.int32), np.full(shape, -1, dtype=np.int32), np.zeros(shape, np.int64), np.zeros(shape, np.int64)]
        for number, pair in spines.items():
            for side, spine in enumerate(pair):
                for d, (piece, gone) in enumerate(spine):
                    arrays[side][number, d], arrays[2 + side][number, d] = piece, gone
        rank = np.zeros(size, dtype=np.int64)
        for text, number in ids.items():
            rank[number] = rank_of.get(text, -1) if len(text) > 1 else -1
        merged = {
            ids[t[:i]] << 32 | ids[t[i:]]: rank_of[t] for t in rank_of for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids
        }
        return cls(*arrays, rank, Table(merged)), whole

    @staticmethod
    def _spine(node: tuple, side: int, ids: dict, rank_of: dict, gone: int) -> list[tuple[int, int]]:
        out = []
        while node is not None and node[0] in ids:
            out.append((ids[node[0]], gone))
            gone, node = rank_of.get(node[0], -1), node[side]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, inverse = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)
        a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)
        good = np.ones(len(pairs), dtype=bool)
        for i in range(self.right.shape[1]):
            x = self.right[a, i]
            rows = np.flatnonzero((x >= 0) & good)
            for j in range(self.left.shape[1]):
                y = self.left[b[rows], j]
                rows, y = rows[y >= 0], y[y >= 0]
                if not len(rows):
                    break
                x_in = x[rows]
                z = self.merged.get(x_in.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)).astype(np.int64)
                x_gone, y_gone = self.right_gone[a[rows], i], self.left_gone[b[rows], j]
                together = (self.rank[y] < x_gone) & (self.rank[x_in] <= y_gone)
                good[rows[(z >= 0) & together & (z < x_gone) & (z <= y_gone)]] = False
        return good[inverse]


def merge_pairs(v: Vocabulary, ids: dict[str, int]) -> tuple[MergePairs, dict[str, int]]:
    """The pair weights of a merge file, and the pieces that merging can make."""
    order = sorted((p for p in ids if len(p) > 1), key=lambda p: -v.scores[ids[p]])
    if any(p.startswith(SPACE * 2) for p in ids) or len({v.scores[ids[p]] for p in order}) < len(order):
        raise ValueError("merges of equal rank, or that join spaces to words, are not supported")
    return MergePairs.build(ids, {p: i for i, p in enumerate(order)}, len(v.pieces))


@dataclass
class Encoder:
    """The compiled transducers, and the encodings of the parts a task has met."""

    vocabulary: Vocabulary
    memo: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        v = self.vocabulary
        ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.runs = {len(p): i for p, i in ids.items() if len(p) > 1 and set(p) == {SPACE}}
        self.space = ids.get(SPACE, v.unknown)
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces with a space behind another character are not supported")
        if v.merges:
            self.pairs, ids = merge_pairs(v, {p: i for p, i in ids.items() if i not in self.runs.values()})
            self.part = re.compile(f"{SPACE}[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.pairs = None
            self.part = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.trie = PieceTrie(ids)
        self.normalise = Normaliser(v)
        self.unknown_score = unknown_score(v)
        self.bytes = v.byte_ids()
        self._forget()

    def _forget(self):
        self.memo.clear()
        self.flat, self.first, self.chars = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def lattice(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, length, piece) of every arc; -1 is the fallback over one character without a piece."""
        stop = np.repeat(offsets[1:], np.diff(offsets))
        start = np.arange(len(chars))
        node = np.zeros(len(chars), dtype=np.int64)
        arcs = []
        single = np.zeros(len(chars), dtype=bool)
        for length in range(1, self.trie.longest + 1):
            node = self.trie.step(node, chars[start + length - 1])
            alive = node >= 0
            start, node = start[alive], node[alive]
            piece = self.trie.piece[node]
            ends = piece >= 0
            arcs.append((start[ends], np.full(int(ends.sum()), length), piece[ends]))
            if length == 1:
                single[start[ends]] = True
            more = start + length < stop[start]
            start, node = start[more], node[more]
            if not len(start):
                break
        bare = np.flatnonzero(~single)
        arcs.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1)))
        return tuple(np.concatenate(x) for x in zip(*arcs))

    def shortest(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every character position the best last arc that ends behind it: (piece, length)."""
        start, length, piece = self.lattice(chars, offsets)
        end = start + length - 1
        part = np.searchsorted(offsets, start, side="right") - 1
        order = np.lexsort((start, end, end - offsets[part]))  # in step through all parts; longest arc first
        start, length, piece, end = start[order], length[order], piece[order], end[order]
        depth = (end - offsets[part[order]])
        opens = start == offsets[part[order]]
        last, size = np.full(len(chars), -2, dtype=np.int64), np.zeros(len(chars), dtype=np.int64)
        cost = np.full(len(chars), np.inf, dtype=np.float32)
        weight = np.where(piece >= 0, -self.vocabulary.scores[piece], -self.unknown_score).astype(np.float32)
        cuts = np.searchsorted(depth, np.arange((int(depth[-1]) if len(depth) else -1) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            before = np.where(opens[lo:hi], 0, s - 1)
            if self.pairs is None:
                total = np.where(opens[lo:hi], np.float32(0), cost[before]) + weight[lo:hi]
                heads = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                least = np.repeat(np.minimum.reduceat(total, heads), np.diff(np.append(heads, len(e))))
                fine = np.flatnonzero(total == least)
                fine = fine[np.append(True, e[fine][1:] != e[fine][:-1])]
                cost[e[fine]] = total[fine]
            else:
                prior = np.where(opens[lo:hi], -1, last[before])
                free = prior == -1  # at the start, or behind a character that no merge touches
                fine = free | ((p == -1) & (prior >= 0))
                ask = np.flatnonzero((prior >= 0) & (p >= 0))
                fine[ask] = self.pairs.apart(prior[ask], p[ask])
                fine = np.flatnonzero(fine)
            last[e[fine]], size[e[fine]] = p[fine], length[lo:hi][fine]
        return last, size

    def learn(self, parts: list[str]) -> None:
        """Encode distinct parts and remember them."""
        chars, offsets = code_points(parts)
        last, size = self.shortest(chars, offsets)
        at = offsets[1:] - 1
        number = np.arange(len(parts))
        back = []
        while len(at):  # the paths, from their ends, all parts in step
            if (size[at] == 0).any():
                raise ValueError("the vocabulary leaves a text without a path")
            back.append((number, at, last[at]))
            more = at - size[at] >= offsets[number]
            number, at = number[more], (at - size[at])[more]
        number, at, piece = (np.concatenate(x) for x in zip(*back))
        order = np.lexsort((at, number))
        number, at, piece = number[order], at[order], piece[order]
        bare = piece == -1
        many = np.ones(len(piece), dtype=np.int64)
        ids = piece
        if bare.any():  # write the bytes of characters without a piece
            if self.vocabulary.byte_fallback:
                written = [list(chr(c).encode("utf-8", "surrogatepass")) for c in chars[at[bare]]]
                many[bare] = [len(w) for w in written]
                ids = np.repeat(piece, many)
                ids[np.repeat(bare, many)] = self.bytes[np.concatenate(written).astype(np.int64)]
            else:
                ids = np.where(bare, self.vocabulary.unknown, piece)
        lengths = np.bincount(number, many, len(parts)).astype(np.int64)
        known = len(self.first) - 1
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.memo.update(zip(parts, range(known, known + len(parts))))
        self.chars += len(chars)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if self.chars > MEMO_CHARS:
            self._forget()
        split = [self.part.findall(t) for t in self.normalise(texts)]
        parts = [p for s in split for p in s]
        new = [p for p in dict.fromkeys(parts) if p not in self.memo]
        if new:
            self.learn(new)
        which = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))
        ids, lengths = ragged(self.flat, self.first, which)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        first = ends[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]
        return self._join_spaces(ids, first) if self.pairs is not None and self.runs else (ids, first)

    def _join_spaces(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single spaces left by the other merges become run pieces, longest first from the left."""
        space = ids == self.space
        pair = space[1:] & space[:-1]
        inner = first[1:-1]
        inner = inner[(inner > 0) & (inner < len(ids))]
        pair[inner - 1] = False
        if not pair.any():
            return ids, first
        opens = np.flatnonzero(np.append(True, ~pair) & space) if len(ids) else []
        closes = np.flatnonzero(np.append(~pair, True) & space) + 1
        keep = np.ones(len(ids), dtype=bool)
        ids = ids.copy()
        longest = max(self.runs)
        for a, b in zip(opens, closes):
            while b - a > 1:
                n = min(b - a, longest)
                while n > 1 and n not in self.runs:
                    n -= 1
                if n > 1:
                    ids[a] = self.runs[n]
                    keep[a + 1 : a + n] = False
                a += n
        kept = np.concatenate([[0], np.cumsum(keep)])
        return ids[keep], kept[first]


class Decoder:
    """The reverse transducer: ids to bytes, bytes to text."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        written = []
        for piece, kind in zip(v.pieces, v.kinds):
            if kind == BYTE:
                written.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                written.append(" ⁇ ".encode())
            else:
                written.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        self.flat = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in written])])
        self.prefix = v.dummy_prefix

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        data, lengths = ragged(self.flat, self.first, ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[first]
        data = data.tobytes()
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:]))
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, name: str = "ids") -> DataFrame:
    """`docs` with the piece ids of the whole text, as SentencePiece gives them.

    Null and empty texts have no ids. Repeated rows get equal ids; an empty table stays empty; a column
    called `name` is replaced. What a task remembers of the parts it has met is bounded and only
    saves time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary))  # as large as the piece file

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, first = shared.value.encode([t or "" for t in batch.column("text").to_pylist()])
        return {name: lists_of(ids, first, pa.int32())}

    return append_columns(docs, "text", f"`{name}` array<int>", work)


def decode_pieces(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`docs` with the text of the ids; a null list gives an empty text, bytes that are no UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(Decoder(vocabulary))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids)
        lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        return {name: pa.array(shared.value.decode(column.flatten().to_numpy(), first), pa.string())}

    return append_columns(docs, ids, f"`{name}` string", work)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`docs` with the columns of `encode_pieces` and of `decode_pieces` after it, from one pass: a task
    needs one worker, and texts travel to it once. Odd rows give what those two give."""
    shared = docs.sparkSession.sparkContext.broadcast((Encoder(vocabulary), Decoder(vocabulary)))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder, decoder = shared.value
        found, first = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
        return {ids: lists_of(found, first, pa.int32()), name: pa.array(decoder.decode(found, first), pa.string())}

    return append_columns(docs, "text", f"`{ids}` array<int>, `{name}` string", work)
