"""The normaliser of a piece file as a transducer: a trie of what it rewrites, whose final states write something else."""

from __future__ import annotations

import re
import struct

import numpy as np

from pulsegrid.llm.pieces import SPACE, PieceTrie, Vocabulary, code_points, ragged


def character_map(blob: bytes) -> dict[str, str]:
    """What a file's compiled character map rewrites, and to what.

    The format: the size of a double-array trie over UTF-8 bytes, the trie's 32-bit units, and the results, each ended by
    a zero byte; a value in the trie is where its result begins.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    results = blob[4 + size :]
    out: dict[str, str] = {}
    open_ = [(0, b"")]
    while open_:
        node, key = open_.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if unit >> 8 & 1:  # a key ends here, its value is behind the label 0
            at = units[base] & 0x7FFFFFFF
            out[key.decode("utf-8")] = results[at : results.index(b"\0", at)].decode("utf-8")
        for byte in range(1, 256):
            if base ^ byte < len(units) and units[base ^ byte] & 0x800000FF == byte:
                open_.append((base ^ byte, key + bytes([byte])))
    return out


class Normaliser:
    """Character map, visible spaces and the dummy prefix. At each place the longest rule is taken, and what no rule
    begins at is copied. A file without a character map has one rule alone, for the space."""

    def __init__(self, v: Vocabulary):
        self.squeeze, self.prefix = v.squeeze, v.dummy_prefix
        self.rules = {k: r.replace(" ", SPACE) for k, r in character_map(v.character_map).items()}
        if not self.rules:
            return
        self.rules.setdefault(" ", SPACE)
        self.trie = PieceTrie({k: i for i, k in enumerate(self.rules)})
        self.written, self.first = code_points(list(self.rules.values()))
        self.begins = np.zeros(0x110000, dtype=bool)
        self.begins[[ord(k[0]) for k in self.rules]] = True

    def __call__(self, texts: list[str]) -> list[str]:
        if not self.rules:
            texts = [t.replace(" ", SPACE) for t in texts]
        else:
            texts = self._rewritten(texts)
        if self.squeeze:
            texts = [re.sub(f"{SPACE}+", SPACE, t).strip(SPACE) for t in texts]
        return [SPACE + t if t else t for t in texts] if self.prefix else texts

    def _rewritten(self, texts: list[str]) -> list[str]:
        chars, offsets = code_points(texts)
        stop = np.repeat(offsets[1:], np.diff(offsets))
        at = np.flatnonzero(self.begins[chars])
        rule, length = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        rows, node = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
        for n in range(1, self.trie.longest + 1):
            node = self.trie.step(node, chars[at[rows] + n - 1])
            alive = node >= 0
            rows, node = rows[alive], node[alive]
            ends = self.trie.piece[node] >= 0
            rule[rows[ends]], length[rows[ends]] = self.trie.piece[node[ends]], n
            more = at[rows] + n < stop[at[rows]]
            rows, node = rows[more], node[more]
            if not len(rows):
                break
        at, rule, length = at[rule >= 0], rule[rule >= 0], length[rule >= 0]
        if (length > 1).any():  # from the left; what begins inside a rule's match is no place
            free, keep = 0, []
            for i, (a, n) in enumerate(zip(at.tolist(), length.tolist())):
                if a >= free:
                    keep.append(i)
                    free = a + n
            at, rule, length = at[keep], rule[keep], length[keep]
        many = np.ones(len(chars), dtype=np.int64)
        inside = np.repeat(at, length - 1) + np.arange(int((length - 1).sum())) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1) + 1
        many[inside] = 0
        copied = many == 1
        copied[at] = False
        result, lengths = ragged(self.written, self.first, rule)
        many[at] = lengths
        ends = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        out[ends[:-1][copied]] = chars[copied]
        out[np.repeat(ends[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(result))] = result
        whole, cut = out.tobytes(), (ends[offsets] * 4).tolist()
        return [whole[a:b].decode("utf-32-le", "surrogatepass") for a, b in zip(cut, cut[1:])]
