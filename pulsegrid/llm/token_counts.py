"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a run of spaces with the word behind it. The distinct pre-tokens of a batch go into a
trie, level by level; a node's best forward score and token count follow from its ancestors', so a
shared prefix is scored once. The node at which a pre-token ends holds its count.

For unigram files scores are added. Scores of a merge file cannot be: its weights sit on pairs of pieces, 0 if the two
stay apart when merged and infinite if a merge reaches across (`piece_fst`), so that one path to each node
has a finite score, and its last piece is all that the nodes below need to know. Counts are those of the encoder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.arrow import append_columns
from pulsegrid.llm.piece_fst import merge_pairs
from pulsegrid.llm.normaliser import Normaliser
from pulsegrid.llm.pieces import NORMAL, SPACE, PieceTrie, Vocabulary, code_points, unknown_score, utf8_length

PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
MEMO_CHARS = 4 << 20  # characters of distinct pre-tokens whose counts a task remembers


NO_PATH, BARE = -2, -1  # in place of a node's last piece: no path, or a character without a piece


@dataclass
class Counter:
    """The pieces as a trie read backwards, and the counts of the pre-tokens a task has met."""

    vocabulary: Vocabulary
    memo: dict[str, int] = field(default_factory=dict)
    chars: int = 0

    def __post_init__(self):
        v = self.vocabulary
        pieces = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space behind another character are not supported")
        self.space, self.pairs, self.runs = pieces.get(SPACE, NO_PATH), None, set()
        if v.merges:
            self.runs = {len(p) for p in pieces if len(p) > 1 and set(p) == {SPACE}}
            self.pairs, pieces = merge_pairs(v, {p: i for p, i in pieces.items() if len(p) == 1 or set(p) != {SPACE}})
        self.backwards = PieceTrie({p[::-1]: i for p, i in pieces.items()})
        self.normalise = Normaliser(v)
        self.unknown = unknown_score(v)

    def count(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens on the best path of each distinct pre-token, and the first of them."""
        chars, offsets = code_points(tokens)
        length = np.diff(offsets)
        node = np.zeros(len(tokens), dtype=np.int64)  # where each pre-token has got to; node 0 is the root
        parent, char = [np.zeros(1, np.int64)], [np.zeros(1, np.uint32)]
        # of each node: the best score, the tokens of its path, the last of them and the first
        state = [np.zeros(1, np.float32), np.zeros(1, np.int64), np.full(1, BARE, np.int64), np.full(1, NO_PATH, np.int64)]
        live, depth, size = np.arange(len(tokens)), 0, 1
        while len(live):
            key = node[live].astype(np.uint64) << np.uint64(21) | chars[offsets[live] + depth].astype(np.uint64)
            new, inverse = np.unique(key, return_inverse=True)
            node[live] = size + inverse
            parent.append((new >> np.uint64(21)).astype(np.int64))
            char.append((new & np.uint64((1 << 21) - 1)).astype(np.uint32))
            up, letter = np.concatenate(parent[-self.backwards.longest - 1 :]), np.concatenate(char[-self.backwards.longest - 1 :])
            found = self._forward(up, letter, size + len(new), len(new), state)
            state = [np.concatenate(pair) for pair in zip(state, found)]
            size += len(new)
            depth += 1
            live = live[length[live] > depth]
        if len(tokens) and (state[2][node] == NO_PATH).any():
            raise ValueError("the vocabulary leaves a text without a path")
        return state[1][node], state[3][node]

    def _forward(self, up, letter, size, new, state) -> list[np.ndarray]:
        """The state of the `new` last nodes; `up` and `letter` hold the last levels of the trie."""
        score, many, last, head = state
        base = size - len(up)
        at = np.arange(size - new, size)
        own = letter[at - base]
        best, count = np.full(new, -np.inf, dtype=np.float32), np.zeros(new, dtype=np.int64)
        ending, opening = np.full(new, NO_PATH, dtype=np.int64), np.full(new, NO_PATH, dtype=np.int64)
        rows, place = np.arange(new), np.zeros(new, dtype=np.int64)
        for length in range(1, self.backwards.longest + 1):
            place = self.backwards.step(place, letter[at - base])
            alive = place >= 0
            rows, place, at = rows[alive], place[alive], up[at[alive] - base]
            piece = self.backwards.piece[place]
            ends = np.flatnonzero(piece >= 0)
            if length == 1:
                bare = np.ones(new, dtype=bool)
                bare[rows[ends]] = False
            if self.pairs is None:
                total = score[at[ends]] + self.vocabulary.scores[piece[ends]]
                ends, total = ends[total >= best[rows[ends]]], total[total >= best[rows[ends]]]  # of equal scores the longest last piece
            else:
                prior = last[at[ends]]
                fine = prior == BARE  # at the start, or behind a character that no merge touches
                ask = np.flatnonzero(prior >= 0)
                fine[ask] = self.pairs.apart(prior[ask], piece[ends[ask]])
                ends = ends[fine]
                total = np.zeros(len(ends), dtype=np.float32)
            to, above = rows[ends], at[ends]
            best[to], count[to], ending[to] = total, many[above] + 1, piece[ends]
            opening[to] = np.where(above == 0, piece[ends], head[above])
            more = at > 0
            rows, place, at = rows[more], place[more], at[more]
            if not len(rows):
                break
        bare = np.flatnonzero(bare)
        above = up[bare + size - new - base]
        total = score[above] + (self.unknown if self.pairs is None else np.float32(0))
        better = (total > best[bare]) & (last[above] != NO_PATH)
        bare, above = bare[better], above[better]
        best[bare], ending[bare] = total[better], BARE
        opening[bare] = np.where(above == 0, BARE, head[above])
        count[bare] = many[above] + (utf8_length(own[bare]) if self.vocabulary.byte_fallback else 1)
        return [best, count, ending, opening]

    def spaced(self, spaces: int) -> int:
        """The tokens of so many single spaces in a row: runs that are pieces are taken from the left, longest first."""
        out, longest = 0, max(self.runs, default=1)
        while spaces:
            n = min(spaces, longest)
            while n > 1 and n not in self.runs:
                n -= 1
            out, spaces = out + 1, spaces - n
        return out

    def learn(self, tokens: list[str]) -> None:
        """Count distinct pre-tokens and remember them."""
        if self.pairs is None:
            self.memo.update(zip(tokens, self.count(tokens)[0].tolist()))
            return
        stems = [t[max(0, len(t) - len(t.lstrip(SPACE)) - 1) :] for t in tokens]  # one space stays with the word
        kinds = list(dict.fromkeys(stems))
        known = dict(zip(kinds, zip(*(a.tolist() for a in self.count(kinds)))))
        for token, stem in zip(tokens, stems):
            many, first = known[stem]
            single = len(token) - len(stem)
            if single:
                alone = first == self.space  # the word's own space is a token by itself, and joins the others
                many += self.spaced(single + alone) - alone
            self.memo[token] = many

    def counts(self, texts: list[str]) -> np.ndarray:
        if self.chars > MEMO_CHARS:
            self.memo.clear()
            self.chars = 0
        split = [PRE_TOKEN.findall(t) for t in self.normalise(texts)]
        new = [p for p in dict.fromkeys(p for s in split for p in s) if p not in self.memo]
        if new:
            self.learn(new)
            self.chars += sum(map(len, new))
        return np.array([sum(map(self.memo.__getitem__, s)) for s in split], dtype=np.int64)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, name: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens that the encoder of the file gives for the whole text.

    A character without a piece counts as its UTF-8 bytes if the file has byte fallback, else as one token; in a
    unigram file it costs ten below the worst piece.

    Null and empty texts have no tokens. Repeated rows get equal counts; an empty table stays empty; a
    column called `name` is replaced. What a task remembers is bounded and only saves time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Counter(vocabulary))  # as large as the piece file

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array(shared.value.counts([t or "" for t in batch.column("text").to_pylist()]), pa.int64())}

    return append_columns(docs, "text", f"`{name}` long", work)
