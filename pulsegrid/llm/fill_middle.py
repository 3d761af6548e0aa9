"""Fill-in-middle: texts cut at two token borders, found by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import append_columns, flat_bytes
from pulsegrid.llm.wavelet import WaveletMatrix

# --- fixed values: the marks of the two forms ---
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Character classes. Each letter run is one token, so a letter that follows a letter has a class of its
# own; every other class begins a token.
OTHER, SPACE, DIGIT, HEAD, INSIDE = range(5)
STARTS = (OTHER, SPACE, DIGIT, HEAD)
_CLASS = np.array(
    [HEAD if chr(b).isalpha() and b < 128 else DIGIT if 48 <= b <= 57 else SPACE if b == 32 or 9 <= b <= 13 else OTHER for b in range(256)],
    dtype=np.uint8,
)


@dataclass(frozen=True)
class Cuts:
    """`seed` begins the hashed name of a document; `changed` of 100 documents are rearranged, `suffix_first`
    of 100 of these with the suffix before the prefix."""

    seed: str = "1:"
    changed: int = 90
    suffix_first: int = 20

    def draws(self, doc_id: object) -> tuple[int, int, int, int]:
        """Four 32-bit draws that depend on the id alone; a null id is called null."""
        digest = hashlib.sha256(f"{self.seed}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


class Tokens:
    """The tokens ([A-Za-z]+|[^A-Za-z]) of several texts, as borders in code points."""

    def __init__(self, column: pa.Array):
        raw, offsets = flat_bytes(column)
        self.raw, self.offsets = raw, offsets
        self.heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
        classes = _CLASS[raw[self.heads[:-1]]]
        self.first = np.searchsorted(self.heads, offsets)  # code point each text begins with
        letter = classes == HEAD
        follows = np.zeros(len(classes), dtype=bool)
        follows[1:] = letter[1:] & letter[:-1]
        follows[self.first[:-1][self.first[:-1] < len(classes)]] = False
        classes[follows] = INSIDE
        self.matrix = WaveletMatrix(classes, 3)
        self.before = self.matrix.rank_any(STARTS, self.first)
        self.count = np.diff(self.before)

    def border(self, k: np.ndarray) -> np.ndarray:
        """The code point, counted over all texts, at which the k-th token of each text ends (k = 0: the
        text's begin): just before the start of the next token, or at the end of the text."""
        low, high = self.first[:-1], self.first[1:]
        after = self.matrix.select_any(STARTS, self.before[:-1] + k + 1, low, high + 1)
        return np.minimum(after - 1, high)


def fill_in_middle(docs: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """`docs` with `n_tokens`, `form`, `prefix_chars`, `middle_chars` and `output`, the text as it is trained on.

    Tokens are letter runs (A-Z, a-z) and single other code points. Two draws of the id choose the borders
    before and after the middle. `form` is "psm" (<P>prefix<S>suffix<M>middle), "spm"
    (<S>suffix<P>prefix<M>middle) or "plain" (the text as it is): empty texts, texts that hold a mark, and the share
    that is not changed are plain, and have null counts of characters. `restored` rebuilds the text.

    Null text counts as empty (output ""). A null id is hashed as "null". Rows that repeat an id are cut by the
    same draws, each in its own text. An empty table gives none; columns of the new names are replaced,
    others kept. Texts of any length are cut whole; a batch is worked on in slices of bounded bytes.
    """

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        tokens = Tokens(batch.column("text"))
        draws = np.array([cuts.draws(d) for d in batch.column("doc_id").to_pylist()], dtype=np.int64).reshape(-1, 4)
        ends = np.sort(draws[:, :2] % (tokens.count + 1)[:, None], axis=1)
        first, second = tokens.border(ends[:, 0]), tokens.border(ends[:, 1])
        raw, marks = tokens.raw.tobytes(), (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
        forms, outputs = [], []
        places = zip(tokens.offsets[:-1].tolist(), tokens.offsets[1:].tolist(), tokens.heads[first].tolist(), tokens.heads[second].tolist())
        for (low, high, a, b), (_, _, third, fourth) in zip(places, draws.tolist()):
            text = raw[low:high]
            if not text or third % 100 >= cuts.changed or any(m in text for m in marks):
                form, parts = "plain", (text,)
            elif fourth % 100 < cuts.suffix_first:
                form, parts = "spm", (marks[1], raw[b:high], marks[0], raw[low:a], marks[2], raw[a:b])
            else:
                form, parts = "psm", (marks[0], raw[low:a], marks[1], raw[b:high], marks[2], raw[a:b])
            forms.append(form)
            outputs.append(b"".join(parts).decode("utf-8", "replace"))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        return {
            "n_tokens": pa.array(tokens.count, pa.int64()), "form": pa.array(forms, pa.string()),
            "prefix_chars": pa.array(first - tokens.first[:-1], pa.int64(), mask=plain),
            "middle_chars": pa.array(second - first, pa.int64(), mask=plain), "output": pa.array(outputs, pa.string()),
        }

    return append_columns(docs, "text", "n_tokens long, form string, prefix_chars long, middle_chars long, output string", work)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of. No mark stands in a text that was rearranged, and a mark cannot
    begin inside a piece of text, for it begins with < and has none further on."""
    part = lambda text, mark, n: F.split_part(text, F.lit(mark), F.lit(n))
    middle, rest = part(output, MIDDLE, 2), part(output, MIDDLE, 1)
    psm = F.concat(F.substr(part(rest, SUFFIX, 1), F.lit(4)), middle, part(rest, SUFFIX, 2))
    spm = F.concat(part(rest, PREFIX, 2), middle, F.substr(part(rest, PREFIX, 1), F.lit(4)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
