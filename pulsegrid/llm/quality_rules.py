"""Quality rules: counted base rules, then a calibrated n-gram regression against a fixed threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.arrow import SPACED_WORDS, Words, append_columns, mix, sum_by
from pulsegrid.llm.linear import features, fit_in_one_task, mean_weights, sigmoid, tokens, training_rows

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SIZES, CHARACTERS = [1, 2], [4]


@dataclass(frozen=True)
class Settings:
    """Of the regression. `max_rows` bounds the labelled sample; every fourth of it is kept for the
    calibration; `threshold` is on the calibrated probability of label 1."""

    bits: int = 18
    max_rows: int = 6000
    epochs: int = 4
    rate: float = 0.5
    decay: float = 1e-6
    scale: float = 24.0
    threshold: float = 0.5


@dataclass(frozen=True)
class RuleModel:
    weights: np.ndarray  # of the n-grams
    slope: float
    constant: float
    settings: Settings

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        margin = mean_weights(tokens(texts), self.weights, self.settings.bits, SIZES, CHARACTERS)
        return sigmoid(self.slope * self.settings.scale * margin + self.constant)


def _fit(sample: list, s: Settings) -> np.ndarray:
    """Weights by stochastic gradient steps with per-weight rates, then slope and constant (Platt)
    by Newton steps on rows that the weights have not seen."""
    learn, keep = [r for i, r in enumerate(sample) if i % 4], sample[::4]
    size = 1 << s.bits
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-3)
    for _ in range(s.epochs):
        for y, idx, val in learn:
            i, x = np.append(idx, size), np.append(val * s.scale, 1.0)
            g = (sigmoid(w[i] @ x) - y) * x + s.decay * w[i]
            squares[i] += g * g
            w[i] -= s.rate * g / np.sqrt(squares[i])
    margins = np.array([w[idx] @ val * s.scale for _, idx, val in keep])
    good = np.array([y for y, _, _ in keep], dtype=float)
    # targets pulled in from 0 and 1 by the class counts, as in Platt's paper
    target = np.where(good == 1, (good.sum() + 1) / (good.sum() + 2), 1 / (len(good) - good.sum() + 2))
    a, b = 1.0, float(w[size])
    for _ in range(50 if len(keep) else 0):
        p = sigmoid(a * margins + b)
        v = p * (1 - p)
        grad = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return np.concatenate([w[:size], [a, b]])


def fit_rules(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> RuleModel:
    """Learn `quality` from at most `settings.max_rows` labelled texts outside the held-out fifth of ids."""
    rows = training_rows(docs, labels, "quality", settings.max_rows)
    fitted = fit_in_one_task(features(rows, settings.bits, SIZES, CHARACTERS), lambda sample: _fit(sample, settings))
    return RuleModel(fitted[:-2], float(fitted[-2]), float(fitted[-1]), settings)


def repeated_window_words(words: Words, n: int) -> np.ndarray:
    """Per text the words inside n-word windows that the text has twice or more."""
    at, value = words.windows(n)
    key = mix(value ^ mix(words.doc[at].astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    same = np.append(False, key[1:] == key[:-1])
    twice = same | np.append(same[1:], False) if len(key) else same[:0]
    inside = np.zeros(len(words.hash), dtype=bool)
    for j in range(n):
        inside[at[order[twice]] + j] = True
    return sum_by(inside, words.first)


def _repeated_lines(words: Words) -> list[int]:
    raw = words.raw.tobytes()
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:]):
        lines = [line for line in raw[a:b].split(b"\n") if line.strip(SPACE)]
        out.append(len(lines) - len(set(lines)))
    return out


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the base rules read; exact up to 64-bit hashes of three-word windows."""
    words = Words(texts, SPACED_WORDS)
    heads = ((words.raw & 0xC0) != 0x80) & (words.bytes != 0)
    return {
        "n_words": words.count,
        "word_chars": sum_by(heads, words.offsets),
        "n_symbols": sum_by(SYMBOLS[words.raw], words.offsets),
        "n_dup_lines": np.array(_repeated_lines(words), dtype=np.int64),
        "n_repeat_words": repeated_window_words(words, 3),
    }


def apply_rules(docs: DataFrame, model: RuleModel) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    probability and kept.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: fewer than 50 words, or more than half of the words in three-word
    windows that the text has twice or more. kept: not base_failed, and the calibrated probability
    reaches the model's threshold. Null and empty texts have no words and fail. Whole texts count;
    repeated rows get equal results, an empty table stays empty, columns of the same names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column("text")
        counts = base_counts(texts)
        failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
        p = shared.value.probabilities(texts)
        out = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
        return out | {
            "base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= shared.value.settings.threshold)),
        }

    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return append_columns(docs, "text", names, work)
