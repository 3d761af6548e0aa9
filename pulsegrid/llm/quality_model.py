"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.arrow import append_columns
from pulsegrid.llm.linear import features, fit_in_one_task, mean_weights, sigmoid, tokens, training_rows

SIZES = [1, 2]


@dataclass(frozen=True)
class Settings:
    """Of the model. `max_rows` bounds the labelled sample; `scale` multiplies the mean n-gram weight."""

    bits: int = 18
    max_rows: int = 8192
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 0.5
    l1: float = 0.01
    l2: float = 0.001
    scale: float = 24.0


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # 2**bits n-gram weights, then the constant
    settings: Settings

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = mean_weights(tokens(texts), self.weights, self.settings.bits, SIZES, [])
        return sigmoid(self.settings.scale * margin + self.weights[-1])


def _leader(sample: list, s: Settings) -> np.ndarray:
    """Per-coordinate updates, one labelled text at a time (McMahan et al., 2013)."""
    z, n = np.zeros((2, (1 << s.bits) + 1))
    constant = 1 << s.bits

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for y, idx, val in sample:
            i = np.append(idx, constant)
            x = np.append(val * s.scale, 1.0)
            w = weights(i)
            g = (sigmoid(w @ x) - y) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / s.alpha * w
            n[i] = grown
    return weights(np.arange(constant + 1))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> QualityModel:
    """Learn `label` from at most `settings.max_rows` labelled texts outside the held-out fifth of ids.

    The text is the only input. Without any labelled row all weights are 0 and every score is 0.5.
    """
    rows = training_rows(docs, labels, label, settings.max_rows)
    weights = fit_in_one_task(features(rows, settings.bits, SIZES, []), lambda sample: _leader(sample, settings))
    return QualityModel(weights, settings)


def score_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """`docs` with the probability of label 1, from the whole text, as sparse dot products in Arrow batches.

    A null or empty text has no n-grams and gets the model's constant; repeated rows get equal
    scores; an empty table stays empty; a column called `name` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers
    return append_columns(docs, "text", f"`{name}` double", lambda batch: {name: pa.array(shared.value.scores(batch.column("text")))})
