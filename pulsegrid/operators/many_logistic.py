"""Logistic regressions of all folds at once: one pass over the rows for each iteration of all fits.

The fits of a nested cross-validation differ only in the rows they leave out. A task works out margins, gradients
and curvatures of all of them for its rows, as matrix products; what the tasks send on is one array each, added up in
two steps, so that neither jobs nor what reaches the driver grow with the number of fits or rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.blocks import global_rank
from pulsegrid.schema import LABEL

SUM_TASKS = 16  # that add up the arrays of all others
WHOLE = -1  # in place of an inner fold: nothing but the outer fold is left out


@dataclass(frozen=True)
class Fit:
    """One regression: the outer fold and the inner fold it leaves out, and its parameters."""

    outer: int
    inner: int = WHOLE
    choice: int = 0
    reg: float = 0.0


def all_inner_folds(counts: DataFrame, outer: int, inner: int, group: str = "grp") -> DataFrame:
    """(group, inner): for each outer fold the inner fold that the group is in where that one is left out, -1 where
    it is the group's own; from (fold, group, n, n_pos).

    The rule is that of `dealt_folds`, applied to all outer folds by one ranking.
    """
    left_out = counts.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in range(outer)]))).where(F.col("_f") != F.col("fold"))
    order = F.struct("_f", (-F.col("n_pos")).alias("p"), (-F.col("n")).alias("n"), F.col(group).alias("g"))
    ranks = global_rank(left_out.select(order.alias("_order")), "_order", "_rank").select("_order.*", "_rank")
    per_fold = {r["fold"]: r["n"] for r in counts.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per fold
    total, start = sum(per_fold.values()), [0]
    for f in range(outer):
        start.append(start[-1] + total - per_fold.get(f, 0))
    begin = F.element_at(F.array(*[F.lit(s) for s in start]), F.col("_f") + 1)
    turn = F.pmod(F.col("_rank") - begin, F.lit(2 * inner))
    number = F.when(turn < inner, turn).otherwise(2 * inner - 1 - turn).cast("int")
    table = ranks.groupBy(F.col("g").alias(group)).agg(F.map_from_entries(F.collect_list(F.struct("_f", number.alias("i")))).alias("_m"))  # an entry per fold
    return table.select(group, F.array(*[F.coalesce(F.element_at("_m", F.lit(f)), F.lit(WHOLE)) for f in range(outer)]).alias("inner"))


class _Rows:
    """The rows of a batch: features in the scale of all rows (nulls 0), where they are not null, label, folds."""

    def __init__(self, batch: pa.RecordBatch, cols: list[str], center: np.ndarray, scale: np.ndarray):
        raw = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols], axis=1)
        self.there = ~np.isnan(raw)
        self.x = np.where(self.there, (raw - center) / scale, 0.0)
        self.y = (batch.column(LABEL).to_numpy(zero_copy_only=False) == 1).astype(np.float64)
        self.fold = batch.column("fold").to_numpy()
        self.inner = batch.column("inner").flatten().to_numpy().reshape(batch.num_rows, -1)

    def taken(self, fits: list[Fit]) -> np.ndarray:
        """Which rows each fit is fitted on."""
        cols = [(self.fold != f.outer) & ((f.inner == WHOLE) | (self.inner[:, f.outer] != f.inner)) for f in fits]
        return np.stack(cols, axis=1)

    def held_out(self, f: Fit) -> np.ndarray:
        return (self.fold == f.outer) if f.inner == WHOLE else (self.fold != f.outer) & (self.inner[:, f.outer] == f.inner)


def _on_workers_path(df: DataFrame) -> None:
    df.sparkSession.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])


def _summed(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of the arrays that `work` makes of the batches: added up in each task, then in a few tasks, then here."""
    _on_workers_path(df)

    def added(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for a in arrays:
            total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    first = df.mapInArrow(lambda batches: added(work(b) for b in batches if b.num_rows), "v binary")
    dealt = first.withColumn("_g", F.spark_partition_id() % SUM_TASKS).repartition(SUM_TASKS, "_g").select("v")
    parts = lambda batches: added(np.frombuffer(v) for b in batches for v in b.column("v").to_pylist())
    found = [np.frombuffer(r["v"]) for r in dealt.mapInArrow(parts, "v binary").collect()]  # SUM_TASKS arrays at most
    return sum(found[1:], found[0]) if found else None


@dataclass
class Together:
    """Fitted regressions. Per fit: mean and spread of the features (in the scale of all rows), coefficients
    in that scale, intercept."""

    fits: list[Fit]
    cols: list[str]
    center: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    bias: np.ndarray
    passes: int

    def margins(self, rows: _Rows, at: list[int]) -> np.ndarray:
        """A missing value stands at the fit's own mean."""
        beta, mean = self.beta[at], self.mean[at]
        return rows.x @ beta.T - rows.there @ (mean * beta).T + self.bias[at]

    def coefficients(self, at: int) -> list[tuple[str, float]]:
        """Of the features as the fit sees them, standardised on its own rows."""
        return [(c, float(b)) for c, b in zip(self.cols, self.beta[at] * self.spread[at])]


def _global_facts(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    aggs = [f(f"`{c}`").alias(f"{a}{i}") for i, c in enumerate(cols) for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))]
    row = df.agg(*aggs).first()
    center = np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])
    return center, np.array([row[f"s{i}"] or 1.0 for i in range(len(cols))])


def fit_together(
    df: DataFrame, cols: list[str], fits: list[Fit], boost: float | None = None, tol: float = 1e-9, most: int = 60,
) -> Together:
    """Weighted logistic regressions by damped Newton steps, all in step with each other.

    `df` has the features, the label, `fold`, and `inner` as `all_inner_folds` gives it. Per fit, missing values stand
    at its mean; class weights are balanced, or, with `boost`, negatives / positives * boost for class 1; `reg` is the
    ridge on standardised coefficients. A fit whose loss grew goes half the way back. A fit ends when its loss
    falls by less than `tol` of itself, all end after `most` passes.
    """
    df = df.select(*cols, F.col(LABEL).cast("int").alias(LABEL), "fold", "inner")
    center, scale = _global_facts(df, cols)
    m, d = len(fits), len(cols)

    def facts(batch: pa.RecordBatch) -> np.ndarray:
        rows = _Rows(batch, cols, center, scale)
        taken = rows.taken(fits).astype(np.float64)
        good = taken * rows.y[:, None]
        sums = [t.T @ v for t in (taken, good) for v in (rows.there, rows.x, rows.x**2)]
        return np.concatenate([a.ravel() for a in (taken.sum(axis=0), good.sum(axis=0), *sums)])

    sums = _summed(df, facts)
    if sums is None:
        raise ValueError("no rows to fit on")
    n, pos = sums[:m], sums[m : 2 * m]
    (count, first, second), of_1 = sums[2 * m :].reshape(2, 3, m, d)
    safe = np.maximum(count, 1)
    mean = first / safe
    # of the imputed column; a column without values, or all alike, is left as it is
    spread = np.sqrt(np.maximum(second / safe - mean**2, 0) * count / np.maximum(n, 1)[:, None])
    spread = np.where(spread > 1e-12, spread, 0.0)
    if boost is None:
        weight_1, weight_0 = np.where(pos > 0, n / np.maximum(2 * pos, 1), 1.0), np.where(n > pos, n / np.maximum(2 * (n - pos), 1), 1.0)
    else:
        weight_1, weight_0 = np.where(pos > 0, (n - pos) / np.maximum(pos, 1) * boost, boost), np.ones(m)
    whole = weight_1 * pos + weight_0 * (n - pos)
    # the ridge is on coefficients of columns whose weighted variance is one, as in the library's own regression
    of_0 = np.stack([count, first, second]) - of_1
    moved = [weight_1[:, None] * a + weight_0[:, None] * b for a, b in (
        (of_1[1] - mean * of_1[0], of_0[1] - mean * of_0[0]),
        (of_1[2] - 2 * mean * of_1[1] + mean**2 * of_1[0], of_0[2] - 2 * mean * of_0[1] + mean**2 * of_0[0]))]
    least = np.maximum(whole - (weight_1**2 * pos + weight_0**2 * (n - pos)) / np.maximum(whole, 1e-300), 1e-300)[:, None]
    variance = np.maximum(moved[1] - moved[0] ** 2 / np.maximum(whole, 1e-300)[:, None], 0) / least
    ridge = np.array([f.reg for f in fits])[:, None] * variance
    both = np.zeros((m, d + 1))  # coefficients and intercept
    share = np.clip(weight_1 * pos / np.maximum(whole, 1e-300), 1e-9, 1 - 1e-9)
    both[:, d] = np.log(share / (1 - share))

    def curves(at: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Loss, gradient and curvature of the fits in `live`."""
        chosen = [fits[k] for k in live]

        def work(batch: pa.RecordBatch) -> np.ndarray:
            rows = _Rows(batch, cols, center, scale)
            weight = rows.taken(chosen) * np.where(rows.y[:, None] == 1, weight_1[live], weight_0[live])
            margin = rows.x @ at[:, :d].T - rows.there @ (mean[live] * at[:, :d]).T + at[:, d]
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            loss = (weight * (np.logaddexp(0, margin) - rows.y[:, None] * margin)).sum(axis=0)
            off = weight * (p - rows.y[:, None])
            bent = weight * p * (1 - p)
            grad = np.concatenate([off.T @ rows.x - mean[live] * (off.T @ rows.there), off.sum(axis=0)[:, None]], axis=1)
            hess = np.empty((len(live), d + 1, d + 1))
            design = np.ones((len(rows.y), d + 1))
            for j, k in enumerate(live):
                design[:, :d] = rows.x - rows.there * mean[k]
                hess[j] = (design * bent[:, j : j + 1]).T @ design
            return np.concatenate([loss, grad.ravel(), hess.ravel()])

        return _summed(df, work)

    live = np.flatnonzero(whole > 0)
    best_loss, base, step, length = np.full(m, np.inf), both.copy(), np.zeros((m, d + 1)), np.ones(m)
    passes = 0
    while live.size and passes < most:
        passes += 1
        out = curves(both[live], live)
        k = len(live)
        loss = out[:k] / whole[live] + 0.5 * (ridge[live] * both[live, :d] ** 2).sum(axis=1)
        grad = out[k : k + k * (d + 1)].reshape(k, d + 1) / whole[live, None]
        hess = out[k + k * (d + 1) :].reshape(k, d + 1, d + 1) / whole[live, None, None]
        done = np.zeros(k, dtype=bool)
        for j, at in enumerate(live):
            if loss[j] > best_loss[at] * (1 + 1e-12):  # too far: half the way
                length[at] /= 2
                done[j] = length[at] < 1e-6
                both[at] = base[at] if done[j] else base[at] - length[at] * step[at]
                continue
            done[j] = best_loss[at] - loss[j] <= tol * max(abs(loss[j]), 1e-12)
            best_loss[at], base[at], length[at] = loss[j], both[at], 1.0
            if done[j]:
                continue
            slope, bend = grad[j].copy(), hess[j].copy()
            slope[:d] += ridge[at] * both[at, :d]
            bend[np.arange(d), np.arange(d)] += ridge[at]
            bend[np.arange(d + 1), np.arange(d + 1)] += 1e-10 * max(np.trace(bend) / (d + 1), 1e-12)
            step[at] = np.linalg.lstsq(bend, slope, rcond=None)[0]
            both[at] = base[at] - step[at]
        live = live[~done]
    return Together(fits, cols, center, scale, mean, spread, base[:, :d], base[:, d], passes)


def score_together(df: DataFrame, model: Together, keep: list[str], which: Callable[[Fit], bool]) -> DataFrame:
    """(outer, inner, choice, keep, score): the rows each of some fits has left out, scored by it. One pass; `df` as
    for `fit_together`."""
    _on_workers_path(df)
    at = [k for k, f in enumerate(model.fits) if which(f)]
    kept = [f for f in df.schema.fields if f.name in keep]
    added = [T.StructField(c, T.IntegerType()) for c in ("outer", "inner", "choice")]
    needed = list(dict.fromkeys([*keep, *model.cols, LABEL, "fold", "inner"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, model.cols, model.center, model.scale)
            score = 1 / (1 + np.exp(-np.clip(model.margins(rows, at), -500, 500)))
            for j, k in enumerate(at):
                f = model.fits[k]
                mine = np.flatnonzero(rows.held_out(f))
                if len(mine):
                    part = batch.take(pa.array(mine))
                    numbers = [pa.array(np.full(len(mine), v, dtype=np.int32)) for v in (f.outer, f.inner, f.choice)]
                    yield pa.RecordBatch.from_arrays([*numbers, *[part.column(c.name) for c in kept], pa.array(score[mine, j])], ["outer", "inner", "choice", *[c.name for c in kept], "score"])

    return df.select(*needed).mapInArrow(run, T.StructType([*added, *kept, T.StructField("score", T.DoubleType())]))
