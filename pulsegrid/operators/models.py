"""Classifiers on Spark ML, nested cross-validation and the final fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.dataset import ffill_bfill
from pulsegrid.operators.blocks import join_spread
from pulsegrid.operators.folds import assign_folds
from pulsegrid.operators.many_logistic import WHOLE, Fit, all_inner_folds, fit_together, score_together
from pulsegrid.operators.scoring import param_recap, param_top, with_rates
from pulsegrid.operators.smoothing import firing_power, threshold_sweep
from pulsegrid.schema import (
    INNER_FOLDS, KEYS, LABEL, OUTER_FOLDS, THRESHOLDS, WEIGHT_BOOST, WIDTHS,
)
from pulsegrid.session import cut_lineage
from pulsegrid.sources.tables import Kept, finished, kept_or_cut

WEIGHT = "_weight"
PARALLEL_FITS = 6  # inner folds whose jobs are submitted at once
PARALLEL_FOLDS = 2  # outer folds at work at once


@dataclass(frozen=True)
class ModelSpec:
    """A classifier, its own parameter grid, and the post-processing grid."""

    name: str
    make: Callable[..., Estimator]
    grid: dict[str, list] = field(default_factory=dict)
    widths: list[int] = field(default_factory=lambda: list(WIDTHS))
    thresholds: list[float] = field(default_factory=lambda: list(THRESHOLDS))
    balanced: bool = False  # balanced class weights instead of the boosted positive weight
    together: bool = False  # a logistic regression, whose fits are made all at once; its grid may hold regParam
    facts: tuple | None = None  # `train_facts` of the rows of one fit, where they are known

    def choices(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]


def boosted_trees(**params) -> Estimator:
    # --- fixed values: learning rate, subsample and bin count of the boosted trees ---
    settings = dict(stepSize=0.1, subsamplingRate=0.7, maxBins=512, maxIter=2200, maxDepth=10,
                    minInstancesPerNode=15, featureSubsetStrategy="0.8", seed=42)
    return GBTClassifier(**{**settings, **params})


def build_models(maxIter: int | None = None, maxDepth: int | None = None) -> dict[str, ModelSpec]:
    """The default models. Depth-wise trees stand in for leaf-wise ones of 1024 leaves."""
    trees = {k: v for k, v in (("maxIter", maxIter), ("maxDepth", maxDepth)) if v is not None}
    return {
        "gbt": ModelSpec("gbt", lambda **p: boosted_trees(**{**trees, **p})),
        "logistic": ModelSpec("logistic", lambda **p: LogisticRegression(**p), balanced=True, together=True),
        "svm": ModelSpec("svm", lambda **p: LinearSVC(**p), balanced=True, thresholds=[0.55, 0.65, 0.75]),
    }


def train_facts(
    train: DataFrame, cols: list[str], balanced: bool
) -> tuple[dict[str, tuple[float, float]], float, float]:
    """(mean and population std of the columns with any value, weight of class 1, weight of class 0)
    in one pass; a column without values cannot be imputed. The std is that of the imputed column:
    missing values stand at the mean."""
    row = train.agg(*_moments(cols)).first()
    return _facts(row["n"], row["p"] or 0, [(row[f"c{i}"], row[f"m{i}"], row[f"s{i}"]) for i in range(len(cols))], cols, balanced)


def _moments(cols: list[str]) -> list[Column]:
    facts = ((F.avg, "m"), (F.stddev_pop, "s"), (F.count, "c"))
    aggs = [f(f"`{c}`").alias(f"{a}{i}") for i, c in enumerate(cols) for f, a in facts]
    return [F.count(F.lit(1)).alias("n"), F.sum((F.col(LABEL) == 1).cast("bigint")).alias("p"), *aggs]


def _facts(n: int, p: int, moments: list[tuple], cols: list[str], balanced: bool) -> tuple[dict[str, tuple[float, float]], float, float]:
    """`moments` has (values, their mean, their population std) of each column."""
    stats = {c: (m, s * (v / n) ** 0.5 or 1.0) for c, (v, m, s) in zip(cols, moments) if v}
    if balanced:
        return stats, n / (2 * p) if p else 1.0, n / (2 * (n - p)) if n > p else 1.0
    return stats, (n - p) / p * WEIGHT_BOOST if p else float(WEIGHT_BOOST), 1.0


def _merged(moments: list[tuple]) -> tuple:
    """(values, mean, population std) of parts taken together."""
    parts = [(v, m, s) for v, m, s in moments if v]
    values = sum(v for v, _, _ in parts)
    if len(parts) < 2:
        return parts[0] if parts else (0, None, None)
    mean = sum(v * m for v, m, _ in parts) / values
    return values, mean, (sum(v * (s * s + (m - mean) ** 2) for v, m, s in parts) / values) ** 0.5


def facts_without(train: DataFrame, cols: list[str], balanced: bool, part: str) -> Callable[[int | None], tuple]:
    """`train_facts` of `train` without the rows of one value of `part` (None: of all rows), for all values from one pass.
    What reaches the driver is a row per value."""
    rows = train.groupBy(part).agg(*_moments(cols)).collect()

    def facts(left_out: int | None) -> tuple:
        kept = [r for r in rows if left_out is None or r[part] != left_out]
        merged = [_merged([(r[f"c{i}"], r[f"m{i}"], r[f"s{i}"]) for r in kept]) for i in range(len(cols))]
        return _facts(sum(r["n"] for r in kept), sum(r["p"] or 0 for r in kept), merged, cols, balanced)

    return facts


def standardiser(stats: dict[str, tuple[float, float]]) -> SQLTransformer:
    """`z_<column>`: missing values replaced by the mean, then (x - mean) / population std."""
    parts = [f"(coalesce(`{c}`, {m!r}D) - {m!r}D) / {s!r}D as `z_{c}`" for c, (m, s) in stats.items()]
    return SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")


def fit_pipeline(train: DataFrame, cols: list[str], spec: ModelSpec, params: dict | None = None) -> PipelineModel:
    """Mean imputation, standardisation and the classifier, learnt from `train` alone; one pass over
    it gives all that the first two need, unless the `facts` are known."""
    stats, pos, neg = spec.facts or train_facts(train, cols, spec.balanced)
    weighted = train.withColumns({
        WEIGHT: F.when(F.col(LABEL) == 1, F.lit(float(pos))).otherwise(F.lit(float(neg))),
        LABEL: F.col(LABEL).cast("double"),
    })
    classifier = spec.make(**(params or {})).setFeaturesCol("features").setLabelCol(LABEL).setWeightCol(WEIGHT)
    stages = [
        standardiser(stats),
        VectorAssembler(inputCols=[f"z_{c}" for c in stats], outputCol="features"),
        classifier,
    ]
    return Pipeline(stages=stages).fit(weighted)


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` plus `score`, the probability of class 1 (the logistic of the margin for an SVM)."""
    out = model.transform(df.withColumn(LABEL, F.col(LABEL).cast("double")))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(*[F.col(c).cast("int").alias(c) if c == LABEL else F.col(c) for c in keep], p.alias("score"))


def feature_names(model: PipelineModel) -> list[str]:
    return [c.removeprefix("z_") for c in model.stages[1].getInputCols()]


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, raw importance): split gains of trees, absolute coefficients of linear models."""
    names = feature_names(model)
    last = model.stages[-1]
    vector = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [(n, abs(float(v))) for n, v in zip(names, vector.toArray())]


def _safe_names(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """ML stages address columns by plain name; `-` in context columns becomes `_`."""
    names = {c: c.replace("-", "_") for c in cols}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b}), list(names.values())


@dataclass
class CVResult:
    decided: DataFrame  # every outer test row with score and pred, of the models that succeeded
    inner: DataFrame  # one row per (model, fold, inner fold, parameters)
    chosen: DataFrame  # one row per (model, fold)
    importances: DataFrame
    failures: dict[str, str]


def nested_cv(
    df: DataFrame,
    cols: list[str],
    models: dict[str, ModelSpec],
    outer: int = OUTER_FOLDS,
    inner: int = INNER_FOLDS,
    fill: bool = True,
    store: Kept | None = None,
) -> CVResult:
    """Group-aware nested cross-validation.

    Post-processing parameters act after scoring, so every inner fold is fitted once per model
    setting and all (width, threshold) pairs are evaluated on its scores in one pass. The dataset
    is materialised once; every fit and score reads it from there. What reaches the driver per
    step is one row per parameter choice. Models that are fitted `together` need as many passes for all folds as
    others for one. With a `store`, scores and importances of finished fits are read from it.
    """
    df, cols = _safe_names(df, cols)
    if fill:
        df = ffill_bfill(df, cols)
    keep = ["fold", *KEYS, "time", "idx", LABEL]
    if "fold" not in df.columns:
        df = assign_folds(cut_lineage(df), outer)  # which reads it twice
    df = cut_lineage(df)
    # one row per fold and group: every inner assignment is derived from it
    counts = cut_lineage(df.groupBy("fold", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(LABEL) == 1).cast("bigint")).alias("n_pos")
    ))
    # `inner` has the inner folds of a row by outer fold, so that no fit joins folds onto rows; all fits read the same cached columns
    df = cut_lineage(join_spread(df, all_inner_folds(counts, outer, inner), ["grp"], "idx", KEYS, "left")).persist()
    try:
        return _fit_and_score(df, cols, models, outer, inner, keep, store)
    finally:
        df.unpersist()


def _fit_and_score(
    df: DataFrame, cols: list[str], models: dict[str, ModelSpec], outer: int, inner: int, keep: list[str], store: Kept | None
) -> CVResult:
    """`nested_cv` on rows that have `fold` and, as `all_inner_folds` gives them, `inner` (null: in no fit)."""
    spark = df.sparkSession
    decided, inner_rows, chosen, gains, failures = [], [], [], [], {}
    for name, spec in models.items():
        try:
            if spec.together:
                outcome = _all_folds(df, cols, spec, outer, inner, keep, store)
            else:
                one = lambda f: _outer_fold(df, cols, spec, f, inner, keep, store)  # noqa: E731, B023
                with ThreadPool(min(PARALLEL_FOLDS, outer)) as pool:  # one refits while the other has its inner fits
                    outcome = pool.map(inheritable_thread_target(one), range(outer))
        except Exception as error:  # one model must not take the others down
            failures[name] = str(error)
            continue
        for d, i, c, g in outcome:
            decided.append(d)
            inner_rows.append(i.withColumn("model", F.lit(name)))
            chosen.append(c)
            gains += [(name, c[1], n, v) for n, v in g]
    if not decided:
        raise RuntimeError(f"no model could be fitted: {failures}")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return CVResult(
        decided=cut_lineage(union(decided)),
        inner=union(inner_rows),
        chosen=spark.createDataFrame(chosen, "model string, fold int, params string, width int, threshold double"),
        importances=spark.createDataFrame(gains, "model string, fold int, feature string, importance double"),
        failures=failures,
    )


CHOICE = ["choice", "width", "threshold"]


def _rated(counts: DataFrame, fold) -> DataFrame:
    return with_rates(counts).select(
        fold.alias("fold"), "inner", *CHOICE, F.col("f1_epoch").alias("f1"), F.col("recall_epoch").alias("recall"),
        F.col("precision_epoch").alias("precision"),
    )


def _all_folds(
    df: DataFrame, cols: list[str], spec: ModelSpec, outer: int, inner: int, keep: list[str], store: Kept | None
) -> list[tuple]:
    """All outer folds of a logistic regression: one fit of all, one pass for all scores. `df` as for `fit_together`."""
    choices = spec.choices()
    if any(set(c) - {"regParam"} for c in choices):
        raise ValueError("fits made together know no parameter but regParam")
    fits = [
        Fit(f, i, n, float(c.get("regParam", 0.0))) for n, c in enumerate(choices) for f in range(outer) for i in (*range(inner), WHOLE)
    ]
    whole = {(f.outer, f.choice): k for k, f in enumerate(fits) if f.inner == WHOLE}
    spark, made, df = df.sparkSession, {}, df.where("inner is not null")

    def scores() -> DataFrame:
        made["model"] = fit_together(df, cols, fits, None if spec.balanced else float(WEIGHT_BOOST))
        return score_together(df, made["model"], keep, lambda f: True)

    def gains() -> DataFrame:
        found = [(f, n, c, abs(v)) for (f, n), k in whole.items() for c, v in made["model"].coefficients(k)]
        return spark.createDataFrame(found, "outer int, choice int, feature string, importance double")

    name = f"model={spec.name}/all"
    scored = kept_or_cut(store, f"{name}/scores", scores)
    if "model" not in made and not finished(spark, f"{store.path}/{name}/importances"):
        scores()  # broken off between the two tables
    weights = kept_or_cut(store, f"{name}/importances", gains)
    inner_rows = scored.where(F.col("inner") != WHOLE)
    sums = threshold_sweep(inner_rows, spec.widths, spec.thresholds, ["outer", "choice", "inner"], keys=["outer", "choice", *KEYS])
    results = cut_lineage(_rated(sums, F.col("outer")))
    best = {r["fold"]: r for r in param_top(results, CHOICE, 1).collect()}  # a row per fold
    gained = weights.collect()  # a row per fold, choice and feature
    out = []
    for f in range(outer):
        pick = best[f]
        mine = scored.where((F.col("inner") == WHOLE) & (F.col("outer") == f) & (F.col("choice") == pick["choice"])).select(*keep, "score")
        decided = firing_power(mine, pick["width"], pick["threshold"]).withColumn("model", F.lit(spec.name))
        choice = (spec.name, f, str(choices[pick["choice"]]), int(pick["width"]), float(pick["threshold"]))
        importance = [(r["feature"], r["importance"]) for r in gained if r["outer"] == f and r["choice"] == pick["choice"]]
        out.append((decided, results.where(F.col("fold") == f), choice, importance))
    return out


def _outer_fold(
    df: DataFrame, cols: list[str], spec: ModelSpec, fold: int, inner: int, keep: list[str], store: Kept | None = None
):
    """One outer fold. `df` has the inner folds as `all_inner_folds` gives them."""
    train = df.where((F.col("fold") != fold) & F.col("inner").isNotNull()).withColumn("inner", F.col("inner")[fold])
    test = df.where(F.col("fold") == fold).drop("inner")
    known: list[Callable] = []  # worked out by the first fit that is not kept
    guard = Lock()

    def facts(left_out: int | None) -> tuple:
        with guard:
            if not known:
                known.append(facts_without(train, cols, spec.balanced, "inner"))
        return known[0](left_out)

    place = f"model={spec.name}/outer={fold}"

    def fitted(task: tuple[int, dict, int]) -> DataFrame:
        number, params, i = task

        def scores() -> DataFrame:
            model = fit_pipeline(train.where(F.col("inner") != i), cols, replace(spec, facts=facts(i)), params)
            return score(model, train.where(F.col("inner") == i), ["inner", *KEYS, "idx", LABEL])

        rows = scores() if store is None else store.table(f"{place}/inner={i}-{number}", scores)
        return rows.withColumn("choice", F.lit(number))

    tasks = [(number, params, i) for number, params in enumerate(spec.choices()) for i in range(inner)]
    with ThreadPool(min(PARALLEL_FITS, len(tasks))) as pool:  # fits are many small jobs; their order does not matter
        rows = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(fitted), tasks))
    sums = threshold_sweep(rows, spec.widths, spec.thresholds, ["choice", "inner"], keys=["choice", *KEYS])
    results = cut_lineage(_rated(sums, F.lit(fold)))
    best = param_recap(results, CHOICE, 1).first()
    params = spec.choices()[best["choice"]]
    model = []

    def refitted() -> PipelineModel:
        if not model:
            model.append(fit_pipeline(train.drop("inner"), cols, replace(spec, facts=facts(None)), params))
        return model[0]

    def gains() -> DataFrame:
        return df.sparkSession.createDataFrame(importances(refitted()), "feature string, importance double")

    if store is None:
        scored, gained = score(refitted(), test, keep), importances(refitted())
    else:
        scored = store.table(f"{place}/test-{best['choice']}", lambda: score(refitted(), test, keep))
        gained = [tuple(r) for r in store.table(f"{place}/importances-{best['choice']}", gains).collect()]  # a row per feature
    decided = firing_power(scored, best["width"], best["threshold"]).withColumn("model", F.lit(spec.name))
    choice = (spec.name, fold, str(params), int(best["width"]), float(best["threshold"]))
    return decided, results, choice, gained


def fit_final(df: DataFrame, cols: list[str], spec: ModelSpec, params: dict | None = None) -> tuple[PipelineModel, list[str]]:
    """Fit on all rows; returns the model and the feature names it uses."""
    df, cols = _safe_names(df, cols)
    model = fit_pipeline(cut_lineage(ffill_bfill(df, cols)), cols, spec, params)
    return model, feature_names(model)
