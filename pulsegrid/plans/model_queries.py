"""Registered queries that fit models. Logistic and SVM queries fit the models of `build_models`; trees are short
(`_small_trees`). Folds and rows are whole."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import folds, models, scoring
from pulsegrid.operators.dataset import ffill_bfill
from pulsegrid.plans import views
from pulsegrid.schema import FEATURES, KEYS, LABEL
from pulsegrid.session import cut_lineage

REGISTRY = {}
KEEP = ["fold", *KEYS, "idx", LABEL]


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _small_trees(**params):
    return GBTClassifier(**{**dict(stepSize=0.1, subsamplingRate=0.7, maxIter=5, maxDepth=3, maxBins=32, seed=42), **params})


def _features(spark, sf):
    feats = views.features(spark, sf).withColumn("fold", F.substring("grp", 2, 9).cast("int") % 3)
    return cut_lineage(ffill_bfill(feats, FEATURES))


def _held_out(spark, sf, spec):
    """Scores of every fold by a model fitted on the other folds."""
    df = _features(spark, sf)
    parts = []
    for fold in views.FOLDS:
        model = models.fit_pipeline(df.where(F.col("fold") != fold), FEATURES, spec)
        parts.append(models.score(model, df.where(F.col("fold") == fold), KEEP))
    return reduce(DataFrame.unionByName, parts)


@query
def group_kfold(spark, sf):
    rows = folds.assign_folds(views.scored(spark, sf).drop("fold"), 7)
    return rows.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(
        F.countDistinct("grp").alias("n_groups"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos")
    )


@query
def group_kfold_balanced(spark, sf):
    """What holds for folds evened out by exchanges: all rows and groups are there once, and neither spread is above the dealt one's."""
    rows = views.scored(spark, sf).drop("fold")
    counts = cut_lineage(rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(LABEL) == 1).cast("bigint")).alias("n_pos")))
    spreads = []
    for rule in (folds.dealt_folds, folds.balanced_folds):
        placed = counts.join(rule(counts, 7, "record"), "record")
        spreads.append((placed, *[max(t) - min(t) for t in folds.fold_totals(placed, 7)]))
    (_, dealt_n, dealt_pos), (placed, n, pos) = spreads
    return placed.agg(
        F.count(F.lit(1)).alias("n_groups"), F.countDistinct("record").alias("n_names"), F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"),
        F.countDistinct("fold").alias("n_folds"), F.lit(n <= dealt_n and pos <= dealt_pos).alias("not_above"),
    )


@query
def ml_pipeline(spark, sf):
    """The imputed and standardised features that a model fitted on all rows gets."""
    df = _features(spark, sf)
    stats, _, _ = models.train_facts(df, FEATURES, True)
    out = models.standardiser(stats).transform(df)
    return out.select(*KEYS, "time", *[(F.round(f"z_{n}", 6) + F.lit(0.0)).alias(n) for n in stats])


@query
def gbt_scores(spark, sf):
    return _held_out(spark, sf, models.ModelSpec("gbt", _small_trees))


@query
def lr_scores(spark, sf):
    return _held_out(spark, sf, models.build_models()["logistic"])


@query
def svm_scores(spark, sf):
    return _held_out(spark, sf, models.build_models()["svm"])


def _facts(rows, *more):
    """Per fold what can be known of held-out scores without the model: each row of each group is there
    once, and its score is a probability."""
    counts = [
        F.countDistinct("grp").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*KEYS, "idx").alias("n_keys"),
        F.sum(F.col(LABEL).cast("bigint")).alias("n_pos"), F.sum(F.col("score").between(0, 1).cast("bigint")).alias("n_scored"),
    ]
    return rows.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(*counts, *more)


@query
def gbt_held_out(spark, sf):
    return _facts(gbt_scores(spark, sf))


@query
def lr_held_out(spark, sf):
    return _facts(lr_scores(spark, sf))


@query
def svm_held_out(spark, sf):
    return _facts(svm_scores(spark, sf))


@query
def nested_cv_held_out(spark, sf):
    """All 7 x 6 folds of a logistic model at both widths: its held-out rows, and the settings tried per fold."""
    result = models.nested_cv(views.features(spark, sf), FEATURES, {"logistic": models.build_models()["logistic"]})
    tried = result.inner.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.countDistinct("inner", "width", "threshold").alias("n_tried"))
    return _facts(result.decided).join(tried, "fold")


def _full_cv(spark, sf):
    """All 7 x 6 folds and both widths; the trees are those of `_small_trees` (5 rounds of depth 3)."""
    feats = views.features(spark, sf)
    spec = models.ModelSpec("gbt", _small_trees, widths=[4, 6], thresholds=[0.40])
    return models.nested_cv(feats, FEATURES, {"gbt": spec})


@query
def nested_cv(spark, sf):
    """Fold reports of the whole nested cross-validation."""
    result = _full_cv(spark, sf)
    ann = views.scoring_annotations(views.annotations(views.signal(spark, sf)))
    report = scoring.fold_report(result.decided, ann, "gbt", 0, 0.0).drop("width", "threshold")
    return report.join(F.broadcast(result.chosen.drop("params")), ["model", "fold"])  # one row per fold


@query
def importance_rank(spark, sf):
    return scoring.importance_rank(_full_cv(spark, sf).importances, 30)


@query
def importance_top(spark, sf):
    """The ten most important features of two stand-in models, whose importances SQL can work out too:
    the size of a feature's mean and its spread, per fold."""
    df = _features(spark, sf)
    kinds = {"mean": lambda c: F.abs(F.avg(c)), "spread": F.stddev_pop}
    sums = df.groupBy("fold").agg(*[F.round(f(c), 6).alias(f"{m}:{c}") for m, f in kinds.items() for c in FEATURES])
    entries = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("feature"), F.col(f"`{m}:{c}`").alias("importance")) for m in kinds for c in FEATURES
    ]))
    out = scoring.importance_rank(sums.select("fold", entries.alias("e")).select("fold", "e.*"), 10)
    return out.withColumn("importance", F.round("importance", 6))
