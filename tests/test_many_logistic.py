"""Logistic regressions fitted together: the folds' own fits, fewer jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from pulsegrid.operators import models as M
from pulsegrid.operators.folds import assign_folds, dealt_folds
from pulsegrid.operators.many_logistic import WHOLE, Fit, all_inner_folds, fit_together, score_together
from pulsegrid.sources import tables

COLS = ["a", "b", "c", "const", "none"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(14):
        for i in range(60 + 7 * g):
            y = int(rng.random() < 0.25)
            a, b, c = rng.normal(y, 1.0), rng.normal(100 - 20 * y, 15.0), rng.normal(0, 0.01)
            rows.append((f"P{g}", f"R{g}", float(i), i, y, None if i % 7 == 0 else float(a), float(b), float(c), 3.0, None))
    df = spark.createDataFrame(rows, "grp string, record string, time double, idx bigint, label int, a double, b double, c double, const double, none double")
    path = str(tmp_path_factory.mktemp("rows") / "t")
    assign_folds(df, 4).write.parquet(path)
    return spark.read.parquet(path)


def counts_of(df):
    return df.groupBy("fold", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("n_pos"))


def test_inner_folds_are_those_of_each_outer_fold(data):
    counts = counts_of(data)
    got = {r.grp: r.inner for r in all_inner_folds(counts, 4, 3).collect()}
    own = {r.grp: r.fold for r in counts.collect()}
    for f in range(4):
        want = {r.grp: r.inner for r in dealt_folds(counts.where(F.col("fold") != f).drop("fold"), 3, name="inner").collect()}
        assert {g: v[f] for g, v in got.items() if own[g] != f} == want
    assert all(v[own[g]] == WHOLE for g, v in got.items())


@pytest.mark.parametrize("reg, boost", [(0.0, None), (0.05, None), (0.0, 10.0)])
def test_fits_are_those_of_the_library(data, reg, boost):
    from pulsegrid.operators.blocks import join_spread

    rows = join_spread(data, all_inner_folds(counts_of(data), 4, 3), ["grp"], "idx", ["grp", "record"]).cache()
    fits = [Fit(f, i, 0, reg) for f in range(4) for i in (0, 1, 2, WHOLE)]
    model = fit_together(rows, COLS, fits, boost)
    assert model.passes < 30
    scored = score_together(rows, model, ["record", "idx"], lambda f: True).collect()
    spec = M.ModelSpec("lr", lambda **p: LogisticRegression(regParam=reg, maxIter=500, tol=1e-10, **p), balanced=boost is None)
    for f, i in ((1, 2), (3, WHOLE)):
        train = rows.where((F.col("fold") != f) & (F.col("inner")[f] != i)) if i != WHOLE else rows.where(F.col("fold") != f)
        held = rows.where((F.col("fold") != f) & (F.col("inner")[f] == i)) if i != WHOLE else rows.where(F.col("fold") == f)
        whole = M.fit_pipeline(train, COLS, spec)
        want = {(r.record, r.idx): r.score for r in M.score(whole, held, ["record", "idx"]).collect()}
        got = {(r.record, r.idx): r.score for r in scored if (r.outer, r.inner) == (f, i)}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-4
        at = fits.index(Fit(f, i, 0, reg))
        mine, theirs = dict(model.coefficients(at)), dict(zip(M.feature_names(whole), whole.stages[-1].coefficients.toArray()))
        assert mine["none"] == 0 and all(abs(mine[c] - theirs[c]) < 1e-3 for c in ("a", "b", "c"))


def test_nested_folds_together_and_apart(spark, data, tmp_path):
    together = M.ModelSpec("lr", lambda **p: LogisticRegression(**p), {"regParam": [0.0, 0.1]}, balanced=True, together=True)
    apart = M.ModelSpec("lr", lambda **p: LogisticRegression(maxIter=500, tol=1e-10, **p), {"regParam": [0.0, 0.1]}, balanced=True)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    results = []
    for spec in (together, apart):
        spark.sparkContext.setJobGroup(f"cv {spec.together}", "")
        results.append(M.nested_cv(data, COLS[:4], {"lr": spec}, 4, 3, fill=False))
        jobs.append(len(tracker.getJobIdsForGroup(f"cv {spec.together}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    a, b = results
    assert a.chosen.drop("params").orderBy("fold").collect() == b.chosen.drop("params").orderBy("fold").collect()
    assert a.inner.count() == b.inner.count()
    key = lambda r: (r.fold, r.record, r.idx)
    one, two = ({key(r): r.score for r in x.decided.collect()} for x in results)
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-3
    assert jobs[0] < 150  # 32 fits; one at a time they need thousands
    # finished fits are read back
    store = tables.Kept(spark, str(tmp_path / "fits"), "v1")
    first = M.nested_cv(data, COLS[:4], {"lr": together}, 4, 3, fill=False, store=store)
    again = M.nested_cv(data, COLS[:4], {"lr": together}, 4, 3, fill=False, store=store)
    assert sorted(map(tuple, first.importances.collect())) == sorted(map(tuple, again.importances.collect()))
    with pytest.raises(RuntimeError, match="regParam"):
        M.nested_cv(data, COLS[:4], {"lr": M.ModelSpec("lr", LogisticRegression, {"maxIter": [1]}, together=True)}, 4, 3, fill=False)
