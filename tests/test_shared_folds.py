"""The fits of a nested cross-validation read rows that have their folds already, and share one pass for their facts."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from pulsegrid.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for g in range(9):
        for i in range(40 + g):
            y = int(rng.random() < 0.3)
            made.append((f"P{g}", f"R{g}", float(i), i, y, None if i % 5 == 0 else float(rng.normal(y)), float(rng.normal(1e6, 0.5)), 2.0, None, g % 3))
    return spark.createDataFrame(made, "grp string, record string, time double, idx bigint, label int, a double, b double, const double, none double, part int")


def test_fits_join_no_folds_and_read_cached_rows(rows, monkeypatch):
    plans, whole = [], M.fit_pipeline

    def seen(train, *more):
        plans.append(train._jdf.queryExecution().withCachedData().toString())
        return whole(train, *more)

    monkeypatch.setattr(M, "fit_pipeline", seen)
    monkeypatch.setattr(M, "train_facts", None)  # a pass of its own for each fit
    spec = M.ModelSpec("lr", lambda **p: LogisticRegression(maxIter=2, **p), balanced=True)
    out = M.nested_cv(rows, ["a", "b"], {"lr": spec}, 3, 2)
    assert len(plans) == 3 * (2 + 1)
    assert not any("Join" in p for p in plans) and all("InMemoryRelation" in p for p in plans)
    assert out.decided.count() == rows.count() and out.inner.count() == 3 * 2 * len(spec.widths) * len(spec.thresholds)


def test_cached_rows_are_given_back(spark, rows):
    spec = M.ModelSpec("lr", lambda **p: LogisticRegression(maxIter=1, **p), balanced=True)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    M.nested_cv(rows, ["a", "b"], {"lr": spec}, 3, 2).decided.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_facts_without_a_part_are_those_of_the_other_rows(rows):
    cols = ["a", "b", "const", "none"]
    for balanced in (True, False):
        known = M.facts_without(rows, cols, balanced, "part")
        for left_out in (None, 0, 2):
            stats, pos, neg = M.train_facts(rows if left_out is None else rows.where(F.col("part") != left_out), cols, balanced)
            got, got_pos, got_neg = known(left_out)
            assert got.keys() == stats.keys() == {"a", "b", "const"} and (got_pos, got_neg) == (pos, neg)
            for c in ("a", "b"):
                assert got[c] == pytest.approx(stats[c], rel=1e-9)
            assert got["const"] == (2.0, 1.0)  # where a sum over rows may leave a spread of 1e-16
