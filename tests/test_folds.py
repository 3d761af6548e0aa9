"""Folds evened out by exchanges of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import folds


def spreads(counts, rule, k):
    placed = counts.join(rule(counts, k), "grp")
    assert placed.count() == counts.count() == placed.select("grp").distinct().count()
    assert placed.where((F.col("fold") < 0) | (F.col("fold") >= k)).count() == 0
    n, pos = folds.fold_totals(placed, k)
    return max(n) - min(n), max(pos) - min(pos)


@pytest.mark.parametrize("groups, k", [(10, 3), (200_001, 7)])
def test_exchanges_lower_the_spread(spark, tmp_path, groups, k):
    rng = np.random.default_rng(groups)
    n = rng.integers(50, 2000, groups)
    table = np.stack([np.arange(groups), n, rng.integers(0, 1 + n // 10)], axis=1)
    frame = spark.createDataFrame([(f"g{a:06d}", int(b), int(c)) for a, b, c in table], "grp string, n long, n_pos long")
    frame.write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    dealt, evened = spreads(counts, folds.dealt_folds, k), spreads(counts, folds.balanced_folds, k)
    assert evened[0] <= dealt[0] and evened[1] <= dealt[1]
    assert groups < 100 or evened[1] < dealt[1] or dealt[1] <= 1


def test_few_groups_and_none(spark):
    kind = "grp string, n long, n_pos long"
    none = spark.createDataFrame([], kind)
    assert folds.balanced_folds(none, 3).count() == 0
    one = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], kind)
    assert folds.balanced_folds(one, 3).count() == 2
