"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import random_signal, to_spark
from pulsegrid.operators import events, features, grid, smoothing
from pulsegrid.plans import views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sig(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sig") / "t")
    to_spark(spark, random_signal()).withColumn("pos", F.col("time_elapsed").cast("bigint")).write.parquet(path)
    return spark.read.parquet(path)


def test_placed_features_need_one_exchange(sig):
    assert plan(features.window_features(sig, pos="pos")).count("Exchange hashpartitioning") == 1


def test_smoothing_shares_one_exchange(spark, sig):
    df = sig.selectExpr("grp", "record", "pos as idx", "activity as score")
    text = plan(smoothing.smooth_scores(df, [4, 6, 8]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_context_is_one_window(sig):
    per_second = sig.selectExpr("grp", "record", "pos as sec", "heart_rate", "breathing_rate", "activity", "cadence")
    text = plan(grid.context_windows(sig.selectExpr("grp", "record", "time_elapsed as time"), per_second))
    assert text.count("Window [") == 1 and "Join" not in text


def test_no_shuffle_by_record_alone_on_samples(sig):
    """Every exchange over samples carries a block, cell, window or second next to the record."""
    import re

    for df in (features.window_features(sig, pos="pos"), events.rising_edges(sig, pos="pos"),
               grid.last_per_second(sig.withColumn("sec", F.col("pos")), "pos")):
        for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df)):
            assert len([k for k in keys.split(",") if "#" in k]) > 2


def test_scan_is_pruned_and_filtered(spark):
    text = plan(entry.queries()["scan_filter"](spark, SF))
    assert "GreaterThan(value,50" in text and "EqualTo(event_type,error)" in text
    assert "props" not in text
    assert "props" not in plan(views.signal(spark, SF).select("record", "activity"))
