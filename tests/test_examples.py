"""Hand-made cases for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from pulsegrid.functions import clean_float, clipped, plain_record, round_seconds
from pulsegrid.operators import cleaning, dataset, events, folds, grid, labeling, scoring, smoothing


def samples(spark, n, record="R"):
    return spark.range(n).selectExpr("'P' as grp", f"'{record}' as record", "cast(id as double) as time_elapsed")


def test_interval_is_half_open_and_zero_duration_is_nothing(spark):
    ann = spark.createDataFrame(
        [("R", 3, 2, "Sz FBTCS"), ("R", 8, 0, "fbtcs"), ("R", 6, 1, "FAS"), ("R", 4, 3, "fBtCs"), ("X", 0, 9, "fbtcs")],
        "record string, onset int, duration int, description string",
    )
    for cell in (2, 600):
        got = labeling.interval_label(samples(spark, 12), ann, cell=cell)
        assert [int(r.time_elapsed) for r in got.where("label = 1").orderBy("time_elapsed").collect()] == [3, 4, 5, 6]
        assert got.count() == 12


def test_very_long_event_stays_cheap(spark):
    ann = spark.createDataFrame([("R", 5, 2_000_000, "fbtcs")], "record string, onset int, duration int, description string")
    assert labeling.interval_label(samples(spark, 10), ann).where("label = 1").count() == 5


def test_clean_float(spark):
    df = spark.createDataFrame([("72,5 bpm",), ("--",), ("12e",), ("-1.5E2 x",), (None,), ("n/a",)], "s string")
    assert [r[0] for r in df.select(clean_float("s")).collect()] == [72.5, None, None, -150.0, None, None]


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(round_seconds("x")).collect()] == [0, 2, 2, 0]
    row = spark.range(1).select(clipped(F.lit(None).cast("int")).alias("a"), clipped(F.lit(-3)).alias("b")).first()
    assert (row.a, row.b) == (None, 0)


def test_header_mapping():
    names = cleaning.canonical_names(["time [s/256]", "HR", "Heart Rate (bpm)", "Breathing_rate", "cad", "Activity [g]", "spo2"])
    assert names == {"Heart Rate (bpm)": "heart_rate", "Breathing_rate": "breathing_rate", "Activity [g]": "activity", "cad": "cadence"}
    assert cleaning.canonical_names(["hr", "br", "hr"])["br"] == "breathing_rate"
    assert "hr" not in cleaning.canonical_names(["hr", "br"])  # the clock is never renamed


def test_record_names(spark):
    df = spark.createDataFrame([("a_1Hz_features",), ("b_raw",), ("c_d",)], "s string")
    assert [r[0] for r in df.select(plain_record("s")).collect()] == ["a", "b", "c_d"]


def test_annotation_lookup_rules(spark):
    records = spark.createDataFrame([("A_1Hz",), ("A_b_1Hz",)], "record string")
    ann = spark.createDataFrame([("A_x", 1), ("A_y", 2)], "ann_key string, onset int")
    parity = labeling.record_annotations(records, ann)
    assert as_set(parity.select("record", "onset")) == sorted([(1, "A_1Hz"), (2, "A_1Hz"), (None, "A_b_1Hz")], key=repr)
    assert labeling.record_annotations(records, ann, rule="prefix").where("onset is not null").count() == 4


def test_strict_annotations_fail_on_junk(spark):
    ann = spark.createDataFrame([("R", "x", "1")], "record string, onset string, duration string")
    with pytest.raises(Exception):
        labeling.annotation_clean(ann).collect()
    assert labeling.annotation_clean(ann, strict=False).count() == 0


def test_generalization_modes(spark):
    rows = [("A", 10, 13), ("A", 20, 18), ("A", 30, 30), ("A", 40, 41), ("A", 50, 52), ("A", 60, 60), ("B", 10, 4), ("B", 20, None)]
    ann = spark.createDataFrame(rows, "record string, onset int, generalization int")
    for size in (15, 10_000):
        got = {(r.record, r.onset): r.gen_offset for r in labeling.generalization_offset(ann, size=size).collect()}
        assert got == {("A", 10): 3, ("A", 20): 0, ("A", 30): 0, ("A", 40): 1, ("A", 50): 2, ("A", 60): 0, ("B", 10): 4, ("B", 20): 0}


def test_first_tick_in_file_order(spark):
    df = spark.createDataFrame([("P", "R", 0, None), ("P", "R", 1, 512.0), ("P", "R", 2, 256.0), ("P", "S", 0, None)],
                               "grp string, record string, file_pos bigint, ticks double")
    for size in (1, 100):
        got = cleaning.elapsed_from_ticks(df, size=size)
        assert as_set(got.select("file_pos", "time_elapsed")) == [(0, None), (1, 0.0), (2, -1.0)]


def test_last_value_per_second_skips_nulls(spark):
    df = spark.createDataFrame([("P", "R", 1, 5.0, 1), ("P", "R", 1, None, 2)], "grp string, record string, sec bigint, heart_rate double, o bigint")
    assert grid.last_per_second(df, "o", ["heart_rate"]).first().heart_rate == 5.0
    assert cleaning.dedup_last(df, ["grp", "record", "sec"], "o").first().heart_rate is None


def test_span_guard_stops_before_the_grid(spark):
    df = spark.createDataFrame([("P", "R", 0, 1.0), ("P", "R", 1_700_000_000, 1.0)], "grp string, record string, sec bigint, heart_rate double")
    assert grid.span_guard(grid.record_bounds(df)).count() == 1
    with pytest.raises(Exception, match="not relative"):
        grid.grid_1hz(df, ["heart_rate"]).count()


def test_columns_to_drop():
    shares = {"a": 0.6, "b": 0.61, "expiration_t-3": 0.0, "c": 0.0}
    assert dataset.columns_to_drop(shares) == ["b", "expiration_t-3"]


def test_schema_fill_and_difference(spark):
    df = samples(spark, 2).withColumn("extra", F.lit(1))
    out = cleaning.schema_fill(df)
    assert out.columns == ["grp", "record", "activity", "breathing_rate", "cadence", "heart_rate", "label", "time_elapsed"]
    assert out.first().label == 0 and dict(out.dtypes)["label"] == "tinyint"
    assert cleaning.column_difference(df, ["time_elapsed", "cadence"]) == (["cadence"], ["extra", "grp", "record"])
    with pytest.raises(ValueError):
        cleaning.schema_fill(df.drop("time_elapsed"))


def test_incremental_with_modification_times(spark):
    records = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "record string, mtime int")
    done = spark.createDataFrame([("a", 9), ("b", 4)], "record string, mtime int")
    assert sorted(r.record for r in cleaning.incremental_todo(records, done, ["record"]).collect()) == ["b", "c"]
    assert cleaning.incremental_todo(records, done, ["record"], force=True).count() == 3


def runs(spark, rows):
    df = spark.createDataFrame(rows, "start_s bigint, end_s bigint")
    return df.selectExpr("0 as fold", "'P' as grp", "'R' as record", "start_s div 5 as i0", "end_s div 5 as i1",
                         "(end_s - start_s) div 5 + 1 as n", "start_s", "end_s")


def test_best_match_and_unmatched(spark):
    truth = runs(spark, [(100, 120), (140, 160), (1000, 1000)])
    pred = runs(spark, [(95, 160), (300, 310)])
    pairs = events.event_overlap(pred, truth)
    assert pairs.count() == 2
    best = events.event_best_match(pairs).first()
    assert (best.t_start, best.overlap_s) == (100, 20)  # both overlap 20 s; the nearer start wins
    assert [r.start_s for r in scoring.false_positives(pred, pairs).collect()] == [300]
    assert [r.start_s for r in scoring.false_negatives(truth, pairs).collect()] == [1000]


def test_nearest_onset_tie_takes_the_first(spark):
    ann = spark.createDataFrame([("R", 90, 2, 7), ("R", 110, 1, 5), ("R", 500, 3, 1)], "record string, onset int, ann_pos bigint, gen_offset int")
    got = {r.start_s: (r.onset, r.gen_offset) for r in events.nearest_onset(runs(spark, [(100, 120), (200, 205)]), ann).collect()}
    assert got == {100: (110, 5), 200: (None, None)}


def test_latencies(spark):
    truth, pred = runs(spark, [(100, 120), (400, 400), (800, 820)]), runs(spark, [(90, 105), (395, 395)])
    ann = spark.createDataFrame([("R", 98, 1, 3)], "record string, onset int, ann_pos bigint, gen_offset int")
    gt = {r.start_s: (r.detected, r.det_latency_s, r.gen_latency_s) for r in scoring.true_events(truth, pred, ann).collect()}
    assert gt == {100: (1, 0, 0), 400: (1, 0, None), 800: (0, None, None)}
    lat = scoring.detection_latencies(truth, pred, ann).collect()
    assert [(r.start_s, r.det_latency_s, r.gen_latency_s) for r in lat] == [(100, -10, 0)]  # single samples do not count


def test_event_metrics_rules(spark):
    # truth: two runs 200 s apart are one; pred: a single sample 10 s before, and a far one
    rows = [(i, int(i in (20, 21, 61)), int(i in (17, 400))) for i in range(500)]
    df = spark.createDataFrame(rows, "idx bigint, label int, pred int").selectExpr("0 as fold", "'P' as grp", "'R' as record", "*")
    r = scoring.event_metrics(df).first()
    assert (r.n_truth, r.tp, r.fp, r.n) == (1, 1, 1, 500)
    assert r.far_24h == pytest.approx(24 / (2500 / 3600)) and r.sensitivity == 1.0 and r.precision == 0.5
    cut = scoring.event_metrics(df, max_len_s=100).first()
    assert cut.n_truth == 3  # 100..310 in pieces of 100 s


def test_undefined_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "idx bigint, label int, pred int").selectExpr("0 as fold", "'P' as grp", "'R' as record", "*")
    r = scoring.event_metrics(df).first()
    assert (r.sensitivity, r.precision, r.f1) == (None, None, None)
    e = scoring.epoch_metrics(df).first()
    assert (e.recall_epoch, e.precision_epoch, e.f1_epoch) == (0.0, 0.0, 0.0)
    assert scoring.class_weight(df).first().ratio == 1.0


def test_sweep_equals_single_settings(spark):
    df = spark.range(60).selectExpr("0 as fold", "'P' as grp", "'R' as record", "id as idx", "cast(id % 7 < 3 as int) as label", "(id * 37 % 11) / 11 as score")
    sweep = {(r.width, r.threshold): (r.tp, r.fp, r.fn, r.tn) for r in smoothing.threshold_sweep(df, [4, 6], [0.4, 0.5], ["fold"]).collect()}
    for (w, t), counts in sweep.items():
        r = scoring.epoch_metrics(smoothing.firing_power(df, w, t)).first()
        assert counts == (r.tp, r.fp, r.fn, r.tn)


def test_folds(spark):
    df = spark.range(2000).selectExpr(
        "concat('P', cast(id % 23 as string)) as grp", "concat('R', cast(id % 46 as string)) as record", "id as idx",
        "cast(id % 23 < 9 and id % 5 = 0 as int) as label",
    )
    out = folds.assign_folds(df, 4)
    assert out.count() == 2000
    per_group = out.groupBy("grp").agg(F.countDistinct("fold").alias("n"))
    assert per_group.where("n <> 1").count() == 0
    positives = [r.p for r in out.groupBy("fold").agg(F.sum("label").alias("p")).collect()]
    assert len(positives) == 4 and min(positives) > 0


@pytest.mark.parametrize("n", [10, 200_001])
def test_fold_rule_is_the_same_at_every_size(spark, n):
    counts = spark.range(n).selectExpr("concat('g', cast(id * 7919 % 1000003 as string)) as grp", "20 + id % 50 as n", "id % 11 as n_pos")
    got = {r.grp: r.fold for r in folds.dealt_folds(counts, 7).collect()}
    ranked = sorted(counts.collect(), key=lambda r: (-r.n_pos, -r.n, r.grp))
    assert len(got) == n and all(got[r.grp] == (t if (t := i % 14) < 7 else 13 - t) for i, r in enumerate(ranked))


def test_rows_without_a_time_stay(spark):
    from pulsegrid.operators import dataset, events, features

    rows = spark.range(15).selectExpr(
        "'P' as grp", "'R' as record", "case when id <> 4 then cast(id as double) end as time_elapsed", "cast(id as double) as heart_rate",
        "1D as breathing_rate", "1D as activity", "1D as cadence", "0 as label",
    )
    assert features.window_features(rows, [15]).count() == 1
    assert events.elapsed_by_position(rows, time="time_elapsed").where("time_elapsed is null and idx = 0").count() == 1
    assert dataset.ffill_bfill(rows, ["heart_rate"], "time_elapsed").count() == 15


def test_top_importances_are_per_model(spark):
    df = spark.range(60).selectExpr("concat('m', id % 2) as model", "0 as fold", "concat('f', id) as feature", "1D + id as importance")
    assert {r.model: r["count"] for r in scoring.importance_rank(df, 20).groupBy("model").count().collect()} == {"m0": 20, "m1": 20}


def test_records_without_raw_get_null_context(spark):
    starts = spark.createDataFrame([("P", "R", 3.0), ("P", "X", 3.0)], "grp string, record string, time double")
    raw = spark.range(10).selectExpr("'P' as grp", "'R' as record", "id as sec", "id * 1.0D as heart_rate")
    got = {r.record: (r["heart_rate_t-1"], r["heart_rate_t-0"]) for r in grid.context_windows(starts, raw, 2, "trailing", ["heart_rate"]).collect()}
    assert got == {"R": (2.0, 3.0), "X": (None, None)}


def test_held_out_rows_do_not_leak_and_scaling_is_right(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    from pulsegrid.operators import models

    rng = np.random.default_rng(0)
    rows = [(i % 3, int(i % 4 == 0), float(rng.normal() + (i % 4 == 0)), None if i % 5 == 0 else float(rng.normal()), None) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, label int, a double, b double, empty double")
    spec = models.ModelSpec("lr", lambda **p: LogisticRegression(maxIter=20, **p), balanced=True)
    train, test = df.where("fold <> 0"), df.where("fold = 0")
    model = models.fit_pipeline(train, ["a", "b", "empty"], spec)
    assert models.feature_names(model) == ["a", "b"]
    flipped = models.score(model, test.withColumn("label", 1 - F.col("label")), ["a"])
    assert as_set(flipped) == as_set(models.score(model, test, ["a"]))
    t = [r for r in rows if r[0]]
    b = np.array([np.nan if r[3] is None else r[3] for r in t])
    b = np.where(np.isnan(b), np.nanmean(b), b)
    want = sorted(np.round((b - b.mean()) / b.std(), 6))
    got = sorted(round(float(r.features[1]), 6) for r in model.transform(train.withColumn("label", F.col("label").cast("double"))).collect())
    np.testing.assert_allclose(got, want, atol=1e-5)
    assert dict(models.importances(model)).keys() == {"a", "b"}


def test_importances_survive_zero_totals(spark):
    df = spark.createDataFrame([("m", 0, "a", 1.0), ("m", 0, "b", 3.0), ("m", 1, "a", 0.0), ("m", 1, "b", 0.0)], "model string, fold int, feature string, importance double")
    assert [(r.feature, r.importance) for r in scoring.importance_rank(df).collect()] == [("b", 0.75), ("a", 0.25)]


def test_linear_queries_fit_the_default_models(spark, monkeypatch):
    from pulsegrid.operators import models
    from pulsegrid.plans import model_queries

    used = []
    monkeypatch.setattr(model_queries, "_held_out", lambda spark, sf, spec: used.append(spec))
    def stopped(df, cols, specs):
        used.extend(specs.values())
        raise InterruptedError

    monkeypatch.setattr(models, "nested_cv", stopped)
    for name in ("lr_scores", "svm_scores"):
        model_queries.REGISTRY[name](spark, "/root/testdata/sf0.001")
    with pytest.raises(InterruptedError):
        model_queries.nested_cv_held_out(spark, "/root/testdata/sf0.001")
    full = models.build_models()
    for spec, name in zip(used, ("logistic", "svm", "logistic"), strict=True):
        assert spec.make().getMaxIter() == full[name].make().getMaxIter() == 100
        assert (spec.balanced, spec.widths, spec.thresholds) == (full[name].balanced, full[name].widths, full[name].thresholds)
