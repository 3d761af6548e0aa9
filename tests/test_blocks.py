"""Every ordered operator gives the same result whatever the block length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import CHANNELS, as_set, random_signal, to_spark
from pulsegrid.operators import blocks, dataset, events, features, grid, scoring, smoothing


@pytest.fixture(scope="module")
def sig(spark):
    return to_spark(spark, random_signal()).cache()


@pytest.fixture(scope="module")
def runs_input():
    rng = np.random.default_rng(7)
    rows = []
    for r in range(3):
        on = False
        for i in range(200):
            if rng.random() < 0.15:
                on = not on
            rows.append((r % 2, f"P{r}", f"R{r}", i, i * 5.0, int(on), round(float(rng.random()), 4)))
    return pd.DataFrame(rows, columns=["fold", "grp", "record", "idx", "time", "label", "score"])


def test_position_matches_sort(spark, sig):
    df = sig.withColumn("b", blocks.block_of("time_elapsed", 11))
    got = blocks.with_position(df, ["grp", "record"], ["time_elapsed"], "b").select("record", "time_elapsed", "idx")
    want = random_signal().sort_values(["record", "time_elapsed"])
    want["idx"] = want.groupby("record").cumcount()
    assert as_set(got) == sorted(((i, r, t) for r, t, i in want[["record", "time_elapsed", "idx"]].itertuples(index=False)), key=repr)


def test_global_rank(spark):
    df = spark.createDataFrame([(f"k{i % 57:03d}",) for i in range(500)], "record string")
    got = {r.record: r.rank for r in blocks.global_rank(df, "record").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 57


def test_join_spread(spark, sig):
    table = spark.createDataFrame([("R0", 1), ("R2", 2)], "record string, v int")
    got = blocks.join_spread(sig, table, ["record"], "time_elapsed", ["record"], size=9)
    assert as_set(got) == as_set(sig.join(table, "record"))
    semi = blocks.join_spread(sig, table, ["record"], "time_elapsed", ["record"], "left_semi", size=9)
    assert as_set(semi) == as_set(sig.join(table, "record", "left_semi"))


@pytest.mark.parametrize("size", [3, 16])
def test_window_features(sig, size):
    a = features.window_features(sig, [10, 15], size=size)
    assert as_set(a) == as_set(features.window_features(sig, [10, 15]))


def test_window_features_against_numpy(sig):
    from numpy.lib.stride_tricks import sliding_window_view

    pdf = random_signal().sort_values(["record", "time_elapsed"])
    want = {}
    for rec, g in pdf.groupby("record"):
        w = {c: sliding_window_view(g[c].to_numpy(dtype=float), 15)[::5] for c in [*CHANNELS, "time_elapsed", "label"]}
        for i in range(len(w["label"])):
            hr, br = w["heart_rate"][i], w["breathing_rate"][i]
            dhr, dbr = hr[-1] - hr[0], br[-1] - br[0]
            ratio = dhr / dbr if not np.isnan(dbr) and dbr != 0 else np.nan
            want[rec, w["time_elapsed"][i][-1]] = (
                np.nanmean(hr), np.nanmax(hr) - np.nanmin(hr), np.nanstd(hr), dhr, np.nanstd(br), ratio, w["label"][i].max()
            )
    got = {
        (r.record, r.time): (r.HR_mean, r.HR_range, r.HR_std, r.DeltaHR, r.BR_std, r.Ratio_DHR_DBR, r.label)
        for r in features.window_features(sig).collect()
    }
    assert got.keys() == want.keys()
    for k in want:
        g = [np.nan if v is None else float(v) for v in got[k]]
        np.testing.assert_allclose(g, np.array(want[k], dtype=float), atol=1e-9)


def test_short_record_and_wide_step(spark):
    pdf = random_signal(records=1, n=20, gaps=False)
    df = to_spark(spark, pdf)
    assert features.window_features(df, [30]).count() == 0
    ends = sorted(r.time for r in features.window_features(df, [4], step=7, size=5).collect())
    t = np.sort(pdf.time_elapsed)
    assert ends == [t[i + 3] for i in range(0, 17, 7)]


@pytest.mark.parametrize("size", [4, 50])
@pytest.mark.parametrize("alignment", ["forward", "trailing"])
def test_context_windows(sig, size, alignment):
    w = 6
    per_second = sig.select("grp", "record", F.col("time_elapsed").cast("bigint").alias("sec"), *CHANNELS)
    starts = sig.where("time_elapsed % 3 = 0").select("grp", "record", F.col("time_elapsed").alias("time"))
    got = grid.context_windows(starts, per_second, w, alignment, size=size)
    pdf = random_signal()
    values = {(r.record, int(r.time_elapsed)): r for r in pdf.itertuples()}
    bounds = pdf.groupby("record").time_elapsed.agg(["min", "max"])
    rows = got.collect()
    assert len(rows) == (pdf.time_elapsed % 3 == 0).sum()
    for r in rows:
        first = int(r["time"]) if alignment == "forward" else int(r["time"]) - (w - 1)
        lo, hi = bounds.loc[r["record"]]
        ok = lo <= first and first + w - 1 <= hi
        for c in CHANNELS:
            for k in range(w):
                v = values.get((r["record"], first + w - 1 - k)) if ok else None
                v = None if v is None or np.isnan(getattr(v, c)) else getattr(v, c)
                assert r[f"{c}_t-{k}"] == v


@pytest.mark.parametrize("size", [5, 64])
def test_grid_and_fill(sig, size):
    per_second = sig.select("grp", "record", F.col("time_elapsed").cast("bigint").alias("sec"), *CHANNELS)
    got = grid.resample_1hz(per_second, 3, size=size)
    pdf = random_signal()
    want = 0
    table = {(r["record"], r["sec"]): r for r in got.collect()}
    for rec, g in pdf.groupby("record"):
        full = g.set_index(g.time_elapsed.astype(int))[CHANNELS]
        full = full.reindex(range(full.index.min(), full.index.max() + 1)).ffill(limit=3)
        want += len(full)
        for sec, row in full.iterrows():
            for c in CHANNELS:
                v = None if np.isnan(row[c]) else row[c]
                assert table[rec, sec][c] == v
    assert len(table) == want


@pytest.mark.parametrize("size", [6, 1000])
def test_ffill_bfill(sig, size):
    got = dataset.ffill_bfill(sig, CHANNELS, "time_elapsed", size=size)
    pdf = random_signal().sort_values(["record", "time_elapsed"])
    pdf[CHANNELS] = pdf.groupby("record")[CHANNELS].transform(lambda s: s.ffill().bfill())
    want = {(r.record, r.time_elapsed): [getattr(r, c) for c in CHANNELS] for r in pdf.itertuples()}
    assert {(r["record"], r["time_elapsed"]): [r[c] for c in CHANNELS] for r in got.collect()} == want


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 6, 8])
def test_firing_power_is_same_mode_convolution(spark, runs_input, width):
    df = to_spark(spark, runs_input)
    got = smoothing.smooth_scores(df, [width], size=5)
    table = {(r["record"], r["idx"]): r[f"smooth_{width}"] for r in got.collect()}
    for rec, g in runs_input.groupby("record"):
        want = np.convolve(g.score.to_numpy(), np.ones(width) / width, mode="same")
        np.testing.assert_allclose([table[rec, i] for i in range(len(g))], want, atol=1e-12)


@pytest.mark.parametrize("size", [10, 37, 10_000])
@pytest.mark.parametrize("gap", [1, 3])
def test_event_runs(spark, runs_input, size, gap):
    got = events.event_runs(to_spark(spark, runs_input), "label", min_gap=gap, size=size)
    want = []
    for rec, g in runs_input.groupby("record"):
        run = None
        for i, v in zip(g.idx, g.label):
            if not v:
                continue
            if run and i - run[1] - 1 < gap:
                run[1], run[2] = i, run[2] + 1
            else:
                run = [i, i, 1]
                want.append((rec, run))
    assert sorted((r.record, r.i0, r.i1, r.n) for r in got.collect()) == sorted((rec, *run) for rec, run in want)


def test_runs_on_the_record_clock(spark):
    df = spark.range(0, 40).selectExpr("0 as fold", "'P' as grp", "'R' as record", "id as idx", "id * 5 + 14.0D as time", "cast(id in (2, 3, 9) as int) as label")
    got = sorted((r.start_s, r.end_s) for r in events.event_runs(df, "label", clock="time", size=3).collect())
    assert got == [(24, 29), (59, 59)]


def test_runs_through_whole_blocks(spark):
    df = spark.range(0, 100).selectExpr("0 as fold", "'P' as grp", "'R' as record", "id as idx", "cast(id between 3 and 95 as int) as label")
    assert [(r.i0, r.i1, r.n) for r in events.event_runs(df, "label", size=8).collect()] == [(3, 95, 93)]


@pytest.mark.parametrize("size", [9, 5000])
def test_scores_do_not_depend_on_blocks(spark, runs_input, size):
    df = smoothing.firing_power(to_spark(spark, runs_input), 4, 0.5)
    a = scoring.event_metrics(df, merge_gap_s=20, max_len_s=60, size=size)
    b = scoring.event_metrics(df, merge_gap_s=20, max_len_s=60)
    assert as_set(a) == as_set(b)
    edges = events.rising_edges(df, size=size).groupBy("record").agg(F.sum("edge").alias("n"))
    runs = events.event_runs(df, "label").groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    assert as_set(edges) == as_set(runs)
    assert as_set(scoring.split_summary(df, [0, 1], size=size)) == as_set(scoring.split_summary(df, [0, 1]))


@pytest.mark.parametrize("cell", [7, 100, 100_000])
def test_overlap_cells_give_each_pair_once(spark, runs_input, cell):
    df = smoothing.firing_power(to_spark(spark, runs_input), 4, 0.5)
    runs = events.both_runs(df).cache()
    truth, pred = events.of_kind(runs, "true"), events.of_kind(runs, "pred")
    got = events.event_overlap(pred, truth, cell=cell).select("record", "p_start", "t_start")
    t, p = truth.collect(), pred.collect()
    want = sorted(
        (a.start_s, a.record, b.start_s) for a in p for b in t
        if a.record == b.record and a.end_s >= b.start_s - 15 and a.start_s <= b.end_s + 15
    )
    assert as_set(got) == sorted(((ps, rec, ts) for ps, rec, ts in want), key=repr)
    hits = {(r.record, r.start_s): r.hit for r in events.first_hit(truth, pred, cell=cell).collect()}
    ones = {(r.record, r.idx) for r in df.where("pred = 1").collect()}
    for e in t:
        window = [j for j in range(max(0, e.i0 - 3), e.i1 + 4) if (e.record, j) in ones]
        assert hits[e.record, e.start_s] == (window[0] if window else None)


def test_median_and_auc(spark, runs_input):
    counts = spark.createDataFrame([(0, -2.0, 3), (0, 0.0, 1), (0, 7.5, 3), (1, 1.0, 1), (1, 4.0, 1)], "k int, v double, c bigint")
    got = {r.k: r.m for r in scoring.exact_median(counts, ["k"], "v", "c", "m").collect()}
    assert got == {0: 0.0, 1: 2.5}
    pdf = runs_input.copy()
    pdf["score"] = (pdf.score * 8).round() / 8
    got = {r.fold: r.roc_auc for r in scoring.roc_auc(to_spark(spark, pdf)).collect()}
    for f, g in pdf.groupby("fold"):
        p, n = g.score[g.label == 1].to_numpy(), g.score[g.label == 0].to_numpy()
        want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
        assert got[f] == pytest.approx(want)
