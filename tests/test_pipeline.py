"""Files in, reports and a model out."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from pulsegrid.operators import models as M
from pulsegrid.plans import pipeline as P
from pulsegrid.sources import annotations as A
from pulsegrid.sources import recordings as R
from pulsegrid.sources import manifest, sinks, tables


def write(path: Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    rng = np.random.default_rng(3)
    for p in range(6):
        for r in range(2):
            name = f"{p:02d}{r}"  # digits only: must stay text
            lines = ["time [s/256],Heart Rate,br,Activity,cad" if r else "time,hr,Breathing Rate,activity"]
            for s in range(400):
                event = 100 <= s < 160 or 300 <= s < 340
                hr = 60 + 50 * event + rng.normal(0, 4)
                cells = [str(1000 + 256 * s), f"{hr:.2f} bpm" if s % 9 else "--", f"{15 + 5 * event + rng.normal():.3f}", f"{rng.random():.3f}"]
                lines.append(",".join([*cells, "3"] if r else cells))
            write(root / f"raw/pat{p}/{name}.csv", "\n".join(lines) + "\n")
            write(root / f"ann/{name}_events.txt",
                  "exported\npatient;x\n# onset\tduration\tdescription\tgeneralization\n100\t60\tSz FBTCS\t110\n5\t9\tFAS\t0\n300.0\t40\tfbtcs\t312\n")
    return P.Folders(str(root / "raw"), str(root / "ann"), str(root / "work"))


def test_mixed_headers_and_bad_files(spark, tmp_path):
    write(tmp_path / "g 1/a+b [x].csv", 'time,"Heart Rate, bpm",br\n512,"72,5 bpm",--\n768,NA,13e\n256,x,\n1024,80,12.5\n')
    write(tmp_path / "g2/deep/B.csv", "t,cadence,hr\n0,1,\n256,,61\nbad,5,60\n")
    write(tmp_path / "g2/empty.csv", "")
    write(tmp_path / "g2/header_only.csv", "t,hr\n")
    write(tmp_path / "g2/unknown.csv", "t,spo2\n0,99\n")
    write(tmp_path / "g2/notes.txt", "t,hr\n0,1\n")
    got = {(r.grp, r.record, r.time_elapsed): (r.heart_rate, r.breathing_rate, r.cadence) for r in R.read_recordings(spark, str(tmp_path)).collect()}
    assert got == {
        ("g 1", "a+b [x]", 0.0): (72.5, None, None), ("g 1", "a+b [x]", 2.0): (80.0, 12.5, None),
        ("deep", "B", 0.0): (None, None, 1.0), ("deep", "B", 1.0): (61.0, None, None), ("deep", "B", None): (60.0, None, 5.0),
    }


def test_ranges_cut_files_anywhere(spark, tmp_path):
    text = "t,hr\n" + "".join(f"{i},{i}{' bpm' * (i % 3)}\n" for i in range(2000)) + "2000,7"  # no line end at the end
    write(tmp_path / "g/a.csv", text)
    write(tmp_path / "g/b.csv", "\ufefft,br,hr\r\n" + "".join(f"{i},1.5,{i}\r\n" for i in range(50)))
    files = R.raw_files(spark, str(tmp_path))
    for size in (7, 97, 4096, 1 << 20):
        rows = R.read_raw(files, size).orderBy("record", "file_pos").collect()
        a = [r for r in rows if r.record == "a"]
        assert [r.ticks for r in a] == [str(i) for i in range(2001)] and a[-1].heart_rate == "7" and a[1].heart_rate == "1 bpm"
        assert len({r.file_pos for r in a}) == 2001
        assert [(r.ticks, r.heart_rate, r.breathing_rate, r.cadence) for r in rows if r.record == "b"] == [(str(i), str(i), "1.5", None) for i in range(50)]
    spark.dataSource.register(R.RecordingSource)
    source = spark.read.format("recordings").option("rangeBytes", 500).load(str(tmp_path))
    assert source.count() == 2051 and source.columns == R.read_raw(files).columns


def test_lines_of_any_width(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.csv").write_bytes(b'time;x,hr,"a ""b""",activity\n1,"60,5",x,2\n2,61\n\n3,62,y,4,more,cells\n4,\xff6,z,5\n')
    rows = R.read_raw(R.raw_files(spark, str(tmp_path))).orderBy("file_pos").collect()
    assert [(r.ticks, r.heart_rate, r.activity) for r in rows] == [("1", "60,5", "2"), ("2", "61", None), ("3", "62", "4"), ("4", "\ufffd6", "5")]


def test_each_range_opens_its_file_once(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"raw/g/r{i}.csv", ("t,hr\n" if i else "clock,cad,hr\n") + "1,2,3\n" * 1000)
    marks = str(tmp_path / "opened")
    Path(marks).mkdir()

    def opened(path):
        import uuid
        Path(marks, f"{Path(path).name}-{uuid.uuid4().hex}").touch()
        return R.open_file(path)

    files = R.raw_files(spark, str(tmp_path / "raw"))
    raw = R.read_raw(files, 2000, opened)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "FileScan" not in plan  # whatever the layouts
    assert R.cleaned(raw).count() == 3000
    ranges = sum(-(-r["size"] // 2000) for r in files.collect())
    assert len(list(Path(marks).iterdir())) == ranges == 12


def test_annotation_texts(spark, tmp_path):
    write(tmp_path / "R1_a.txt", "intro\r\n# Onset,Duration,Description\r\n10,5,\"Sz, FBTCS\"\r\n\r\n20,x,other\r\n")
    write(tmp_path / "R2.txt", "Description;generalization;duration;# onset\nfbtcs;14;3;12\nfbtcs;;4;\n")
    write(tmp_path / "R3.txt", "nothing here\n")
    got = {(r.ann_key, r.onset): (r.duration, r.description, r.generalization) for r in A.read_annotations(spark, str(tmp_path)).collect()}
    assert got == {
        ("R1", "10"): ("5", "Sz, FBTCS", None), ("R1", "20"): ("x", "other", None),
        ("R2", "12"): ("3", "fbtcs", "14"), ("R2", None): ("4", "fbtcs", None),
    }
    assert [Path(r.path).name for r in A.bad_files(A.read_files(spark, str(tmp_path))).collect()] == ["R3.txt"]
    with pytest.raises(Exception, match="no annotation header"):
        A.read_annotations(spark, str(tmp_path), strict=True).collect()


def test_stages(spark, tmp_path):
    df = spark.range(10).selectExpr("'P' as grp", "concat('00', id % 2) as record", "cast(id as double) as time_elapsed")
    place = str(tmp_path / "stage")
    assert tables.read_stage(spark, place) is None
    tables.write_stage(df.where("record = '000'"), place)
    tables.write_stage(df.where("record = '001'"), place)
    assert tables.read_stage(spark, place).count() == 10
    calls = []
    for window in (15, 15, 30):
        tables.cached_stage(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df, "time_elapsed", window=window)
    assert len(calls) == 2
    place = tables.versioned(str(tmp_path / "cache"), window=15)
    Path(f"{place}/_SUCCESS").unlink()  # a write that was broken off
    tables.cached_stage(spark, str(tmp_path / "cache"), lambda: calls.append(1) or df, "time_elapsed", window=15)
    assert len(calls) == 3
    first = tables.stage_version(tables.read_stage(spark, place))
    tables.write_stage(df.where("time_elapsed < 5"), place, whole=True)
    assert tables.stage_version(tables.read_stage(spark, place)) != first


def test_null_counts_come_from_footers(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 3 as grp", "if(id % 4 = 0, null, id) as a", "cast(null as double) as `b-1`", "cast(id as string) as c")
    place = str(tmp_path / "t")
    df.repartition(5).write.partitionBy("grp").parquet(place)
    assert tables.footer_counts(spark, place, ["a", "b-1", "c"]) == (1000, {"a": 750, "b-1": 0, "c": 1000})
    assert tables.footer_null_share(spark, place, ["a"]) == {"a": 0.25}
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = tables.footer_plan(own.read.parquet(place), ["a", "b-1"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(a), COUNT(`b-1`)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert tables.footer_null_share(spark, str(tmp_path / "none"), ["a"]) == {"a": None}


def test_whole_pipeline(spark, folders):
    spec = M.ModelSpec("gbt", lambda **p: GBTClassifier(maxIter=3, maxDepth=3, seed=1, **p), widths=[2, 4], thresholds=[0.4])
    broken = M.ModelSpec("broken", lambda **p: LogisticRegression(maxIter=-1, **p))
    means = P.run_pipeline(spark, folders, outer=2, inner=2, models={"gbt": spec, "broken": broken})[15]
    row = means.collect()
    assert [r.model for r in row] == ["gbt"]
    assert row[0].f1_epoch > 0.8 and row[0].recall == 1.0

    labeled = tables.read_stage(spark, folders.of("labeled"))
    assert labeled.count() == 12 * 400 and labeled.where("label = 1").count() == 12 * 100
    assert labeled.select("record").distinct().count() == 12 and dict(labeled.dtypes)["record"] == "string"

    gt = spark.read.option("header", True).csv(folders.of("reports/gbt_true_events"))
    assert gt.count() == 24 and "gen_latency_s" in gt.columns
    splits = spark.read.json(folders.of("reports/gbt_splits")).where("tag = 'TEST'")
    assert splits.agg(F.sum("events"), F.sum("groups")).first()[:] == (24, 6)
    assert spark.read.json(folders.of("reports/gbt_params")).count() == 2
    failures = spark.read.json(folders.of("reports/failures")).collect()
    assert [f.model for f in failures] == ["broken"]
    assert spark.read.json(folders.of("reports/feature_importances")).count() > 0

    # a second run finds everything in place
    before = {p: p.stat().st_mtime_ns for p in Path(folders.of("signal")).rglob("*.parquet")}
    P.preprocess(spark, folders)
    assert before == {p: p.stat().st_mtime_ns for p in Path(folders.of("signal")).rglob("*.parquet")}


def test_only_new_or_changed_files_are_opened(spark, tmp_path, monkeypatch):
    at = P.Folders(str(tmp_path / "raw"), str(tmp_path / "ann"), str(tmp_path / "work"))
    opened = []
    read = P.read_raw
    monkeypatch.setattr(P, "read_raw", lambda files: opened.append(sorted(Path(r.path).name for r in files.collect())) or read(files))
    write(tmp_path / "raw/p/a.csv", "t,hr\n0,1\n256,2\n")
    write(tmp_path / "raw/p/b.csv", "t,hr\n0,3\n")
    assert P.preprocess(spark, at).count() == 3
    write(tmp_path / "raw/p/c.csv", "t,hr\n0,4\n")
    assert P.preprocess(spark, at).count() == 4
    write(tmp_path / "raw/p/b.csv", "t,hr\n0,5\n256,6\n")  # another file than the manifest knows
    assert P.preprocess(spark, at).count() == 5
    assert P.preprocess(spark, at).count() == 5
    assert opened == [["a.csv", "b.csv"], ["c.csv"], ["b.csv"]]


def test_a_broken_run_is_done_again(spark, tmp_path, monkeypatch):
    at = P.Folders(str(tmp_path / "raw"), str(tmp_path / "ann"), str(tmp_path / "work"))
    write(tmp_path / "raw/p/a.csv", "t,hr\n" + "".join(f"{256 * i},{i}\n" for i in range(40)))
    write(tmp_path / "ann/a.txt", "onset,duration,description\n3,5,fbtcs\n")

    def broken(*args):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:  # after the stage, before its manifest
        m.setattr(P, "commit", broken)
        with pytest.raises(OSError):
            P.preprocess(spark, at)
    assert manifest.read_manifest(spark, at.manifest("signal")) is None
    signal = P.preprocess(spark, at)
    runs = manifest.finished_runs(spark, at.manifest("signal"))
    assert len(runs) == 1 and signal.count() == 40
    Path(f"{runs[0].removeprefix('file:')}/_SUCCESS").unlink()  # in the middle of the manifest itself
    assert manifest.finished_runs(spark, at.manifest("signal")) == []
    signal = P.preprocess(spark, at)
    labeled = P.label(spark, at, signal)
    first = P.features(spark, at, labeled, [5, 10])
    made = {p: p.stat().st_mtime_ns for p in Path(at.of("features-5-10")).rglob("*.parquet")}
    assert first.where("window = 5").count() == 8 and first.where("window = 10").count() == 7
    write(tmp_path / "raw/p/b.csv", "t,hr\n" + "".join(f"{256 * i},{i}\n" for i in range(10)))
    write(tmp_path / "ann/b.txt", "onset,duration,description\n")
    signal = P.preprocess(spark, at)
    again = P.features(spark, at, P.label(spark, at, signal), [5, 10])
    now = {p: p.stat().st_mtime_ns for p in Path(at.of("features-5-10")).rglob("*.parquet")}
    assert made.items() <= now.items() and again.where("record = 'b'").count() == 3  # only the new recording


def test_what_cannot_be_used_is_put_aside(spark, tmp_path):
    at = P.Folders(str(tmp_path / "raw"), str(tmp_path / "ann"), str(tmp_path / "work"))
    write(tmp_path / "raw/p/a.csv", "t,hr\n" + "".join(f"{256 * i if i != 7 else 'late'},{i}\n" for i in range(40)))
    write(tmp_path / "raw/p/none.csv", "t,spo2\n0,99\n")
    write(tmp_path / "ann/a.txt", "onset,duration,description\n3,5,fbtcs\nsoon,5,fbtcs\n9,,fbtcs\n")
    write(tmp_path / "ann/b.txt", "nothing here\n")
    with pytest.raises(Exception, match="no annotation header"):
        P.label(spark, at, P.preprocess(spark, at))
    P.preprocess(spark, at, force=True, aside=True)
    labeled = P.label(spark, at, P.preprocess(spark, at), aside=True)
    assert labeled.where("label = 1").count() == 4  # the line with the broken clock has no second
    P.write_letters(at.of("dead_letters"), P.failed_fits(spark, {"svm": "too few rows"}))
    got = {(r.kind, Path(r.place).name, r.reason) for r in spark.read.parquet(at.of("dead_letters")).collect()}
    assert got == {
        ("row", "a", "clock is not a number"), ("file", "none.csv", "no known channel, or no rows"), ("row", "a", "onset is not a number"),
        ("row", "a", "no duration"), ("file", "b.txt", "no annotation header"), ("fit", "svm", "too few rows"),
    }


def test_equal_places_in_two_files(spark):
    rows = [("P", "r", 0.0, 7, float(i % 5), None) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, record string, time_elapsed double, file_pos bigint, heart_rate double, activity double")
    for parts in (1, 7):
        assert P.dedup_last(df.repartition(parts), ["grp", "record", "time_elapsed"], "file_pos", ties=True).first().heart_rate == 4.0


def test_a_second_driver_goes_on_behind_the_third_fold(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"P{g}", f"R{g}", float(i), i, int(i % 5 == 0), float(rng.normal(i % 5 == 0)), float(rng.normal())) for g in range(10) for i in range(30)]
    df = spark.createDataFrame(rows, "grp string, record string, time double, idx bigint, label int, a double, b double")
    spec = M.ModelSpec("gbt", lambda **p: GBTClassifier(maxIter=2, maxDepth=2, seed=1, **p))
    fits, whole = [], M.fit_pipeline

    def counted(train, cols, spec, params=None):
        if "inner" not in train.columns and sum(fits) == 3:
            raise OSError("the driver is gone")
        fits.append("inner" not in train.columns)
        return whole(train, cols, spec, params)

    run = lambda: M.nested_cv(df, ["a", "b"], {"gbt": spec}, 4, 2, store=tables.Kept(spark, str(tmp_path / "fits"), "v1"))
    monkeypatch.setattr(M, "fit_pipeline", counted)
    with pytest.raises(RuntimeError, match="the driver is gone"):
        run()
    assert sum(fits) == 3 and len(fits) == 3 + 4 * 2
    monkeypatch.setattr(M, "fit_pipeline", lambda *a: fits.append(None) or whole(*a))
    got = run()
    assert fits.count(None) == 1  # the last outer fit alone
    monkeypatch.setattr(M, "fit_pipeline", whole)
    want = M.nested_cv(df, ["a", "b"], {"gbt": spec}, 4, 2)
    order = ["fold", "record", "idx", "score", "pred"]
    assert sorted(map(tuple, got.decided.select(*order).collect())) == sorted(map(tuple, want.decided.select(*order).collect()))
    assert got.chosen.orderBy("fold").collect() == want.chosen.orderBy("fold").collect()
    gains = lambda cv: sorted((r.model, r.fold, r.feature, round(r.importance, 9)) for r in cv.importances.collect())
    assert gains(got) == gains(want)


def test_final_model_round_trip(spark, folders):
    signal = P.preprocess(spark, folders)
    dataset = P.build_dataset(spark, folders, P.label(spark, folders, signal))
    context = [c for c in dataset.columns if c.endswith("_t-0")]
    assert len(context) == 4  # cadence exists in half of the recordings and stays below the limit
    spec = M.ModelSpec("logistic", lambda **p: LogisticRegression(maxIter=5, **p), balanced=True)
    path = P.train_final(spark, folders, dataset, spec)
    model, names, meta = sinks.load_model(spark, path)
    assert meta["window_seconds"] == 15 and meta["width"] == 6 and len(names) == 74
    renamed = dataset.withColumnsRenamed({c: c.replace("-", "_") for c in dataset.columns})
    scores = M.score(model, renamed, ["record", "time", "label"])
    assert scores.count() == dataset.count()
    by = {r.label: r.m for r in scores.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert by[1] > by[0] + 0.3


def test_alignment_of_the_context(spark, folders):
    labeled = P.label(spark, folders, P.preprocess(spark, folders))
    ahead = P.build_dataset(spark, folders, labeled, alignment="forward")
    behind = P.build_dataset(spark, folders, labeled, alignment="trailing")
    a = ahead.where("record = '000' and time = 104").first()
    b = behind.where("record = '000' and time = 104").first()
    assert a["activity_t-14"] == b["activity_t-0"] and a["HR_mean"] == b["HR_mean"]
    assert json.loads(json.dumps(a.asDict()))["label"] == 1
