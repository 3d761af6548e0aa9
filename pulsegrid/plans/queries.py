"""The registered queries: every operator over the whole tables it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import (
    clean_float, nan_to_null, plain_record, round_seconds,
)
from pulsegrid.operators import cleaning, dataset, events, features, folds, grid, labeling, scoring, smoothing
from pulsegrid.plans import model_queries, views
from pulsegrid.schema import CHANNELS, FEATURES, KEYS, TIME, WINDOW
from pulsegrid.session import cut_lineage
from pulsegrid.sources import dead_letters as letters
from pulsegrid.sources import manifest
from pulsegrid.sources.tables import footer_null_share, parked

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SWEEP_WIDTHS, SWEEP_LEVELS = [4, 6, 8], [0.35, 0.45, 0.55]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def exact(df: DataFrame) -> DataFrame:
    """Counts and flags to bigint; doubles as they are (copies of input values)."""
    narrow = ("tinyint", "smallint", "int")
    return df.selectExpr(*[f"cast(`{n}` as bigint) as `{n}`" if t in narrow else f"`{n}`" for n, t in df.dtypes])


def rounded(df: DataFrame) -> DataFrame:
    """As `exact`, with computed doubles to six digits for comparison with other engines."""
    return exact(df.selectExpr(*[f"round(`{n}`, 6) + 0D as `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes]))


# ---- sources, projection, cleaning ----

@query
def scan_filter(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.where((F.col("value") > 50) & (F.col("event_type") == "error")).select("event_id", "user_id", "value")


@query
def signal(spark, sf):
    return exact(views.signal(spark, sf).select(*KEYS, "event_id", TIME, *CHANNELS))


@query
def clean_numbers(spark, sf):
    return exact(views.raw_text(spark, sf).select("event_id", clean_float("hr_text").alias("heart_rate")))


@query
def time_cast(spark, sf):
    raw = views.raw_text(spark, sf)
    text = F.when(F.col("event_id") % 5 == 0, "12e").otherwise(F.col("ticks").cast("bigint").cast("string"))
    return raw.select("event_id", text.try_cast("double").alias("ticks"))


@query
def elapsed_from_ticks(spark, sf):
    out = cleaning.elapsed_from_ticks(views.raw_text(spark, sf))
    return rounded(out.select("event_id", TIME))


@query
def any_core_filter(spark, sf):
    e = F.col("event_id")
    thinned = views.signal(spark, sf).withColumns({
        "activity": F.when(e % 2 == 0, F.col("activity")),
        "breathing_rate": F.when(e % 3 == 0, F.col("breathing_rate")),
        "heart_rate": F.when(e % 5 == 0, F.col("heart_rate")),
    })
    return exact(cleaning.any_core_filter(thinned).select(*KEYS, TIME, *CHANNELS))


@query
def nan_cleanup(spark, sf):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return exact(views.events(spark, sf).select("event_id", nan_to_null(x).alias("value")))


@query
def record_normalize(spark, sf):
    u = F.col("user_id")
    stem = F.concat(F.lit("R"), u.cast("string"), F.when(u % 3 == 0, "_1Hz").when(u % 3 == 1, "_raw_1Hz").otherwise("_1Hz_features"))
    return views.events(spark, sf).select("event_id", plain_record(stem).alias("record"))


@query
def time_unit_repair(spark, sf):
    t = F.col(TIME)
    digit = F.substring("record", -1, 1).cast("int")
    clock = (
        F.when(digit % 4 == 0, t).when(digit % 4 == 1, (t + 1.7e9) * 1e9)
        .when(digit % 4 == 2, (t + 1.7e9) * 1e3).otherwise(t + 1.7e9)
    )
    raw = views.signal(spark, sf).select(*KEYS, "event_id", clock.alias("time"))
    return cleaning.time_unit_repair(raw).select("event_id", F.round("time", 3).alias("time"))


@query
def schema_fill(spark, sf):
    part = views.signal(spark, sf).select(*KEYS, TIME, "heart_rate", "activity", "event_id")
    return exact(cleaning.schema_fill(part))


@query
def round_half_even(spark, sf):
    half = views.signal(spark, sf).select("event_id", (F.col(TIME) + (F.col("event_id") % 4) * 0.5).alias("t"))
    return half.select("event_id", round_seconds("t").alias("sec"))


@query
def dedup_last(spark, sf):
    out = cleaning.dedup_last(views.sparse(spark, sf), [*KEYS, "sec"], "event_id")
    return exact(out)


@query
def incremental_skip(spark, sf):
    seen = views.events(spark, sf)
    u = F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("record")
    records = seen.select(u).distinct()
    done = seen.where(F.col("event_type") == "signup").groupBy(u).agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return cleaning.incremental_todo(records, done, ["record"])


@query
def manifest_pending(spark, sf):
    """Recordings to be done again: each user's events of a kind stand for an input file. The manifest has an old
    run of all users, and one of half of them; since then some files grew, some are new, some are gone."""
    user, kind = F.col("user_id"), F.col("event_type")
    files = views.events(spark, sf).groupBy(user, kind).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("mtime"))
    named = files.select(
        F.concat(F.lit("P"), (user % 10).cast("string")).alias("grp"), F.concat(F.lit("R"), user.cast("string")).alias("record"),
        kind.alias("input"), F.col("n").alias("size"), "mtime", user.alias("_u"), F.lit("signal").alias("output"),
    )
    old = named.where("_u % 7 <> 0").withColumns({"size": F.lit(0).cast("long"), "run": F.lit("0001")})
    new = named.where("_u % 2 = 0 and not (_u % 3 = 0 and input = 'click')").withColumn("run", F.lit("0002"))
    now = named.withColumn("size", F.col("size") + (F.col("_u") % 5 == 0).cast("long")).where("not (_u % 11 = 0 and input = 'error')")
    out = manifest.changed(now.drop("_u", "output"), old.unionByName(new).drop("_u"))
    return out.select(*KEYS)


# ---- annotations and labels ----

@query
def event_type_filter(spark, sf):
    ann = labeling.event_type_filter(views.annotations(views.signal(spark, sf)))
    return rounded(ann.select("record", "ann_pos", "onset", "duration"))


@query
def annotation_clean(spark, sf):
    ann = views.annotations(views.signal(spark, sf))
    pos = F.col("ann_pos")
    text = ann.select(
        "record", "ann_pos",
        F.when(pos % 10 == 0, "n/a").otherwise(F.concat(F.col("onset").cast("string"), F.lit(".7"))).alias("onset"),
        F.when(pos % 7 == 0, "?").otherwise(F.col("duration").cast("string")).alias("duration"),
        F.when(pos % 4 != 0, F.col("generalization").cast("string")).alias("generalization"),
    )
    return rounded(labeling.annotation_clean(text, strict=False))


@query
def dead_letters(spark, sf):
    """The annotation lines that cannot be labelled with, each with its reason; some are broken on purpose."""
    ann = views.annotations(views.signal(spark, sf))
    pos = F.col("ann_pos")
    notes = ann.select(
        F.col("record").alias("ann_key"), "ann_pos", "description",
        F.when(pos % 10 == 0, "n/a").when(pos % 13 == 0, "").otherwise(F.col("onset").cast("string")).alias("onset"),
        F.when(pos % 7 == 0, "?").when(pos % 11 != 0, F.col("duration").cast("string")).alias("duration"),
    )
    return letters.split_annotations(notes)[1]


@query
def record_annotations(spark, sf):
    sig = views.signal(spark, sf)
    stem = F.concat("record", F.when(F.substring("record", -1, 1) == "2", "_b_1Hz").otherwise("_1Hz"))
    ann = views.annotations(sig).select(
        F.concat("record", F.lit("_evt")).alias("ann_key"), "ann_pos", "onset", "duration"
    )
    out = labeling.record_annotations(sig.select(stem.alias("record")).distinct(), ann)
    return rounded(out.select("record", "ann_pos", "onset", "duration"))


@query
def interval_label(spark, sf):
    return rounded(views.labeled(spark, sf).select(*KEYS, "event_id", TIME, "label"))


@query
def generalization_offset(spark, sf):
    out = labeling.generalization_offset(views.annotations(views.signal(spark, sf)))
    return rounded(out.select("record", "ann_pos", "onset", "gen_offset"))


# ---- features ----

@query
def window_features(spark, sf):
    """Place the samples, label them, and take 15-sample windows every 5 samples."""
    return rounded(views.features(spark, sf).select(*KEYS, "time", *FEATURES, "label"))


@query
def multi_window(spark, sf):
    feats = views.features(spark, sf, [10, 15, 30])
    return rounded(feats.select(*KEYS, "time", "window", *FEATURES, "label"))


@query
def feature_select(spark, sf):
    feats = views.features(spark, sf, [10, 15]).drop("idx")
    return rounded(features.feature_select(feats, 10))


@query
def band_power(spark, sf):
    return rounded(features.band_power(views.signal(spark, sf), "breathing_rate", pos="pos").drop("idx"))


# ---- grid and context ----

SPARSE = ["breathing_rate", "heart_rate"]


def _per_second(spark, sf):
    return grid.last_per_second(views.sparse(spark, sf), "event_id", SPARSE)


@query
def last_per_second(spark, sf):
    return exact(_per_second(spark, sf))


@query
def span_guard(spark, sf):
    late = views.sparse(spark, sf).withColumn(
        "sec", F.when(F.substring("record", -1, 1) == "7", F.col("sec") * 20_000).otherwise(F.col("sec"))
    )
    return grid.span_guard(grid.record_bounds(late))


@query
def grid_1hz(spark, sf):
    return exact(grid.grid_1hz(_per_second(spark, sf), SPARSE))


@query
def resample_1hz(spark, sf):
    return exact(grid.resample_1hz(_per_second(spark, sf), 3, SPARSE))


@query
def bounded_ffill(spark, sf):
    dense = views.signal(spark, sf).select(*KEYS, F.col("pos").alias("sec"), *CHANNELS)
    return exact(grid.bounded_ffill(dense))


def _context(spark, sf, alignment):
    per_second = views.signal(spark, sf).select(*KEYS, F.col("pos").alias("sec"), *CHANNELS)
    starts = views.features(spark, sf).select(*KEYS, "time")
    return exact(grid.context_windows(starts, per_second, WINDOW, alignment))


@query
def context_forward(spark, sf):
    return _context(spark, sf, "forward")


@query
def context_trailing(spark, sf):
    return _context(spark, sf, "trailing")


@query
def context_join(spark, sf):
    """Features with raw context from a sparse grid."""
    raw = _per_second(spark, sf)
    starts = views.features(spark, sf).select(*KEYS, "time", "HR_mean", "label")
    return rounded(grid.context_windows(starts, raw, 3, "forward", SPARSE))


# ---- dataset ----

@query
def raw_semi(spark, sf):
    kept = views.features(spark, sf).where(F.col("label") == 1)
    return dataset.raw_semi(views.sparse(spark, sf), kept).select(*KEYS, "event_id", "sec")


@query
def diag_union(spark, sf):
    sig = views.signal(spark, sf)
    error = F.col("event_type") == "error"
    a = sig.where(error).select(*KEYS, TIME, "heart_rate")
    b = sig.where(~error).select(*KEYS, TIME, "cadence")
    return exact(dataset.diag_union([a, b]))


@query
def key_intersect(spark, sf):
    sig = views.signal(spark, sf)
    return dataset.key_intersect(
        sig.where(F.col("event_type") != "click"), sig.where(F.col("activity") > 0.2), keys=["record", TIME]
    )


@query
def distinct_records(spark, sf):
    return dataset.distinct_records(views.signal(spark, sf))


@query
def record_anchor(spark, sf):
    feats = views.features(spark, sf).select("record", (F.col("time") + 0.25).alias("time"))
    out = dataset.record_anchor(feats)
    return out.select("record", "time", "time_dt", F.timestamp_diff("SECOND", "anchor", "time_dt").alias("elapsed_s"))


@query
def ordered_features(spark, sf):
    feats = views.features(spark, sf).select("record", "time", "idx", "label")
    return exact(dataset.ordered(feats, ["record", "time", "idx"]))


CONTEXT = grid.context_names()


@query
def null_share(spark, sf):
    return rounded(dataset.null_share(views.dataset(spark, sf, "forward"), FEATURES + CONTEXT))


@query
def null_report(spark, sf):
    return rounded(dataset.null_report(views.dataset(spark, sf, "forward"), FEATURES, CONTEXT))


@query
def pruned_dataset(spark, sf):
    """The forward-aligned dataset after dropping mostly-null columns."""
    out = views.dataset(spark, sf, "forward").withColumns(
        {"expiration_t-0": F.lit(1.0), "mostly_null": F.when(F.col("idx") % 3 == 0, F.col("HR_mean"))}
    )
    out, place = parked(out, "dataset")
    shares = footer_null_share(spark, place, [*FEATURES, "expiration_t-0", "mostly_null", *CONTEXT])
    return rounded(out.drop("window", "idx", *dataset.columns_to_drop(shares)))


@query
def ffill_bfill(spark, sf):
    sig = views.signal(spark, sf).select(*KEYS, TIME, "heart_rate", "breathing_rate", "cadence")
    return exact(dataset.ffill_bfill(sig, ["heart_rate", "breathing_rate", "cadence"], TIME))


def _some_without_time(spark, sf):
    """The signal with the time of each record's fourth sample missing."""
    sig = views.signal(spark, sf).select(*KEYS, "event_id", TIME, "heart_rate", "breathing_rate", "cadence")
    return sig.withColumn(TIME, F.when(F.col(TIME) != 3, F.col(TIME)))


@query
def ffill_null_time(spark, sf):
    return exact(dataset.ffill_bfill(_some_without_time(spark, sf), ["heart_rate", "breathing_rate", "cadence"], TIME))


@query
def position_null_time(spark, sf):
    return events.elapsed_by_position(_some_without_time(spark, sf), time=TIME).select(*KEYS, "event_id", TIME, "idx", "elapsed_s")


SCALED = ["HR_mean", "DeltaHR", "BR_std", "Cad_mean"]


@query
def mean_impute(spark, sf):
    feats = views.features(spark, sf).select("record", "time", *SCALED)
    return rounded(dataset.mean_impute(feats, dataset.column_stats(feats, SCALED)))


@query
def zscore(spark, sf):
    feats = views.features(spark, sf).select("record", "time", *SCALED)
    return rounded(dataset.zscore(feats, dataset.column_stats(feats, SCALED)))


# ---- smoothing and events ----

@query
def elapsed_by_position(spark, sf):
    feats = views.features(spark, sf).select(*KEYS, "time")
    return events.elapsed_by_position(feats)


@query
def firing_power(spark, sf):
    return rounded(views.decided(spark, sf))


@query
def threshold_sweep(spark, sf):
    return smoothing.threshold_sweep(views.scored(spark, sf), SWEEP_WIDTHS, SWEEP_LEVELS, ["fold"]).withColumn(
        "width", F.col("width").cast("bigint")).withColumn("fold", F.col("fold").cast("bigint"))


def _truth_pred(spark, sf, ann=None):
    """True and predicted runs. The small run table is read several times, so its lineage is cut."""
    runs = cut_lineage(events.both_runs(views.decided(spark, sf, ann)))
    return events.of_kind(runs, "true"), events.of_kind(runs, "pred")


def _with_annotations(spark, sf):
    """Runs and the annotations they are scored against, from one annotation table."""
    ann = cut_lineage(views.annotations(views.signal(spark, sf)))
    return *_truth_pred(spark, sf, ann), views.scoring_annotations(ann)


def _pairs(spark, sf):
    truth, pred = _truth_pred(spark, sf)
    return events.event_overlap(pred, truth)


@query
def event_runs(spark, sf):
    return rounded(events.both_runs(views.decided(spark, sf)))


@query
def rising_edges(spark, sf):
    out = events.rising_edges(views.scored(spark, sf))
    return rounded(out.select("record", "idx", "edge"))


@query
def event_overlap(spark, sf):
    return rounded(_pairs(spark, sf).select("fold", "record", "p_start", "p_end", "t_start", "t_end"))


@query
def event_best_match(spark, sf):
    out = events.event_best_match(_pairs(spark, sf))
    return rounded(out.drop("grp"))


@query
def false_positives(spark, sf):
    truth, pred = _truth_pred(spark, sf)
    return rounded(scoring.false_positives(pred, events.event_overlap(pred, truth)).drop("grp"))


@query
def false_negatives(spark, sf):
    truth, pred = _truth_pred(spark, sf)
    return rounded(scoring.false_negatives(truth, events.event_overlap(pred, truth)).drop("grp"))


@query
def nearest_onset(spark, sf):
    truth, _, ann = _with_annotations(spark, sf)
    out = events.nearest_onset(truth, ann)
    return rounded(out.select("fold", "record", "start_s", "onset", "gen_offset"))


@query
def first_hit(spark, sf):
    truth, pred = _truth_pred(spark, sf)
    return rounded(events.first_hit(truth, pred).select("fold", "record", "start_s", "hit"))


# ---- scoring ----

@query
def true_events(spark, sf):
    truth, pred, ann = _with_annotations(spark, sf)
    return rounded(scoring.true_events(truth, pred, ann).drop("grp"))


@query
def true_positives(spark, sf):
    truth, pred, ann = _with_annotations(spark, sf)
    rows = scoring.true_events(truth, pred, ann)
    return rounded(scoring.true_positives(events.event_overlap(pred, truth), rows).drop("grp"))


@query
def fold_counts(spark, sf):
    truth, pred, ann = _with_annotations(spark, sf)
    pairs = events.event_overlap(pred, truth)
    gt = scoring.true_events(truth, pred, ann)
    return rounded(scoring.fold_counts(
        scoring.true_positives(pairs, gt), scoring.false_positives(pred, pairs),
        scoring.false_negatives(truth, pairs), gt,
    ))


def _latencies(spark, sf):
    return scoring.detection_latencies(*_with_annotations(spark, sf))


@query
def latency_report(spark, sf):
    return rounded(scoring.latency_report(_latencies(spark, sf)))


@query
def generalization_latency(spark, sf):
    out = _latencies(spark, sf).where(F.col("gen_latency_s").isNotNull())
    return rounded(out.select("fold", "record", "start_s", "gen_latency_s"))


@query
def epoch_metrics(spark, sf):
    return rounded(scoring.epoch_metrics(views.decided(spark, sf)))


@query
def event_metrics(spark, sf):
    return rounded(scoring.event_metrics(cut_lineage(views.decided(spark, sf))))


@query
def hit_rates(spark, sf):
    return rounded(scoring.hit_rates(views.decided(spark, sf)))


@query
def proba_stats(spark, sf):
    return rounded(scoring.proba_stats(views.scored(spark, sf), ["fold"]))


@query
def roc_auc(spark, sf):
    return rounded(scoring.roc_auc(views.scored(spark, sf)))


def _report(spark, sf):
    ann = cut_lineage(views.annotations(views.signal(spark, sf)))
    decided = cut_lineage(views.decided(spark, sf, ann))
    return scoring.fold_report(decided, views.scoring_annotations(ann), "stand-in", views.WIDTH, views.LEVEL)


@query
def fold_report(spark, sf):
    return rounded(_report(spark, sf))


@query
def fold_mean(spark, sf):
    return rounded(scoring.fold_mean(_report(spark, sf)))


@query
def split_summary(spark, sf):
    return rounded(scoring.split_summary(views.scored(spark, sf), views.FOLDS))


@query
def class_weight(spark, sf):
    return rounded(scoring.class_weight(views.scored(spark, sf), ["fold"]))


@query
def group_class_counts(spark, sf):
    return rounded(folds.group_class_counts(views.scored(spark, sf)))


@query
def fold_invariants(spark, sf):
    """Assigns 7 folds and counts what must not happen."""
    rows = folds.assign_folds(views.scored(spark, sf).drop("fold"), 7)
    per_group = rows.groupBy("grp").agg(
        F.countDistinct("fold").alias("folds"), F.count(F.lit(1)).alias("n"),
        F.sum((F.col("fold").isNull() | (F.col("fold") < 0) | (F.col("fold") > 6)).cast("bigint")).alias("bad"),
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"),
        F.sum((F.col("folds") > 1).cast("bigint")).alias("split_groups"), F.sum("bad").alias("bad_rows"),
    )


def _sweep_results(spark, sf, by):
    counts = smoothing.threshold_sweep(views.scored(spark, sf), SWEEP_WIDTHS, SWEEP_LEVELS, by)
    return scoring.with_rates(counts).withColumnsRenamed({"f1_epoch": "f1", "recall_epoch": "recall"})


@query
def param_recap(spark, sf):
    out = scoring.param_recap(_sweep_results(spark, sf, ["fold"]), ["width", "threshold"])
    return rounded(out)


@query
def param_top5(spark, sf):
    out = scoring.param_top(_sweep_results(spark, sf, ["fold", "grp"]), ["width", "threshold"])
    return rounded(out)


REGISTRY.update(model_queries.REGISTRY)
