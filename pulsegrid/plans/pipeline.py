"""The whole job: recordings and annotations in, scored models and reports out.

Stages meet in Parquet, one folder per recording, so a lost executor costs tasks and a restart
costs the stage at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import models as M
from pulsegrid.operators.cleaning import dedup_last, schema_fill
from pulsegrid.operators.dataset import assemble, columns_to_drop, diag_union, null_report, raw_semi
from pulsegrid.operators.events import both_runs, event_overlap, of_kind
from pulsegrid.operators.features import window_features
from pulsegrid.operators.grid import last_per_second, record_bounds, span_guard, with_second
from pulsegrid.operators.labeling import annotation_clean, event_type_filter, generalization_offset, interval_label, record_annotations
from pulsegrid.operators.scoring import (
    false_negatives, false_positives, fold_counts, fold_mean, fold_report, hit_rates, importance_rank, param_recap,
    param_top, proba_stats, split_summary, true_events, true_positives,
)
from pulsegrid.schema import EVENT_TYPE, FINAL_THRESHOLD, FINAL_WIDTH, KEYS, LABEL, TIME, WINDOW
from pulsegrid.session import cut_lineage
from pulsegrid.sources.annotations import bad_files, read_annotations, read_files
from pulsegrid.sources.dead_letters import bad_ticks, failed_fits, files_without, split_annotations, write_letters
from pulsegrid.sources.manifest import as_inputs, commit, pending, read_manifest
from pulsegrid.sources.recordings import cleaned, raw_files, read_raw
from pulsegrid.sources.sinks import save_model, write_reports, write_summary
from pulsegrid.sources.tables import Kept, cached_stage, read_stage, stage_version, write_stage


@dataclass
class Folders:
    raw: str
    annotations: str
    work: str  # stages, reports and models go below this

    def of(self, name: str) -> str:
        return f"{self.work}/{name}"

    def manifest(self, stage: str) -> str:
        return f"{self.work}/manifests/{stage}"


def preprocess(spark: SparkSession, at: Folders, force: bool = False, aside: bool = False) -> DataFrame:
    """CSV -> canonical signal, one row per (recording, time).

    Recordings whose files are those of the manifest are left out before any file is opened. `aside` notes lines
    with a broken clock and files that give no row in the table of dead letters.
    """
    files = cut_lineage(raw_files(spark, at.raw).withColumnRenamed("path", "input"))
    todo = cut_lineage(pending(spark, at.manifest("signal"), files, force))
    if not todo.isEmpty():
        wanted = files.join(todo, KEYS, "left_semi")
        raw = read_raw(wanted.withColumnRenamed("input", "path"))
        if aside:
            raw = cut_lineage(raw)
            silent = wanted.join(raw.select(*KEYS).distinct(), KEYS, "left_anti").withColumnRenamed("input", "path")
            write_letters(at.of("dead_letters"), bad_ticks(raw), files_without(silent, "no known channel, or no rows"))
        signal = cleaned(raw)
        write_stage(dedup_last(signal, [*KEYS, TIME], "file_pos", ties=True), at.of("signal"))
        commit(spark, at.manifest("signal"), wanted, at.of("signal"))
    found = read_stage(spark, at.of("signal"))
    if found is None:
        raise ValueError(f"no recording with a known channel under {at.raw}")
    return found


def annotations_of(spark: SparkSession, at: Folders, signal: DataFrame, strict: bool, rule: str, aside: bool = False) -> DataFrame:
    """Annotations with the recording they belong to. `aside` puts lines and files that cannot be used in the table of
    dead letters, where `strict` would end the run."""
    notes = read_annotations(spark, at.annotations, strict=strict and not aside)
    if aside:
        notes, bad = split_annotations(notes)
        write_letters(at.of("dead_letters"), bad, files_without(bad_files(read_files(spark, at.annotations)), "no annotation header"))
    joined = record_annotations(signal.select(*KEYS).distinct(), notes, rule=rule).where(F.col("ann_key").isNotNull())
    return event_type_filter(joined, EVENT_TYPE)


def label(
    spark: SparkSession, at: Folders, signal: DataFrame, force: bool = False, rule: str = "parity", aside: bool = False
) -> DataFrame:
    """The signal with labels; recordings labelled from their present signal by the same rule are left alone."""
    inputs = as_inputs(read_manifest(spark, at.manifest("signal")), rule)
    todo = cut_lineage(pending(spark, at.manifest("labeled"), inputs, force))
    if not todo.isEmpty():
        ann = annotation_clean(annotations_of(spark, at, signal, True, rule, aside), strict=True)
        write_stage(interval_label(raw_semi(signal, todo, TIME), ann), at.of("labeled"))
        commit(spark, at.manifest("labeled"), inputs.join(todo, KEYS, "left_semi"), at.of("labeled"))
    return read_stage(spark, at.of("labeled"))


def features(spark: SparkSession, at: Folders, labeled: DataFrame, windows: list[int] | None = None, force: bool = False) -> DataFrame:
    """Window features of all sizes, from one pass over the samples; recordings whose features follow from their
    present labels are left alone. Sizes that were not asked for before make a stage of their own."""
    windows = sorted(set(windows or [WINDOW]))
    stage = "features-" + "-".join(str(w) for w in windows)
    inputs = as_inputs(read_manifest(spark, at.manifest("labeled")), stage)
    todo = cut_lineage(pending(spark, at.manifest(stage), inputs, force))
    if not todo.isEmpty():
        made = window_features(raw_semi(schema_fill(labeled), todo, TIME), windows)
        write_stage(made, at.of(stage), "time")
        commit(spark, at.manifest(stage), inputs.join(todo, KEYS, "left_semi"), at.of(stage))
    return read_stage(spark, at.of(stage))


def build_dataset(
    spark: SparkSession, at: Folders, labeled: DataFrame, window: int = WINDOW, include_raw: bool = True,
    alignment: str = "trailing", version: str | None = None, force: bool = False, windows: list[int] | None = None,
) -> DataFrame:
    """Features, raw context, label and keys, cached per setting and input version.

    The version is worked out from the files of `labeled` unless one is given. The table is computed and written
    once, whole; columns that are mostly null, by the footers of what was written, are then not read.
    """
    version = version or stage_version(labeled)

    def build() -> DataFrame:
        feats = features(spark, at, labeled, windows or [window], force).where(F.col("window") == window)
        if not include_raw:
            return feats
        # one sample per time already, so the time itself orders the samples of a second
        per_second = last_per_second(with_second(schema_fill(labeled), TIME), TIME)
        span_guard(record_bounds(per_second), strict=True).write.format("noop").mode("overwrite").save()
        return assemble(feats, per_second, window, alignment, prune=False)

    held = {"time", "window", "idx", LABEL}
    return cached_stage(
        spark, at.of("dataset"), build, window=window, include_raw=include_raw, alignment=alignment, version=version, force=force,
        droppable=lambda shares: columns_to_drop({c: s for c, s in shares.items() if c not in held}),
    )


def feature_columns(dataset: DataFrame) -> list[str]:
    return [c for c in dataset.columns if c not in {*KEYS, "time", "window", "idx", LABEL, "fold"}]


def evaluate(
    spark: SparkSession, at: Folders, dataset: DataFrame, signal: DataFrame, models: dict[str, M.ModelSpec],
    outer: int, inner: int, rule: str = "parity", aside: bool = False,
) -> DataFrame:
    """Nested cross-validation with event reports and summaries; returns the means per model."""
    told_apart = f"{stage_version(dataset)}, {outer} x {inner}, {sorted(dataset.columns)}"
    cv = M.nested_cv(dataset, feature_columns(dataset), models, outer, inner, store=Kept(spark, at.of("fits"), told_apart))
    if aside and cv.failures:
        write_letters(at.of("dead_letters"), failed_fits(spark, cv.failures))
    notes = annotation_clean(annotations_of(spark, at, signal, False, rule), strict=False)
    ann = cut_lineage(generalization_offset(notes))
    reports, told = [], {}
    for name in models:
        if name in cv.failures:
            continue
        decided = cv.decided.where(F.col("model") == name)
        runs = cut_lineage(both_runs(decided))
        truth, pred = of_kind(runs, "true"), of_kind(runs, "pred")
        pairs = event_overlap(pred, truth)
        gt = true_events(truth, pred, ann)
        tp, fp, fn = true_positives(pairs, gt), false_positives(pred, pairs), false_negatives(truth, pairs)
        write_reports(at.of("reports"), name, {
            "true_positives": tp, "false_positives": fp, "false_negatives": fn, "true_events": gt,
        })
        tried = cv.inner.where(F.col("model") == name)
        choice = ["choice", "width", "threshold"]
        told |= {
            f"{name}_fold_counts": fold_counts(tp, fp, fn, gt),
            f"{name}_proba_stats": proba_stats(decided, ["fold"]),
            f"{name}_hit_rates": hit_rates(decided),
            f"{name}_splits": split_summary(decided, list(range(outer))),
            f"{name}_params": param_recap(tried, choice),
            f"{name}_params_by_fold": param_top(tried, choice),
        }
        per_fold = fold_report(decided, ann, name, 0, 0.0).drop("width", "threshold")
        reports.append(per_fold.join(F.broadcast(cv.chosen), ["model", "fold"]))  # one row per fold
    report = cut_lineage(diag_union(reports))
    means = fold_mean(report.drop("params"))
    raw = [c for c in dataset.columns if "_t-" in c]
    told |= {
        "results": report, "means": means, "feature_importances": importance_rank(cv.importances),
        "nulls": null_report(dataset, [c for c in feature_columns(dataset) if c not in raw], raw),
    }
    write_summary(at.of("reports"), cv.failures, told)
    return means


def run_pipeline(
    spark: SparkSession, at: Folders, windows: list[int] | None = None, outer: int = 7, inner: int = 6,
    models: dict[str, M.ModelSpec] | None = None, force: bool = False, rule: str = "parity", version: str | None = None,
    aside: bool = False,
) -> dict[int, DataFrame]:
    """Everything, per window size. `aside`: what cannot be used goes to the table of dead letters, with a reason, and the
    run goes on."""
    signal = preprocess(spark, at, force, aside)
    labeled = label(spark, at, signal, force, rule, aside)
    models = models or {"gbt": M.build_models()["gbt"]}
    windows = windows or [WINDOW]
    return {
        w: evaluate(spark, at, build_dataset(spark, at, labeled, w, version=version, force=force, windows=windows), signal, models, outer, inner, rule, aside)
        for w in windows
    }


def train_final(spark: SparkSession, at: Folders, dataset: DataFrame, spec: M.ModelSpec, window: int = WINDOW) -> str:
    """Fit on everything and save the model with its post-processing."""
    model, names = M.fit_final(dataset, feature_columns(dataset), spec)
    path = f"{at.of('models')}/{window}s"
    save_model(spark, path, model, names, window, FINAL_WIDTH, FINAL_THRESHOLD)
    return path

