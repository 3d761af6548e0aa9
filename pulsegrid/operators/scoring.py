"""Event reports and metrics. All folds are scored at once: `fold` is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import clipped, ratio_or_zero
from pulsegrid.operators.blocks import BLOCK, attach_record_stats, block_of, with_halo
from pulsegrid.operators.events import (
    EVENT, both_block_runs, chained_runs, event_best_match, event_overlap, first_hit, nearest_onset, of_kind, unmatched,
)
from pulsegrid.operators.smoothing import confusion
from pulsegrid.schema import (
    KEYS, LABEL, MAX_EVENT_S, MERGE_GAP_S, STEP, TOLERANCE_S, WEIGHT_BOOST,
)
from pulsegrid.session import cut_lineage


def _with_latencies(
    truth: DataFrame, pred: DataFrame, ann: DataFrame, step: int, tol: int, keys: list[str]
) -> DataFrame:
    """True events with hit, signed latency and generalization offset."""
    found = first_hit(truth, pred, step, tol, tol, keys)
    told = nearest_onset(found, ann, keys=keys)
    return told.withColumn("lag_s", (F.col("hit") - F.col("i0")) * step)


def true_events(
    truth: DataFrame, pred: DataFrame, ann: DataFrame, step: int = STEP, tol: int = TOLERANCE_S,
    keys: list[str] = EVENT,
) -> DataFrame:
    """One row per true event: detected or not, detection latency, latency after generalization."""
    rows = _with_latencies(truth, pred, ann, step, tol, keys)
    det = clipped(F.col("lag_s"))
    return rows.select(
        *keys, "start_s", "end_s",
        F.col("hit").isNotNull().cast("int").alias("detected"),
        det.alias("det_latency_s"),
        clipped(det - F.col("gen_offset")).alias("gen_latency_s"),
        (F.col("end_s") - F.col("start_s")).alias("duration_s"),
    )


def true_positives(pairs: DataFrame, true_rows: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    """Predicted events that overlap a true one, with the latencies of their best match."""
    best = event_best_match(pairs, keys)
    latency = true_rows.select(*keys, F.col("start_s").alias("t_start"), "det_latency_s", "gen_latency_s")
    return best.join(latency, [*keys, "t_start"], "left").select(
        *keys, F.col("p_start").alias("start_s"), F.col("p_end").alias("end_s"),
        "det_latency_s", "gen_latency_s", (F.col("p_end") - F.col("p_start")).alias("duration_s"),
    )


def _report(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.select(*keys, "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))


def false_positives(pred: DataFrame, pairs: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    return _report(unmatched(pred, pairs, "p", keys), keys)


def false_negatives(truth: DataFrame, pairs: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    return _report(unmatched(truth, pairs, "t", keys), keys)


def fold_counts(tp: DataFrame, fp: DataFrame, fn: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows of each report and detected true events per fold."""
    def tagged(df: DataFrame, name: str, value: Column) -> DataFrame:
        cols = {n: F.lit(0) for n in ("tp", "fp", "fn", "detected")}
        cols[name] = value
        return df.select("fold", *[c.cast("bigint").alias(n) for n, c in cols.items()])

    rows = (
        tagged(tp, "tp", F.lit(1)).unionByName(tagged(fp, "fp", F.lit(1)))
        .unionByName(tagged(fn, "fn", F.lit(1))).unionByName(tagged(gt, "detected", F.col("detected")))
    )
    return rows.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "detected")])


def detection_latencies(
    truth: DataFrame, pred: DataFrame, ann: DataFrame, step: int = STEP, tol: int = TOLERANCE_S,
    min_len: int = 2, keys: list[str] = EVENT,
) -> DataFrame:
    """Detected true events of at least `min_len` samples: the signed latency, and the latency
    after generalization (null without an annotation near the start)."""
    rows = _with_latencies(truth.where(F.col("n") >= min_len), pred, ann, step, tol, keys)
    return rows.where(F.col("hit").isNotNull()).select(
        *keys, "start_s", F.col("lag_s").alias("det_latency_s"),
        clipped(clipped(F.col("lag_s")) - F.col("gen_offset")).alias("gen_latency_s"),
    )


def latency_report(latencies: DataFrame) -> DataFrame:
    return latencies.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_detected"),
        F.avg("det_latency_s").alias("detection_latency"),
        F.avg("gen_latency_s").alias("gen_latency"),
    )


def epoch_metrics(decided: DataFrame, by: list[str] | None = None, label: str = LABEL, pred: str = "pred") -> DataFrame:
    """Sample-level recall, precision and F1 (0 where undefined)."""
    counts = decided.groupBy(*(by or ["fold"])).agg(*confusion(label, pred))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "recall_epoch": ratio_or_zero(tp, tp + fn),
        "precision_epoch": ratio_or_zero(tp, tp + fp),
        "f1_epoch": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    })


def _pieces(local: DataFrame, step: int, merge_gap_s: int, max_len_s: int, keys: list[str], size: int) -> DataFrame:
    """Half-open events of both kinds: close neighbours merged, long ones cut."""
    runs = chained_runs(local, max(1, -(-merge_gap_s // step)), ["kind", *keys], size)
    stop = (F.col("i1") + 1) * step
    cut = F.explode(F.sequence(F.col("start_s"), stop - 1, F.lit(max_len_s).cast("bigint")))
    return runs.select("kind", *keys, stop.alias("_stop"), cut.alias("start_s")).select(
        "kind", *keys, "start_s", F.least("_stop", F.col("start_s") + max_len_s).alias("end_s")
    )


def event_metrics(
    decided: DataFrame, step: int = STEP, merge_gap_s: int = MERGE_GAP_S, max_len_s: int = MAX_EVENT_S,
    tol: int = TOLERANCE_S, label: str = LABEL, pred: str = "pred", keys: list[str] = EVENT, size: int = BLOCK,
    local: DataFrame | None = None,
) -> DataFrame:
    """Event-level counts, sensitivity, precision, F1 and false alarms per 24 h, per fold.

    Samples last `step` seconds; events closer than `merge_gap_s` are one; events longer than
    `max_len_s` are cut; a true event counts as found when a predicted one overlaps it, extended
    by the tolerances; a predicted event that overlaps no extended true one is a false alarm.
    `local` are the `both_block_runs` of `decided` where they are known already.
    """
    local = both_block_runs(decided, step, label, pred, keys, size) if local is None else local
    pieces = _pieces(local, step, merge_gap_s, max_len_s, keys, size)
    truth, hyp = of_kind(pieces, "true"), of_kind(pieces, "pred")
    pairs = event_overlap(hyp, truth, tol, tol, keys, half_open=True)
    hit = pairs.select(*keys, F.col("t_start").alias("start_s")).distinct()
    false = unmatched(hyp, pairs, "p", keys)

    def counted(df: DataFrame, **flags: int) -> DataFrame:
        return df.select("fold", *[F.lit(flags.get(c, 0)).cast("bigint").alias(c) for c in ("n_truth", "tp", "fp", "n")])

    rows = (
        counted(truth, n_truth=1).unionByName(counted(hit, tp=1))
        .unionByName(counted(false, fp=1)).unionByName(counted(decided, n=1))
    )
    sums = rows.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n_truth", "tp", "fp", "n")])
    tp, fp, n_truth = (F.col(c).cast("double") for c in ("tp", "fp", "n_truth"))
    sens, prec = F.col("sensitivity"), F.col("precision")
    return (
        sums.withColumn("sensitivity", F.try_divide(tp, n_truth))
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("f1", F.try_divide(2 * sens * prec, sens + prec))
        .withColumn("far_24h", fp * 24.0 / (F.col("n") * step / 3600.0))
    )


def fold_report(
    decided: DataFrame, ann: DataFrame, model: str, width: int, threshold: float, step: int = STEP,
    tol: int = TOLERANCE_S, size: int = BLOCK,
) -> DataFrame:
    """One row per fold with every metric. `decided` holds idx, label and pred of all folds and is
    read several times: hand in a written or checkpointed table."""
    local = cut_lineage(both_block_runs(decided, step, size=size))  # one pass finds the runs of both gaps
    runs = chained_runs(local, 1, ["kind", *EVENT], size)
    truth, pred = of_kind(runs, "true"), of_kind(runs, "pred")
    lat = latency_report(detection_latencies(truth, pred, ann, step, tol)).drop("n_detected")
    ev = event_metrics(decided, step, tol=tol, size=size, local=local)
    ep = epoch_metrics(decided).drop("tp", "fp", "fn", "tn")
    joined = ev.join(ep, "fold").join(lat, "fold", "left")
    return joined.select(
        F.lit(model).alias("model"), "fold", "f1", "f1_epoch", "precision", "precision_epoch",
        F.col("sensitivity").alias("recall"), "recall_epoch", F.col("sensitivity").alias("sens_evt"),
        F.col("fp").cast("double").alias("fp_evt"), F.col("far_24h").alias("far_evt"),
        F.lit(float(width)).alias("width"), F.lit(float(threshold)).alias("threshold"),
        "detection_latency", "gen_latency",
    )


def fold_mean(report: DataFrame) -> DataFrame:
    """Mean of every metric per model; a fold without a latency does not count for it."""
    metrics = [c for c in report.columns if c not in ("model", "fold", "width", "threshold")]
    return report.groupBy("model").agg(*[F.avg(c).alias(c) for c in metrics])


def proba_stats(scored: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    return scored.groupBy(*(by or []), LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("score_min"),
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
    )


def hit_rates(decided: DataFrame, by: list[str] | None = None, pred: str = "pred") -> DataFrame:
    """Percentage predicted 1 among the positives and among the negatives."""
    def share(y: int) -> Column:
        return F.avg(F.when(F.col(LABEL) == y, (F.col(pred) == 1).cast("double"))) * 100

    return decided.groupBy(*(by or ["fold"])).agg(share(1).alias("pct_pos"), share(0).alias("pct_neg"))


def class_weight(df: DataFrame, by: list[str] | None = None, boost: float = WEIGHT_BOOST) -> DataFrame:
    """neg/pos ratio (1 without positives), the boosted positive-class weight, and the balanced
    weights of both classes."""
    pos = F.sum((F.col(LABEL) == 1).cast("bigint"))
    counts = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), pos.alias("n_pos"))
    n, p = F.col("n").cast("double"), F.col("n_pos").cast("double")
    ratio = F.coalesce(F.try_divide(n - p, p), F.lit(1.0))
    return counts.withColumns({
        "ratio": ratio, "scale_pos": ratio * boost,
        "balanced_pos": F.try_divide(n, 2 * p), "balanced_neg": F.try_divide(n, 2 * (n - p)),
    })


def _value_block(value: Column) -> Column:
    """Monotone blocks for values of any scale: blocks are narrow where values are small."""
    scaled = F.floor(F.log1p(F.abs(value)) * 4096)
    return F.when(value < 0, -scaled - 1).otherwise(scaled)


def exact_median(counts: DataFrame, by: list[str], value: str, count: str, name: str) -> DataFrame:
    """Median of weighted values: `counts` has one row per distinct (by, value).

    Cumulative counts are formed through blocks of values, so no group is sorted or held in one
    buffer.
    """
    blocked = counts.withColumn("_block", _value_block(F.col(value)))
    placed = attach_record_stats(
        blocked, by, "_block", {"_s": F.sum(count)},
        lambda whole, ordered: {
            "_base": F.coalesce(F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_all": F.sum("_s").over(whole),
        },
    )
    inside = Window.partitionBy(*by, "_block").orderBy(value)
    upto = F.col("_base") + F.sum(count).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col(count))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(value)))

    return ranked.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(name))


def split_summary(
    df: DataFrame, folds: list[int], time: str = "time", pos: str = "idx", keys: list[str] = KEYS,
    size: int = BLOCK,
) -> DataFrame:
    """Per fold, as TEST (its rows) and TRAIN (all other rows): groups, rows, events, positives,
    their share, and the duration (sum over records + the median step between rows).

    One frame gives the step and the label before each row; rows are reduced to (record, step) at once,
    and all sums and step counts come from that small table. Only rows per fold are repeated for TRAIN.
    """
    fold_keys = ["fold", *keys]
    w = Window.partitionBy(*fold_keys, "_block").orderBy(pos)
    before = lambda c: F.lag(c).over(w)
    edge = (F.col(LABEL) == 1) & (F.coalesce(before(LABEL), F.lit(0)) == 0)
    framed = with_halo(df.select(*fold_keys, time, pos, LABEL), pos, before=1, size=size).select(
        *fold_keys, time, LABEL, "_own", edge.cast("int").alias("edge"), (F.col(time) - before(time)).alias("step")
    )
    cells = cut_lineage(framed.where("_own").groupBy(*fold_keys, "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("edge").alias("events"), F.sum(F.col(LABEL).cast("bigint")).alias("pos"),
        F.min(time).alias("_t0"), F.max(time).alias("_t1"),
    ))
    per_record = cells.groupBy(*fold_keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "events", "pos")], (F.max("_t1") - F.min("_t0")).alias("dur"),
    )
    per_group = per_record.groupBy("fold", "grp").agg(*[F.sum(c).alias(c) for c in ("n", "events", "pos", "dur")])
    per_fold = per_group.groupBy("fold").agg(
        F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in ("n", "events", "pos", "dur")]
    )
    parts = ["groups", "n", "events", "pos", "dur"]
    both = _as_sides(per_fold, folds).groupBy("fold", "tag").agg(*[F.sum(c).alias(c) for c in parts])

    counts = cells.where("step is not null").groupBy("fold", "step").agg(F.sum("n").alias("_c"))
    sides = _as_sides(counts, folds).groupBy("fold", "tag", "step").agg(F.sum("_c").alias("_c"))
    medians = exact_median(sides, ["fold", "tag"], "step", "_c", "median_step")
    joined = both.join(medians, ["fold", "tag"], "left")
    return joined.select(
        "fold", "tag", "groups", F.col("n").alias("n_rows"), "events", F.col("pos").alias("positives"),
        F.try_divide(F.col("pos").cast("double"), F.col("n").cast("double")).alias("pos_share"),
        (F.col("dur") + F.coalesce("median_step", F.lit(0.0))).alias("duration_s"),
    )


def _as_sides(per_fold: DataFrame, folds: list[int]) -> DataFrame:
    """Rows of fold f once as TEST of f and once as TRAIN of every other fold; for tables already
    aggregated per fold."""
    tag = F.when(F.col("_as") == F.col("fold"), "TEST").otherwise("TRAIN")
    return (
        per_fold.withColumn("_as", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn("tag", tag)
        .drop("fold").withColumnRenamed("_as", "fold")
    )


def roc_auc(scored: DataFrame, by: list[str] | None = None, score: str = "score", label: str = LABEL) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; null with one class only.

    Rows are first reduced to distinct scores; negatives below each score are then counted through
    blocks of log-odds, which spread scores that crowd at 0 or 1.
    """
    by = by or ["fold"]
    y = F.col(label).cast("bigint")
    counts = scored.groupBy(*by, score).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    p = F.col(score)
    odds = F.when(p <= 0, -60.0).when(p >= 1, 60.0).otherwise(F.greatest(F.lit(-59.0), F.least(F.lit(59.0), F.log(p / (1 - p)))))
    blocked = counts.withColumn("_block", F.floor(odds * 4096))
    placed = attach_record_stats(
        blocked, by, "_block", {"_s": F.sum("_n")},
        lambda whole, ordered: {
            "_base": F.coalesce(F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        },
    )
    inside = Window.partitionBy(*by, "_block").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    won = F.col("_p") * (below + F.col("_n") / 2)
    sums = placed.withColumn("_won", won).groupBy(*by).agg(
        F.sum("_won").alias("_won"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_won"), pairs).alias("roc_auc"))


def param_recap(results: DataFrame, params: list[str], top: int = 10) -> DataFrame:
    """Mean and population std of the inner F1 per parameter choice, best first."""
    return (
        results.groupBy(*params)
        .agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("f1_mean"), *params).limit(top)
    )


def param_top(results: DataFrame, params: list[str], top: int = 5) -> DataFrame:
    """The best parameter choices of each outer fold by mean inner F1 (one row per fold and choice
    goes into the rank)."""
    means = results.groupBy("fold", *params).agg(F.avg("f1").alias("f1_mean"), F.avg("recall").alias("recall_mean"))
    w = Window.partitionBy("fold").orderBy(F.desc("f1_mean"), *params)
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def importance_rank(importances: DataFrame, top: int | None = None) -> DataFrame:
    """Importances normalised per fold, summed over folds and normalised again, best first; `top` is
    per model."""
    total = F.sum("importance").over(Window.partitionBy("model", "fold"))
    per_fold = importances.withColumn("v", F.coalesce(F.try_divide(F.col("importance"), total), F.lit(0.0)))
    summed = per_fold.groupBy("model", "feature").agg(F.sum("v").alias("v"))
    share = F.coalesce(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("model"))), F.lit(0.0))
    out = summed.withColumn("importance", share).drop("v")
    if top:
        best = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
        out = out.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank")
    return out.orderBy("model", F.desc("importance"), "feature")
