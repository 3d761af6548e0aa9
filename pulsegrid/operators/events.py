"""Runs of positive samples as events, and joins between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import overlap_length
from pulsegrid.operators.blocks import BLOCK, block_of, time_block, with_halo, with_position
from pulsegrid.schema import KEYS, ONSET_TOLERANCE_S, STEP, TOLERANCE_S

# Length of the time cells that event joins are keyed by, in seconds.
CELL_S = 3600
EVENT = ["fold", *KEYS]


def elapsed_by_position(
    df: DataFrame, step: int = STEP, time: str = "time", keys: list[str] = KEYS, size: int = BLOCK
) -> DataFrame:
    """`idx` (position in the record) and `elapsed_s` = idx * step; rows without a time come first."""
    placed = with_position(df.withColumn("_block", time_block(time, size)), keys, [time], "_block")
    return placed.withColumn("elapsed_s", F.col("idx") * step).drop("_block")


def block_runs(
    df: DataFrame, flag: str, step: int = STEP, pos: str = "idx", keys: list[str] = EVENT, size: int = BLOCK,
    clock: str | None = None,
) -> DataFrame:
    """Runs of `flag` = 1 as far as they lie in one block: (`_block`, i0, i1, n, start_s, end_s)."""
    seconds = F.col(pos) * step if clock is None else F.rint(clock).cast("bigint")
    ones = df.where(F.col(flag) == 1).select(
        *keys, F.col(pos).alias("i0"), F.col(pos).alias("i1"), F.lit(1).cast("bigint").alias("n"),
        block_of(pos, size).alias("_block"), seconds.alias("start_s"), seconds.alias("end_s"),
    )
    return _merged(ones, "_block", 1, keys)


def _merged(rows: DataFrame, part: str, min_gap: int, keys: list[str]) -> DataFrame:
    """Rows (i0, i1) of one (record, `part`) with fewer than `min_gap` zeros between them become one."""
    w = Window.partitionBy(*keys, part).orderBy("i0")
    fresh = F.when(F.col("i0") - F.lag("i1").over(w) - 1 < min_gap, 0).otherwise(1)
    numbered = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, part, "_run").agg(
        F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.sum("n").alias("n"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
    ).drop("_run")


def chained_runs(local: DataFrame, min_gap: int = 1, keys: list[str] = EVENT, size: int = BLOCK) -> DataFrame:
    """Whole runs from those of `block_runs`; runs with fewer than `min_gap` zeros between them are one.

    Only those within reach of a block border (at most a few per block) are chained per record, so the
    record-wide step sees a tiny fraction of the samples. `min_gap` must not exceed half a block.
    """
    if 2 * min_gap > size:
        raise ValueError("blocks must be at least twice as long as the gap")
    if min_gap > 1:
        local = _merged(local, "_block", min_gap, keys)
    at_border = (F.col("i0") - F.col("_block") * size < min_gap) | (
        (F.col("_block") + 1) * size - 1 - F.col("i1") < min_gap
    )
    parts = local.withColumn("_part", F.when(at_border, F.lit(-1)).otherwise(F.col("_block"))).drop("_block")
    return _merged(parts, "_part", min_gap, keys).drop("_part")


def event_runs(
    df: DataFrame, flag: str, step: int = STEP, min_gap: int = 1, pos: str = "idx",
    keys: list[str] = EVENT, size: int = BLOCK, clock: str | None = None,
) -> DataFrame:
    """Runs of `flag` = 1 per record as (i0, i1, n, start_s, end_s); end is the last positive.

    Seconds are position * step, or the times in column `clock` (whole seconds) if one is named.
    """
    return chained_runs(block_runs(df, flag, step, pos, keys, size, clock), min_gap, keys, size)


def both_block_runs(
    decided: DataFrame, step: int = STEP, label: str = "label", pred: str = "pred", keys: list[str] = EVENT,
    size: int = BLOCK, clock: str | None = None,
) -> DataFrame:
    """`block_runs` of true and of predicted samples in one pass over `decided`; `kind` tells them apart."""
    flags = F.array(
        F.struct(F.lit("true").alias("kind"), F.col(label).cast("int").alias("_flag")),
        F.struct(F.lit("pred").alias("kind"), F.col(pred).cast("int").alias("_flag")),
    )
    held = [*keys, "idx"] + ([clock] if clock else [])
    rows = decided.select(*held, F.explode(flags).alias("_k")).select(*held, "_k.kind", "_k._flag")
    return block_runs(rows, "_flag", step, "idx", ["kind", *keys], size, clock)


def both_runs(
    decided: DataFrame, step: int = STEP, min_gap: int = 1, label: str = "label", pred: str = "pred",
    keys: list[str] = EVENT, size: int = BLOCK, clock: str | None = None,
) -> DataFrame:
    """Runs of true and of predicted samples; `kind` tells them apart."""
    return chained_runs(both_block_runs(decided, step, label, pred, keys, size, clock), min_gap, ["kind", *keys], size)


def of_kind(runs: DataFrame, kind: str) -> DataFrame:
    return runs.where(F.col("kind") == kind).drop("kind")


def rising_edges(
    df: DataFrame, flag: str = "label", pos: str = "idx", keys: list[str] = KEYS, size: int = BLOCK
) -> DataFrame:
    """Rows where the flag turns 1 (the value before a record counts as 0): adds `edge`."""
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    edge = (F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0)
    spread = with_halo(df, pos, before=1, size=size)
    return spread.select(*df.columns, "_own", edge.cast("int").alias("edge")).where("_own").drop("_own")


def event_overlap(
    pred: DataFrame,
    truth: DataFrame,
    tol_start: int = TOLERANCE_S,
    tol_end: int = TOLERANCE_S,
    keys: list[str] = EVENT,
    half_open: bool = False,
    cell: int = CELL_S,
) -> DataFrame:
    """Pairs of predicted and true events of a record that overlap within the tolerances.

    Both sides are cut into the time cells they touch and joined on (record, cell); a pair is kept
    only in the cell where its overlap begins, so it comes out once and without a distinct. Events
    of one side are disjoint, which bounds the pairs of a cell by its length. `half_open` asks
    for a positive overlap instead of a shared second.
    """
    p_from, p_to = F.col("p_start"), F.col("p_end")
    t_from, t_to = F.col("t_start") - tol_start, F.col("t_end") + tol_end

    def cells(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(block_of(a, cell), block_of(b, cell)))

    p = pred.select(*keys, F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    t = truth.select(*keys, *[
        F.col(c).alias(f"t_{c.removesuffix('_s')}") for c in ("start_s", "end_s", "i0", "i1") if c in truth.columns
    ])
    p = p.withColumn("_cell", cells(p_from, p_to))
    t = t.withColumn("_cell", cells(t_from, t_to))
    meet = (p_to > t_from) & (p_from < t_to) if half_open else (p_to >= t_from) & (p_from <= t_to)
    begins = F.col("_cell") == block_of(F.greatest(p_from, t_from), cell)
    return p.join(t, [*keys, "_cell"]).where(meet & begins).drop("_cell")


def event_best_match(pairs: DataFrame, keys: list[str] = EVENT) -> DataFrame:
    """One true event per predicted one: longest overlap, then nearest start, then earliest.

    An aggregate rather than a rank: a prediction over very many truths is combined on the map
    side.
    """
    length = overlap_length(F.col("p_start"), F.col("p_end"), F.col("t_start"), F.col("t_end"))
    order = F.struct(
        (-length).alias("o"), F.abs(F.col("t_start") - F.col("p_start")).alias("d"),
        F.col("t_start"), F.col("t_end"),
    )
    best = pairs.groupBy(*keys, "p_start", "p_end").agg(F.min(order).alias("_b"))
    return best.select(
        *keys, "p_start", "p_end", F.col("_b.t_start").alias("t_start"), F.col("_b.t_end").alias("t_end"),
        (-F.col("_b.o")).alias("overlap_s"),
    )


def unmatched(events: DataFrame, pairs: DataFrame, side: str, keys: list[str] = EVENT) -> DataFrame:
    """Events of one side ("p" or "t") that occur in no pair."""
    seen = pairs.select(*keys, F.col(f"{side}_start").alias("start_s")).distinct()
    return events.join(seen, [*keys, "start_s"], "left_anti")


def nearest_onset(
    events: DataFrame, ann: DataFrame, tol: int = ONSET_TOLERANCE_S, keys: list[str] = EVENT
) -> DataFrame:
    """Events with the closest annotation onset within `tol` seconds of their start (the first
    listed on a tie); events without one keep nulls.

    Onsets are joined through cells as wide as the tolerance, so an event meets only onsets near
    its start.
    """
    on = [k for k in KEYS if k in ann.columns]
    cell = max(1, 2 * tol)
    notes = ann.select(*on, F.col("onset").cast("bigint").alias("onset"), "ann_pos", "gen_offset").withColumn(
        "_cell", block_of("onset", cell)
    )
    near = F.sequence(block_of(F.col("start_s") - tol, cell), block_of(F.col("start_s") + tol, cell))
    off = F.abs(F.col("onset") - F.col("start_s"))
    found = (
        events.select(*keys, "start_s", F.explode(near).alias("_cell"))
        .join(notes, [*on, "_cell"])
        .where(off <= tol)
        .groupBy(*keys, "start_s")
        .agg(F.min(F.struct(off.alias("d"), F.col("ann_pos"), F.col("onset"), F.col("gen_offset"))).alias("_a"))
    )
    joined = events.join(found, [*keys, "start_s"], "left")
    return joined.select(*events.columns, F.col("_a.onset").alias("onset"), F.col("_a.gen_offset").alias("gen_offset"))


def first_hit(
    truth: DataFrame, pred: DataFrame, step: int = STEP, tol_start: int = TOLERANCE_S,
    tol_end: int = TOLERANCE_S, keys: list[str] = EVENT, cell: int = CELL_S,
) -> DataFrame:
    """True events with `hit`: the first positive sample of the tolerant window, or null.

    The window is [i0 - tol_start // step, i1 + 1 + tol_end // step) in samples, inside the record.
    Predicted runs stand for the positive samples: the first hit in a run is where the run and the
    window begin to overlap.
    """
    back, ahead, unit = tol_start // step, tol_end // step, max(1, cell // step)
    lo = F.greatest(F.lit(0), F.col("i0") - back)
    hi = F.col("i1") + ahead

    def cells(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(block_of(a, unit), block_of(b, unit)))

    windows = truth.select(*keys, "start_s", lo.alias("_lo"), hi.alias("_hi"), cells(lo, hi).alias("_cell"))
    runs = pred.select(
        *keys, F.col("i0").alias("_p0"), F.col("i1").alias("_p1"), cells(F.col("i0"), F.col("i1")).alias("_cell")
    )
    hits = (
        windows.join(runs, [*keys, "_cell"])
        .where((F.col("_p1") >= F.col("_lo")) & (F.col("_p0") <= F.col("_hi")))
        .groupBy(*keys, "start_s")
        .agg(F.min(F.greatest("_lo", "_p0")).alias("hit"))
    )
    return truth.join(hits, [*keys, "start_s"], "left").select(*truth.columns, "hit")
