"""Sliding-window features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators.blocks import BLOCK, block_of, time_block, with_position
from pulsegrid.schema import CHANNELS, FEATURE_PREFIX, FEATURES, KEYS, LABEL, STEP, TIME, WINDOW


def window_members(
    df: DataFrame,
    windows: list[int],
    step: int = STEP,
    time: str = TIME,
    keys: list[str] = KEYS,
    pos: str | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """One row per (sample, window it belongs to): adds `window`, `idx` (window number), `off`
    (place of the sample inside the window) and `_block` (block of the window's first sample).

    Windows count samples, not seconds. Samples are shuffled once, by (record, block), together
    with the few that windows of the block before reach into; a window's samples are then all in
    one task, and grouping by (record, `_block`, window, idx) needs no further exchange. A sample
    lies in at most ceil(window/step) windows, and nothing is evaluated between strides. `pos`
    names the sample's position in its record where an earlier step has placed it already, which
    saves the counting pass.
    """
    if pos is None:
        placed = with_position(df.withColumn("_cell", time_block(time, size)), keys, [time], "_cell", "_pos").drop("_cell")
    else:
        placed = df.withColumn("_pos", F.col(pos))
    # a sample belongs to windows that begin up to max(windows) - 1 positions before it
    starts = F.sequence(block_of(F.greatest(F.lit(0), F.col("_pos") - (max(windows) - 1)), size), block_of("_pos", size))
    spread = placed.withColumn("_block", F.explode(starts)).repartition(*keys, "_block")
    homes = [
        F.struct(
            F.lit(w).cast("smallint").alias("window"),
            (F.floor(F.col("_pos") / step) - back).alias("idx"),
        )
        for w in windows
        for back in range(math.ceil(w / step))
    ]
    members = spread.withColumn("_home", F.explode(F.array(*homes)))
    return (
        members.withColumn("window", F.col("_home.window"))
        .withColumn("idx", F.col("_home.idx"))
        .withColumn("off", F.col("_pos") - F.col("idx") * step)
        .where(
            (F.col("idx") >= 0) & (F.col("off") < F.col("window"))
            & (block_of(F.col("idx") * step, size) == F.col("_block"))
        )
        .drop("_home", "_pos")
    )


def _at(c: str, place: Column) -> Column:
    return F.max(F.when(F.col("off") == place, F.col(c)))


def panes(
    df: DataFrame, length: int, reach: int, channels: list[str], time: str = TIME, keys: list[str] = KEYS,
    pos: str | None = None, size: int = BLOCK,
) -> DataFrame:
    """One row per pane, `length` samples in a row: number of rows, clock of the last, label, and of each
    channel what windows need, in a form in which neighbouring panes can be merged: count, mean, sum of squared
    deviations, least, largest, first and last value.

    Panes are dealt by (record, `_block`), and each is also given to the block before if a window of `reach` panes
    that begins there holds it. Samples are shuffled once, and not repeated inside a block.
    """
    if pos is None:
        placed = with_position(df.withColumn("_cell", time_block(time, size)), keys, [time], "_cell", "_pos").drop("_cell")
    else:
        placed = df.withColumn("_pos", F.col(pos))
    per_block = max(1, size // length)
    pane = F.floor(F.col("_pos") / length)
    blocks = F.sequence(block_of(F.greatest(F.lit(0), pane - (reach - 1)), per_block), block_of(pane, per_block))
    spread = placed.select(*keys, time, LABEL, *channels, pane.alias("_pane"), (F.col("_pos") % length).alias("off"), F.explode(blocks).alias("_block"))
    aggs = [F.count(F.lit(1)).alias("_n"), _at(time, F.lit(length - 1)).alias("_time"), F.max(LABEL).alias("_label")]
    for i, c in enumerate(channels):
        aggs += [
            F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_m{i}"), (F.var_pop(c) * F.count(c)).alias(f"_q{i}"), F.min(c).alias(f"_l{i}"),
            F.max(c).alias(f"_h{i}"), _at(c, F.lit(0)).alias(f"_a{i}"), _at(c, F.lit(length - 1)).alias(f"_z{i}"),
        ]
    return spread.repartition(*keys, "_block").groupBy(*keys, "_block", "_pane").agg(*aggs)


def _merged(df: DataFrame, next_: str, channels: int) -> DataFrame:
    """The running columns of each row, lengthened by the pane in struct `next_` (Chan's pairwise update)."""
    g = lambda c: F.col(f"{next_}.{c}")
    out = {"_n": F.col("_n") + g("_n"), "_time": g("_time"), "_label": F.greatest("_label", g("_label"))}
    for i in range(channels):
        n, m, q = F.col(f"_n{i}"), F.col(f"_m{i}"), F.col(f"_q{i}")
        both, apart = n + g(f"_n{i}"), g(f"_m{i}") - m
        share = g(f"_n{i}") / F.nullif(both, F.lit(0))
        out |= {
            f"_n{i}": both, f"_m{i}": F.coalesce(m + apart * share, m, g(f"_m{i}")),
            f"_q{i}": F.coalesce(q + g(f"_q{i}") + apart * apart * n * share, q, g(f"_q{i}")),
            f"_l{i}": F.least(f"_l{i}", g(f"_l{i}")), f"_h{i}": F.greatest(f"_h{i}", g(f"_h{i}")), f"_z{i}": g(f"_z{i}"),
        }
    return df.withColumns(out)


def window_features(
    df: DataFrame,
    windows: list[int] | None = None,
    step: int = STEP,
    channels: dict[str, str] = FEATURE_PREFIX,
    time: str = TIME,
    keys: list[str] = KEYS,
    pos: str | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Mean, population std, range (first channel), last-minus-first of every channel, and the
    ratio of the first two deltas, over full windows of `window` samples every `step` samples.

    `df` holds one row per (record, time). Times are the last sample's, labels the maximum. A row
    without a time counts as a sample before all others of its record.
    Nulls are skipped by the statistics; a delta is null when either end is.

    Samples are reduced to panes first, as long as what all window sizes and the step can be divided by. Each
    pane that begins a stride looks at the panes after it, and merges them one by one; a window of any size is a stop
    on that way, so that no sample or pane is repeated for a window.
    """
    windows = windows or [WINDOW]
    length = math.gcd(step, *windows)
    stride, reach = step // length, max(windows) // length
    parts = panes(df, length, reach, list(channels), time, keys, pos, size)
    state = [c for c in parts.columns if c not in (*keys, "_block", "_pane")]
    ahead = Window.partitionBy(*keys, "_block").orderBy("_pane")
    lined = parts.withColumn("_p", F.struct(*state))
    lined = lined.select("*", *[F.lead("_p", j).over(ahead).alias(f"_p{j}") for j in range(1, reach)]).drop("_p")
    own = block_of("_pane", max(1, size // length)) == F.col("_block")
    lined = lined.where((F.col("_pane") % stride == 0) & own & (F.col("_n") == length))
    names, stops = [], []
    prefixes = list(channels.values())

    def closed(window: int) -> Column:
        """The features of the panes merged so far."""
        cols = [F.lit(window).cast("smallint").alias("window"), (F.col("_n") == window).alias("_full"), F.col("_time").alias("time"), F.col("_label").alias(LABEL)]
        for i, p in enumerate(prefixes):
            cols += [F.col(f"_m{i}").alias(f"{p}_mean"), F.sqrt(F.col(f"_q{i}") / F.nullif(F.col(f"_n{i}"), F.lit(0))).alias(f"{p}_std"), (F.col(f"_z{i}") - F.col(f"_a{i}")).alias(f"Delta{p}")]
            if i == 0:
                cols.append((F.col(f"_h{i}") - F.col(f"_l{i}")).alias(f"{p}_range"))
        return F.struct(*cols)

    for i, p in enumerate(prefixes):
        names += [f"{p}_mean", *([f"{p}_range"] if i == 0 else []), f"{p}_std", f"Delta{p}"]
    for j in range(1, reach + 1):
        if j > 1:
            lined = _merged(lined, f"_p{j - 1}", len(prefixes))
        for window in dict.fromkeys(w for w in windows if w == j * length):
            lined = lined.withColumn(f"_w{window}", closed(window))
            stops.append(f"_w{window}")
    idx = F.floor(F.col("_pane") / stride).alias("idx")
    out = lined.select(*keys, idx, F.explode(F.array(*stops)).alias("_w")).where("_w._full").select(*keys, "idx", "_w.*")
    if len(prefixes) > 1:
        ratio = f"Ratio_D{prefixes[0]}_D{prefixes[1]}"
        names.append(ratio)
        out = out.withColumn(ratio, F.try_divide(f"Delta{prefixes[0]}", f"Delta{prefixes[1]}"))
    return out.select(*keys, "time", "window", "idx", *names, LABEL)


def band_power(
    df: DataFrame,
    channel: str = CHANNELS[0],
    bands: dict[str, tuple[int, int]] | None = None,
    window: int = WINDOW,
    step: int = STEP,
    time: str = TIME,
    keys: list[str] = KEYS,
    pos: str | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Spectral power of one channel per window, in bands of DFT bins [first, last].

    The bins are plain cosine and sine sums of the mean-free window (a null sample adds nothing),
    so they aggregate like any other sum.
    """
    bands = bands or {"low": (1, 2), "mid": (3, 4), "high": (5, 7)}
    bins = sorted({k for a, b in bands.values() for k in range(a, b + 1)})
    x, off = F.col(channel), F.col("off")
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(channel).alias("_mean"), _at(time, F.lit(window - 1)).alias("time")]
    for k in bins:
        angle = off * (2 * math.pi * k / window)
        seen = x.isNotNull()
        aggs += [
            F.sum(x * F.cos(angle)).alias(f"_c{k}"), F.sum(x * F.sin(angle)).alias(f"_s{k}"),
            F.sum(F.when(seen, F.cos(angle))).alias(f"_c{k}u"), F.sum(F.when(seen, F.sin(angle))).alias(f"_s{k}u"),
        ]
    grouped = (
        window_members(df, [window], step, time, keys, pos, size)
        .groupBy(*keys, "_block", "window", "idx").agg(*aggs).where(F.col("_n") == window)
    )

    def power(k: int) -> Column:
        c = F.col(f"_c{k}") - F.col("_mean") * F.col(f"_c{k}u")
        s = F.col(f"_s{k}") - F.col("_mean") * F.col(f"_s{k}u")
        return (c * c + s * s) / window

    cols = [
        sum((power(k) for k in range(a + 1, b + 1)), power(a)).alias(f"power_{name}")
        for name, (a, b) in bands.items()
    ]
    return grouped.select(*keys, "time", "idx", *cols)


def feature_select(features: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of one window size, without that column, columns in name order."""
    kept = features.where(F.col("window") == window).drop("window")
    return kept.select(*sorted(kept.columns))


__all__ = ["window_members", "window_features", "band_power", "feature_select", "FEATURES"]
