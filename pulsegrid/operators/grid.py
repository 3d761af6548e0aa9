"""The one-second grid and raw context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import nan_to_null, round_seconds
from pulsegrid.operators.blocks import BLOCK, block_of, task_count, with_halo
from pulsegrid.schema import (
    CHANNELS, KEYS, MAX_FILL_AGE_S, MAX_SECOND, MAX_SPAN_S, WINDOW,
)


def with_second(df: DataFrame, time: str = "time") -> DataFrame:
    """Adds `sec`; rows without a usable time go."""
    t = nan_to_null(F.col(time).cast("double"))
    finite = t.isNotNull() & (F.abs(t) < float("inf"))
    return df.where(finite).withColumn("sec", round_seconds(t))


def last_per_second(
    df: DataFrame, order: str, channels: list[str] = CHANNELS, keys: list[str] = KEYS
) -> DataFrame:
    """Last non-null value of every channel in each (record, second)."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in channels]
    return df.groupBy(*keys, "sec").agg(*picks)


def record_bounds(per_second: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return per_second.groupBy(*keys).agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))


def _absurd(max_span: int, max_second: int) -> Column:
    span = F.col("hi") - F.col("lo")
    return (span < 0) | (span > max_span) | (F.col("hi") > max_second)


def span_guard(
    bounds: DataFrame, max_span: int = MAX_SPAN_S, max_second: int = MAX_SECOND, strict: bool = False
) -> DataFrame:
    """Records whose seconds cannot be relative times.

    strict: hand all bounds on and fail the job at the first such record; this sits before any
    grid is generated, so a stray epoch never becomes billions of rows.
    """
    bad = _absurd(max_span, max_second)
    if not strict:
        return bounds.where(bad).withColumn("span", F.col("hi") - F.col("lo"))
    told = F.concat(F.lit("seconds are not relative in record "), F.col("record"))
    return bounds.withColumn("hi", F.when(bad, F.raise_error(told).cast("bigint")).otherwise(F.col("hi")))


def grid_skeleton(bounds: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every second of [lo, hi], generated block by block so that one long record is spread."""
    keys = [c for c in bounds.columns if c not in ("lo", "hi")]
    blocks = bounds.withColumn("_block", F.explode(F.sequence(block_of("lo", size), block_of("hi", size))))
    spread = blocks.repartition(task_count(bounds.sparkSession), *keys, "_block")
    first = F.greatest(F.col("lo"), F.col("_block") * size)
    final = F.least(F.col("hi"), (F.col("_block") + 1) * size - 1)
    return spread.select(*keys, F.explode(F.sequence(first, final)).alias("sec"))


def grid_1hz(
    per_second: DataFrame, channels: list[str] = CHANNELS, keys: list[str] = KEYS, strict: bool = True,
    size: int = BLOCK,
) -> DataFrame:
    """Contiguous seconds per record, gaps null."""
    bounds = record_bounds(per_second, keys)
    if strict:
        bounds = span_guard(bounds, strict=True)
    seconds = grid_skeleton(bounds, size)
    return seconds.join(per_second.select(*keys, "sec", *channels), [*keys, "sec"], "left")


def bounded_ffill(
    grid: DataFrame, max_age: int = MAX_FILL_AGE_S, channels: list[str] = CHANNELS,
    keys: list[str] = KEYS, size: int = BLOCK,
) -> DataFrame:
    """Fill gaps with the last value no older than `max_age` seconds."""
    rest = [c for c in grid.columns if c not in channels]
    frame = Window.partitionBy(*keys, "_block").orderBy("sec").rangeBetween(-max_age, 0)
    spread = with_halo(grid, "sec", before=max_age, size=size)
    filled = spread.select(*rest, "_own", *[F.last(c, True).over(frame).alias(c) for c in channels])
    return filled.where("_own").drop("_own").select(grid.columns)


def resample_1hz(
    per_second: DataFrame, max_age: int = MAX_FILL_AGE_S, channels: list[str] = CHANNELS,
    keys: list[str] = KEYS, size: int = BLOCK,
) -> DataFrame:
    return bounded_ffill(grid_1hz(per_second, channels, keys, size=size), max_age, channels, keys, size)


def context_names(window: int = WINDOW, channels: list[str] = CHANNELS) -> list[str]:
    return [f"{c}_t-{k}" for c in sorted(channels) for k in range(window - 1, -1, -1)]


def context_windows(
    starts: DataFrame,
    per_second: DataFrame,
    window: int = WINDOW,
    alignment: str = "trailing",
    channels: list[str] = CHANNELS,
    keys: list[str] = KEYS,
    time: str = "time",
    size: int = BLOCK,
) -> DataFrame:
    """`starts` with the raw seconds around each row as columns `<channel>_t-<k>`.

    alignment="forward": the slice [second, second + window), `t-(window-1)` being the row's own
    second; "trailing": the slice that ends at the row's second (`t-0`), which keeps later
    samples out of the model. A slice that leaves the record's grid is null as a whole, gaps are
    null cells, a record without raw samples gives nulls.

    No grid is built and nothing is joined. Samples are first folded into cells of `window`
    seconds, one array with the channels of each second side by side, so any slice lies in a cell
    and the next one. Cells, rows and record bounds are then stacked by (record, block) and each
    row picks its two cells with RANGE frames: the sort and the frames see one row per cell
    instead of one per sample.
    """
    if alignment not in ("forward", "trailing"):
        raise ValueError(alignment)
    reach = window - 1
    names = sorted(channels)
    per_block = max(1, size // window)
    slot = F.col("sec") - F.col("_cell") * window
    places = [(j, c) for j in range(window) for c in names]
    cells = (
        per_second.withColumn("_cell", block_of("sec", window))
        .repartition(*keys, "_cell")  # before the pivot: its rows are wide, the samples are not
        .groupBy(*keys, "_cell")
        .agg(*[F.max(F.when(slot == j, F.col(c))).alias(f"_{j}_{c}") for j, c in places])
        .select(*keys, "_cell", F.array(*[f"_{j}_{c}" for j, c in places]).alias("_values"))
    )
    cells = with_halo(cells, "_cell", after=1, size=per_block).drop("_own")
    edges = record_bounds(per_second, keys).select(
        *keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.explode(F.sequence(
            block_of(block_of(F.col("lo"), window), per_block), block_of(block_of(F.col("hi"), window), per_block)
        )).alias("_block"),
    )
    bounds = edges.withColumn("_cell", F.col("_block") * per_block)
    second = round_seconds(time)
    first = second if alignment == "forward" else second - reach
    rows = starts.select(
        *keys, first.alias("_first"), block_of(first, window).alias("_cell"),
        F.struct(*[F.col(c) for c in starts.columns]).alias("_row"),
    ).withColumn("_block", block_of("_cell", per_block))
    stacked = rows.unionByName(cells, allowMissingColumns=True).unionByName(bounds, allowMissingColumns=True)

    home = Window.partitionBy(*keys, "_block").orderBy("_cell")
    whole = home.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.array(*[F.lit(None).cast("double")] * len(places))
    picked = stacked.select(
        "_row", "_first", "_cell", F.max("_lo").over(whole).alias("_from"), F.max("_hi").over(whole).alias("_to"),
        F.first("_values", True).over(home.rangeBetween(0, 0)).alias("_here"),
        F.first("_values", True).over(home.rangeBetween(1, 1)).alias("_next"),
    ).where(F.col("_row").isNotNull())
    inside = (F.col("_first") >= F.col("_from")) & (F.col("_first") + reach <= F.col("_to"))
    skipped = (F.col("_first") - F.col("_cell") * window).cast("int") * len(names)
    both = F.concat(F.coalesce("_here", none), F.coalesce("_next", none))
    slices = picked.select("_row", F.when(inside, F.slice(both, skipped + 1, len(places))).alias("_slice"))
    out = [
        F.get("_slice", F.lit((reach - k) * len(names) + i)).alias(f"{c}_t-{k}")
        for i, c in enumerate(names) for k in range(reach, -1, -1)
    ]
    return slices.select("_row.*", *out)
