"""Assembling the training table: union, alignment, null diagnostics, imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators.blocks import BLOCK, attach_record_stats, global_rank, join_spread, time_block
from pulsegrid.operators.grid import context_names, context_windows
from pulsegrid.schema import (
    ANCHOR, CHANNELS, DROP_PREFIXES, KEYS, LABEL, MAX_NULL_SHARE, WINDOW,
)


def diag_union(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_records(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def raw_semi(
    raw: DataFrame, features: DataFrame, along: str = "sec", keys: list[str] = KEYS, strict: bool = False
) -> DataFrame:
    """Raw rows of the records that have features.

    Distinct records meet the raw rows through their time blocks; `strict` fails when nothing is
    shared.
    """
    out = join_spread(raw, distinct_records(features, keys), keys, along, keys, "left_semi")
    if strict and out.isEmpty():
        raise RuntimeError("features and raw recordings share no record")
    return out


def key_intersect(*frames: DataFrame, keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [f.select(*keys) for f in frames])


def record_anchor(df: DataFrame, time: str = "time") -> DataFrame:
    """`anchor`: an artificial date per record (in record order); `time_dt`: anchor plus seconds.

    Ranks are worked out over distinct records by range partitioning and spread back through the
    record's time blocks, so neither step sees one record as one task.
    """
    ranks = global_rank(df, "record", "_rank")
    base = F.lit(ANCHOR).cast("timestamp_ntz")
    secs = F.round(F.col(time), 6).cast("decimal(18,6)")
    placed = join_spread(df, ranks, ["record"], time, ["record"])
    dated = placed.withColumn("anchor", base + F.make_dt_interval(days=F.col("_rank").cast("int")))
    return dated.withColumn("time_dt", F.col("anchor") + F.make_dt_interval(secs=secs)).drop("_rank")


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows in a total order, for output only (a range-partitioned sort)."""
    return df.orderBy(*by)


def null_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column with its share of nulls, from a single pass."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])
    return unpivot_row(row, cols, "column", "null_share")


def unpivot_row(row: DataFrame, cols: list[str], name: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in cols]
    return row.select(F.explode(F.array(*pairs)).alias("_p")).select(f"_p.{name}", f"_p.{value}")


def columns_to_drop(
    shares: dict[str, float], threshold: float = MAX_NULL_SHARE, prefixes: list[str] = DROP_PREFIXES
) -> list[str]:
    too_empty = {c for c, s in shares.items() if s is not None and s > threshold}
    forced = {c for c in shares if c.startswith(tuple(prefixes))}
    return sorted(too_empty | forced)


def prune_columns(
    df: DataFrame, cols: list[str], threshold: float = MAX_NULL_SHARE,
    prefixes: list[str] = DROP_PREFIXES, measured_on: DataFrame | None = None,
) -> DataFrame:
    """Drop columns that are mostly null. `measured_on` may be the training rows only.

    The schema depends on the data, so this runs one aggregation; what reaches the driver is one
    number per column.
    """
    shares = {r["column"]: r["null_share"] for r in null_share(measured_on or df, cols).collect()}
    return df.drop(*columns_to_drop(shares, threshold, prefixes))


def null_report(df: DataFrame, feature_cols: list[str], raw_cols: list[str]) -> DataFrame:
    """Cells, null cells and their share for the raw block, the feature block and both."""
    def nulls(cols: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("bigint") for c in cols], F.lit(0))

    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(nulls(raw_cols)).alias("raw"),
        F.sum(nulls(feature_cols)).alias("features"),
    )
    parts = [
        F.struct(
            F.lit(name).alias("block"),
            (F.col("n") * width).cast("bigint").alias("cells"),
            count.cast("bigint").alias("null_cells"),
        )
        for name, width, count in [
            ("raw", len(raw_cols), F.col("raw")),
            ("features", len(feature_cols), F.col("features")),
            ("all", len(raw_cols) + len(feature_cols), F.col("raw") + F.col("features")),
        ]
    ]
    out = row.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    return out.withColumn(
        "null_pct", F.coalesce(F.try_divide(F.col("null_cells").cast("double"), F.col("cells").cast("double")), F.lit(0.0))
    )


def assemble(
    features: DataFrame,
    per_second: DataFrame | None,
    window: int = WINDOW,
    alignment: str = "trailing",
    channels: list[str] = CHANNELS,
    keys: list[str] = KEYS,
    prune: bool = True,
) -> DataFrame:
    """Features, label and group in one table, with the raw context columns if samples are given."""
    out = features if per_second is None else context_windows(features, per_second, window, alignment, channels, keys)
    if not prune:
        return out
    extra = [] if per_second is None else context_names(window, channels)
    held = {*keys, "time", "window", "idx", LABEL, "fold"}
    return prune_columns(out, [c for c in features.columns if c not in held] + extra)


def ffill_bfill(
    df: DataFrame, cols: list[str], time: str = "time", keys: list[str] = KEYS, size: int = BLOCK
) -> DataFrame:
    """Fill nulls with the record's previous value, leading nulls with its first one.

    Inside a block a running frame does it; across blocks the block table carries the last value
    seen before the block and the first value of the record. `time` is unique per record. Rows
    without a time have no place in it: they give no value and take the record's first one.
    """
    blocked = df.withColumn("_block", time_block(time, size))
    q = {c: F.col(f"`{c}`") for c in cols}
    partial = {}
    for i, c in enumerate(cols):
        seen = F.when(q[c].isNotNull(), F.col(time))
        partial[f"_l{i}"] = F.max_by(q[c], seen)
        partial[f"_f{i}"] = F.min_by(q[c], seen)

    def carried(whole, ordered):
        past = ordered.rowsBetween(Window.unboundedPreceding, -1)
        full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = {}
        for i in range(len(cols)):
            out[f"_p{i}"] = F.last(f"_l{i}", True).over(past)
            out[f"_r{i}"] = F.first(f"_f{i}", True).over(full)
        return out

    placed = attach_record_stats(blocked, keys, "_block", partial, carried)
    running = (
        Window.partitionBy(*keys, "_block").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = {
        c: F.when(F.col(time).isNull(), F.coalesce(q[c], F.col(f"_r{i}")))
        .otherwise(F.coalesce(F.last(q[c], True).over(running), F.col(f"_p{i}"), F.col(f"_r{i}")))
        for i, c in enumerate(cols)
    }
    return placed.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column of the training rows: two numbers per column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_pop(f"`{c}`").alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def mean_impute(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Nulls replaced by the training mean (a column without any value stays null)."""
    known = {c: m for c, (m, _) in stats.items() if m is not None}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in known.items()})


def zscore(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    known = {c: (m, s or 1.0) for c, (m, s) in stats.items() if m is not None}
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in known.items()})
