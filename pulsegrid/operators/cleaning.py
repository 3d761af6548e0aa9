"""Canonical recordings: column mapping, numbers, clock, row filters, duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import (
    any_present, clean_float, epoch_to_seconds, nan_to_null, ticks_to_seconds, token_to_null,
)
from pulsegrid.operators.blocks import BLOCK, attach_record_stats, block_of, time_block
from pulsegrid.schema import CHANNELS, HEADER_PATTERNS, KEYS, LABEL, TIME


def canonical_names(headers: list[str]) -> dict[str, str]:
    """Header -> canonical name. Per name the longest match wins, the first header on a tie; a
    header claimed by two names keeps the later one. The first header is the clock and stays."""
    chosen: dict[str, str] = {}
    for name, pattern in HEADER_PATTERNS.items():
        found = [(h, re.search(pattern, h.lower(), re.I)) for h in headers]
        lengths = {h: len(m.group(0)) for h, m in found if m}
        if lengths:
            chosen[max(lengths, key=lengths.get)] = name
    chosen.pop(headers[0], None)
    return chosen


def canonicalise(raw: DataFrame) -> DataFrame:
    """Text columns `ticks` and the four channels -> numbers; cells that do not parse are null."""
    channels = [nan_to_null(clean_float(token_to_null(c))).alias(c) for c in CHANNELS]
    return raw.select(*KEYS, "file_pos", token_to_null("ticks").try_cast("double").alias("ticks"), *channels)


def elapsed_from_ticks(
    df: DataFrame, ticks: str = "ticks", pos: str = "file_pos", keys: list[str] = KEYS, size: int = BLOCK
) -> DataFrame:
    """Seconds since the record's first non-null tick in file order; records without any tick
    drop out."""
    blocked = df.withColumn("_block", block_of(pos, size))
    at = F.when(F.col(ticks).isNotNull(), F.col(pos))
    out = attach_record_stats(
        blocked, keys, "_block", {"_t": F.min_by(ticks, at), "_p": F.min(at)},
        lambda whole, ordered: {"_t0": F.min_by("_t", "_p").over(whole)},
    )
    return (
        out.where(F.col("_t0").isNotNull())
        .withColumn(TIME, ticks_to_seconds(ticks, "_t0"))
        .drop("_block", "_t0")
    )


def any_core_filter(df: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    return df.where(any_present(*channels))


def time_unit_repair(df: DataFrame, keys: list[str] = KEYS, size: int = BLOCK) -> DataFrame:
    """Pick the clock column (`sec`, then `time_elapsed`, then `time`) and give `time` in seconds.

    Only a bare `time` may be an epoch: units are repaired and values still beyond 1e7 are taken
    relative to the record's earliest one.
    """
    for name in ("sec", TIME):
        if name in df.columns:
            return df.withColumn("time", F.col(name).try_cast("double"))
    if "time" not in df.columns:
        raise ValueError("no time column: expected sec, time_elapsed or time")
    scaled = df.withColumn("time", epoch_to_seconds(F.col("time").try_cast("double")))
    blocked = scaled.withColumn("_block", time_block("time", size))
    out = attach_record_stats(
        blocked, keys, "_block", {"_lo": F.min("time")},
        lambda whole, ordered: {"_t0": F.min("_lo").over(whole)},
    )
    t = F.col("time")
    return out.withColumn("time", F.when(t > 1e7, t - F.col("_t0")).otherwise(t)).drop("_block", "_t0")


def schema_fill(df: DataFrame, channels: list[str] = CHANNELS, strict_time: bool = True) -> DataFrame:
    """Absent channels become null, an absent label becomes 0, extra columns go; columns sorted."""
    if strict_time and TIME not in df.columns:
        raise ValueError(f"missing column {TIME}")
    present = set(df.columns)
    cols = {c: (F.col(c) if c in present else F.lit(None)).cast("double") for c in channels}
    cols[LABEL] = (F.col(LABEL) if LABEL in present else F.lit(0)).cast("tinyint")
    cols[TIME] = F.col(TIME).cast("double")
    kept = [k for k in KEYS if k in present]
    return df.select(*kept, *[cols[c].alias(c) for c in sorted(cols)])


def column_difference(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    have = set(df.columns)
    return sorted(set(expected) - have), sorted(have - set(expected))


def dedup_last(df: DataFrame, by: list[str], order: str, ties: bool = False) -> DataFrame:
    """One row per `by`: the one with the highest `order`.

    max_by over primitive buffers aggregates on the map side, so a key with many copies is
    reduced before the shuffle. Where rows of a key can share an `order`, `ties` lets the larger
    values win, column by column; without it any of them may stay.
    """
    rest = [c for c in df.columns if c not in by]
    if ties:
        best = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_best")
        return df.groupBy(*by).agg(best).select(*by, "_best.*").select(df.columns)
    return df.groupBy(*by).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(df.columns)


def incremental_todo(records: DataFrame, done: DataFrame, keys: list[str] = KEYS, force: bool = False) -> DataFrame:
    """Records that still have to be processed.

    When both sides carry `mtime`, a record whose input is at least as new as its output counts
    as not done.
    """
    if force:
        return records
    if "mtime" in records.columns and "mtime" in done.columns:
        made = done.select(*keys, F.col("mtime").alias("_made"))
        cond = [records[k] == made[k] for k in keys] + [made["_made"] > records["mtime"]]
        return records.join(made, cond, "left_anti")
    return records.join(done.select(*keys), keys, "left_anti")
