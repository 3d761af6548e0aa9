"""Annotations and sample labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import (
    annotation_key, clipped, lenient_int, mentions, round_seconds, strict_int,
)
from pulsegrid.operators.blocks import BLOCK, attach_record_stats, block_of
from pulsegrid.schema import ABSOLUTE_SHARE, EVENT_TYPE, KEYS, LABEL, TIME

# Length of the time cells that interval joins are keyed by, in seconds.
CELL_S = 600


def event_type_filter(ann: DataFrame, event_type: str = EVENT_TYPE) -> DataFrame:
    return ann.where(mentions("description", event_type))


def annotation_clean(ann: DataFrame, strict: bool = True) -> DataFrame:
    """Whole-second onset, duration and generalization.

    strict: junk in onset or duration fails the job (labels must not be built on it);
    otherwise rows without a usable onset go. A missing generalization is 0.
    """
    if strict:
        out = ann.withColumn("onset", strict_int("onset")).withColumn("duration", strict_int("duration"))
    else:
        out = (
            ann.withColumn("onset", lenient_int("onset"))
            .withColumn("duration", lenient_int("duration"))
            .where(F.col("onset").isNotNull())
        )
    gen = lenient_int("generalization") if "generalization" in ann.columns else F.lit(None).cast("int")
    return out.withColumn("generalization", F.coalesce(gen, F.lit(0)))


def record_annotations(
    records: DataFrame, ann: DataFrame, stem: str = "record", rule: str = "parity"
) -> DataFrame:
    """Records with their annotations (none -> nulls).

    The annotation key is its file stem up to the first underscore. rule="parity" looks it up by
    the whole record name without `_1Hz`; rule="prefix" cuts the record name at its first
    underscore as well, so names with underscores find their annotations.
    """
    key = F.replace(F.col(stem), F.lit("_1Hz"), F.lit(""))
    if rule == "prefix":
        key = annotation_key(key)
    notes = ann.withColumn("_key", annotation_key("ann_key"))
    return records.withColumn("_key", key).join(notes, "_key", "left").drop("_key")


def _keys_of(df: DataFrame, other: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns and k in other.columns]


def interval_label(
    samples: DataFrame,
    ann: DataFrame,
    event_type: str | None = EVENT_TYPE,
    time: str | None = None,
    cell: int = CELL_S,
) -> DataFrame:
    """label = 1 iff some event with a positive duration has onset <= second < onset + duration.

    Events are cut at cell borders and gathered per (record, cell), so a sample meets at most one
    row and the join key spreads a long record over all its cells. Inside a cell, spans that touch or
    overlap are merged by a running maximum of their ends; what is left are at most half as many spans as the cell has
    seconds, in order, and a sample finds its own by bisection.
    """
    on = _keys_of(samples, ann)
    second = F.col("sec").cast("bigint") if time is None and "sec" in samples.columns else round_seconds(time or TIME)
    events = ann.where(F.col("duration") > 0)
    if event_type is not None:
        events = event_type_filter(events, event_type)
    start = F.col("onset").cast("bigint")
    stop = start + F.col("duration")
    cells = (
        events.select(
            *on, start.alias("_a"), stop.alias("_b"),
            F.explode(F.sequence(block_of(start, cell), block_of(stop - 1, cell))).alias("_cell"),
        )
        .select(
            *on, "_cell",
            F.struct(
                F.greatest("_a", F.col("_cell") * cell).alias("a"),
                F.least("_b", (F.col("_cell") + 1) * cell).alias("b"),
            ).alias("_span"),
        )
        .select(*on, "_cell", "_span.*").distinct()
    )
    before = Window.partitionBy(*on, "_cell").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int")
    merged = (
        cells.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(upto))
        .groupBy(*on, "_cell", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .groupBy(*on, "_cell").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_spans"))
    )
    # the last span that begins at or before the second, by halving steps; at most (cell + 1) / 2 spans
    steps = [1 << k for k in reversed(range(((cell + 1) // 2).bit_length()))]
    begins = lambda at: F.try_element_at(F.col("_spans"), at)["a"]
    place = F.aggregate(
        F.array(*[F.lit(k) for k in steps]), F.lit(0),
        lambda at, k: F.when(begins(at + k) <= F.col("_sec"), at + k).otherwise(at),
    )
    found = F.try_element_at(F.col("_spans"), F.nullif(place, F.lit(0)))
    hit = (F.col("_sec") < found["b"])
    return (
        samples.drop(LABEL)
        .withColumn("_sec", second)
        .withColumn("_cell", block_of("_sec", cell))
        .join(merged, [*on, "_cell"], "left")
        .withColumn(LABEL, F.coalesce(hit, F.lit(False)).cast("tinyint"))
        .drop("_sec", "_cell", "_spans")
    )


def generalization_offset(ann: DataFrame, size: int = BLOCK) -> DataFrame:
    """`gen_offset` in seconds after onset.

    A record in which more than 80 % of the values are not before their onset holds absolute
    times, which are turned into offsets (not below 0).
    """
    keys = [k for k in KEYS if k in ann.columns]
    onset, gen = F.col("onset"), F.coalesce(F.col("generalization"), F.lit(0))
    blocked = ann.withColumn("_block", block_of("onset", size))
    out = attach_record_stats(
        blocked, keys, "_block",
        {"_abs": F.sum((gen >= onset).cast("bigint")), "_n": F.count(F.lit(1))},
        lambda whole, ordered: {"_share": F.sum("_abs").over(whole) / F.sum("_n").over(whole)},
    )
    offset = F.when(F.col("_share") > ABSOLUTE_SHARE, clipped(gen - onset)).otherwise(gen)
    return out.withColumn("gen_offset", offset.cast("int")).drop("_block", "_share")
