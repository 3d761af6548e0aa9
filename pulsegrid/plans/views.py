"""Signal-shaped views over the `events` table, for the registered queries and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.blocks import with_position
from pulsegrid.operators.features import window_features
from pulsegrid.operators.labeling import generalization_offset, interval_label
from pulsegrid.operators.smoothing import firing_power
from pulsegrid.operators.dataset import assemble
from pulsegrid.schema import CHANNELS, TIME

ORIGIN = "2024-01-01 00:00:00"
# Events of a user are placed through cells of this many seconds of wall-clock time.
PLACE_S = 512
FOLDS = [0, 1, 2]
WIDTH, LEVEL = 4, 0.45


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _since(unit: str, ts: str) -> F.Column:
    return F.timestamp_diff(unit, F.lit(ORIGIN).cast("timestamp_ntz"), F.col(ts))


def _channels() -> dict:
    e, u = F.col("event_id"), F.col("user_id")
    return {
        "heart_rate": F.when(e % 11 == 0, F.lit(None)).otherwise(F.col("value")),
        "breathing_rate": F.when(e % 7 == 0, F.lit(None)).otherwise(
            F.regexp_extract("props", "([0-9]+)", 1).cast("double")
        ),
        "activity": F.col("value") * 0.01,
        "cadence": F.when(u % 10 == 3, F.lit(None)).otherwise((e % 13).cast("double")),
    }


def _identity() -> list:
    u = F.col("user_id")
    return [
        F.concat(F.lit("P"), (u % 10).cast("string")).alias("grp"),
        F.concat(F.lit("R"), u.cast("string")).alias("record"),
    ]


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Dense signal: a user's n-th event is the sample at second n."""
    placed = with_position(
        events(spark, sf).withColumn("_cell", F.floor(_since("SECOND", "ts") / PLACE_S)),
        ["user_id"], ["ts", "event_id"], "_cell", "_pos",
    )
    ch = _channels()
    return placed.select(
        *_identity(), "event_id", F.col("_pos").alias("pos"), F.col("_pos").cast("double").alias(TIME),
        *[ch[c].alias(c) for c in CHANNELS], "event_type",
        F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit(" bpm")).alias("hr_text"),
    )


def annotations(sig: DataFrame) -> DataFrame:
    """Annotations with zero durations, mixed case, a second type and both kinds of
    generalization."""
    e, onset = F.col("event_id"), F.col(TIME).cast("int")
    absolute = F.substring("record", -1, 1) != "1"
    return sig.where((F.col("event_type") == "error") & (e % 3 == 0)).select(
        "grp", "record", e.alias("ann_pos"), onset.alias("onset"), (e % 9).cast("int").alias("duration"),
        F.when(e % 2 == 0, "Sz fbtcs").otherwise("FAS").alias("description"),
        F.when(absolute, onset + (e % 4).cast("int")).otherwise((e % 4).cast("int")).alias("generalization"),
    )


def scoring_annotations(ann: DataFrame) -> DataFrame:
    """The events of the scored type with generalization offsets."""
    return generalization_offset(ann.where(F.lower("description").contains("fbtcs"))).select(
        "grp", "record", "ann_pos", "onset", "gen_offset"
    )


def labeled(spark: SparkSession, sf: str, ann: DataFrame | None = None) -> DataFrame:
    """`ann` is the annotation table where the caller has it already."""
    sig = signal(spark, sf)
    return interval_label(sig, annotations(sig) if ann is None else ann)


def features(
    spark: SparkSession, sf: str, windows: list[int] | None = None, ann: DataFrame | None = None
) -> DataFrame:
    return window_features(labeled(spark, sf, ann), windows, pos="pos")


def scored(spark: SparkSession, sf: str, ann: DataFrame | None = None) -> DataFrame:
    """A stand-in for model scores: 15/5 windows with a score, their position and a fold."""
    feats = features(spark, sf, ann=ann)
    group = F.substring("grp", 2, 9).cast("int")
    score = F.round(F.least(F.lit(1.0), F.coalesce(F.col("HR_mean"), F.lit(0.0)) / 100), 6)
    return feats.select(
        (group % 3).alias("fold"), "grp", "record", "time", "idx",
        F.col("label").cast("int").alias("label"), score.alias("score"),
    )


def decided(spark: SparkSession, sf: str, ann: DataFrame | None = None) -> DataFrame:
    return firing_power(scored(spark, sf, ann), WIDTH, LEVEL)


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty strings and ticks over the dense signal; some ticks are missing."""
    e = F.col("event_id")
    return signal(spark, sf).select(
        "grp", "record", "event_id", "hr_text", F.col("pos").alias("file_pos"),
        F.when(e % 13 != 0, F.col(TIME) * 256 + 1000 + e % 2).alias("ticks"),
    )


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Signal with gaps and collisions: one second is one hour of wall-clock time."""
    e = F.col("event_id")
    return events(spark, sf).select(
        *_identity(), "event_id", _since("HOUR", "ts").cast("bigint").alias("sec"),
        F.when(e % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("heart_rate"),
        F.when(e % 7 == 0, F.lit(None)).otherwise((e % 17).cast("double")).alias("breathing_rate"),
    )


def dataset(spark: SparkSession, sf: str, alignment: str = "trailing", prune: bool = False) -> DataFrame:
    """Features, label, fold and raw context in one table."""
    lab = labeled(spark, sf)
    group = F.substring("grp", 2, 9).cast("int")
    feats = window_features(lab, pos="pos").withColumn("fold", group % 3)
    per_second = lab.select("grp", "record", F.col(TIME).cast("bigint").alias("sec"), *CHANNELS)
    return assemble(feats, per_second, alignment=alignment, prune=prune)
