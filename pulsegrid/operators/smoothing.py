"""Scores -> 0/1 decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators.blocks import BLOCK, with_halo
from pulsegrid.schema import KEYS, LABEL


def _smoothed(width: int, score: str, pos: str, keys: list[str]) -> Column:
    """Centred moving average, zero beyond the record: sum / width, one more row back than ahead
    for even widths."""
    if width <= 1:
        return F.col(score)
    back = width // 2
    frame = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-back, width - back - 1)
    return F.sum(score).over(frame) / F.lit(float(width))


def smooth_scores(
    scored: DataFrame, widths: list[int], score: str = "score", pos: str = "idx",
    keys: list[str] = KEYS, size: int = BLOCK,
) -> DataFrame:
    """Adds `smooth_<width>` per distinct width; all widths share one exchange and sort.

    `pos` counts 0, 1, 2, ... inside a record.
    """
    widest = max(widths)
    back = widest // 2
    spread = with_halo(scored, pos, before=max(0, widest - back - 1, back), after=back, size=size)
    cols = [_smoothed(w, score, pos, keys).alias(f"smooth_{w}") for w in sorted(set(widths))]
    return spread.select(*scored.columns, "_own", *cols).where("_own").drop("_own")


def firing_power(
    scored: DataFrame, width: int, threshold: float, score: str = "score", pos: str = "idx",
    keys: list[str] = KEYS, out: str = "pred", size: int = BLOCK,
) -> DataFrame:
    """`pred` = 1 where the smoothed score reaches the threshold."""
    smooth = smooth_scores(scored, [width], score, pos, keys, size)
    hit = (F.col(f"smooth_{width}") >= F.lit(threshold)).cast("int")
    return smooth.withColumn(out, hit).drop(f"smooth_{width}")


def threshold_sweep(
    scored: DataFrame, widths: list[int], thresholds: list[float], by: list[str],
    score: str = "score", pos: str = "idx", keys: list[str] = KEYS, size: int = BLOCK,
) -> DataFrame:
    """Confusion counts for every (width, threshold) per `by`, from one smoothing pass.

    Each scored row is looked at once per parameter pair and aggregated on the map side, so the
    model is not refitted for parameters that only act after scoring.
    """
    smooth = smooth_scores(scored, widths, score, pos, keys, size)
    choices = [
        F.struct(
            F.lit(w).alias("width"), F.lit(float(t)).alias("threshold"),
            (F.col(f"smooth_{w}") >= F.lit(float(t))).cast("int").alias("pred"),
        )
        for w in sorted(set(widths)) for t in thresholds
    ]
    rows = smooth.select(*by, LABEL, F.explode(F.array(*choices)).alias("_c")).select(*by, LABEL, "_c.*")
    return rows.groupBy(*by, "width", "threshold").agg(*confusion())


def confusion(label: str = LABEL, pred: str = "pred") -> list[Column]:
    def n(y: int, p: int) -> Column:
        return F.sum(((F.col(label) == y) & (F.col(pred) == p)).cast("bigint"))

    return [n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn")]
