"""Column expressions. All of them stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schema import EVENT_TYPE, NULL_TOKENS, TICKS_PER_SECOND


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN is turned into null once, at ingest; nothing downstream produces NaN again."""
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def token_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)


def clean_float(c: Column | str) -> Column:
    """Lenient number: decimal comma allowed, units dropped, anything unparsable is null."""
    text = F.regexp_replace(F.replace(_col(c), F.lit(","), F.lit(".")), r"[^0-9.+eE\-]", "")
    return text.try_cast("double")


def round_seconds(c: Column | str) -> Column:
    """Half-even rounding to whole seconds."""
    return F.rint(_col(c)).cast("bigint")


def ticks_to_seconds(ticks: Column | str, first: Column | str) -> Column:
    return (_col(ticks) - _col(first)) / F.lit(float(TICKS_PER_SECOND))


def any_present(*cols: Column | str) -> Column:
    return F.coalesce(*[_col(c) for c in cols]).isNotNull()


def mentions(c: Column | str, event_type: str = EVENT_TYPE) -> Column:
    """Case-insensitive substring test; null counts as no."""
    return F.contains(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(event_type.lower()))


def strict_int(c: Column | str) -> Column:
    """Truncating integer conversion that fails the job on junk and on missing values."""
    missing = F.raise_error(F.lit("missing number in annotation")).cast("int")
    return F.coalesce(_col(c).cast("double").cast("int"), missing)


def lenient_int(c: Column | str) -> Column:
    """Truncating integer conversion that gives null on junk."""
    return _col(c).try_cast("double").cast("int")


def plain_record(c: Column | str) -> Column:
    """Record name without the suffixes the processing stages append."""
    out = _col(c)
    for suffix in ("_1Hz", "_raw", "_features"):
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def annotation_key(stem: Column | str) -> Column:
    return F.substring_index(_col(stem), "_", 1)


def epoch_to_seconds(c: Column | str) -> Column:
    """Nanosecond and millisecond clocks brought down to seconds."""
    c = _col(c)
    return F.when(c > 1e14, c / 1e9).when(c > 1e11, c / 1e3).otherwise(c)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def clipped(c: Column) -> Column:
    """`max(0, c)` that keeps null (greatest alone would turn null into 0)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), c))
