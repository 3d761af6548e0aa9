"""Features and decisions on a stream of samples.

The batch smoothing is centred and needs later samples; on a stream the average trails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.schema import FEATURE_PREFIX, FINAL_THRESHOLD, FINAL_WIDTH, KEYS, LABEL, STEP, WINDOW


def live_features(
    samples: DataFrame, ts: str = "ts", window: int = WINDOW, step: int = STEP, late: str = "30 seconds",
    channels: dict[str, str] = FEATURE_PREFIX, keys: list[str] = KEYS,
) -> DataFrame:
    """Window features of a 1 Hz sample stream, emitted once a window is complete.

    Equal to the batch features where recordings have one sample per second and start on a
    multiple of the stride. State is one row per open window and recording.
    """
    def ends(c: str) -> Column:
        # struct wrapping keeps a null first or last value instead of skipping it
        return (F.max_by(F.struct(c), ts)[c] - F.min_by(F.struct(c), ts)[c])

    aggs = [F.count(F.lit(1)).alias("_n"), F.max(ts).alias("time"), F.max(LABEL).alias(LABEL)]
    for i, (c, p) in enumerate(channels.items()):
        aggs += [F.avg(c).alias(f"{p}_mean"), F.stddev_pop(c).alias(f"{p}_std"), ends(c).alias(f"Delta{p}")]
        if i == 0:
            aggs.append((F.max(c) - F.min(c)).alias(f"{p}_range"))
    first, second = list(channels.values())[:2]
    return (
        samples.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, f"{window} seconds", f"{step} seconds"))
        .agg(*aggs)
        .where(F.col("_n") == window)
        .withColumn(f"Ratio_D{first}_D{second}", F.try_divide(f"Delta{first}", f"Delta{second}"))
        .drop("_n", "window")
    )


class Decider(StatefulProcessor):
    """Of one recording: the rows that wait for the watermark, and the last scores it has passed.

    What arrives is appended to a list, not written anew with all that waits. A timer wakes the recording when the watermark
    reaches the earliest row that waits; another, long after the last decision, forgets it.
    """

    def __init__(self, keys: list[str], ts: str, width: int, threshold: float, idle_ms: int):
        self.keys, self.ts, self.width, self.threshold, self.idle_ms = keys, ts, width, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "idx bigint, score double, at bigint")
        self.tail = handle.getListState("tail", "score double")
        self.idle = handle.getValueState("idle", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, least = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            at = (frame[self.ts].astype("datetime64[us]").astype("int64") // 1000).tolist()
            self.waiting.appendList(list(zip(frame["idx"].tolist(), frame["score"].astype(float).tolist(), at)))
            least = min(at) if least is None else min(least, *at)
        if least is not None:
            self.handle.registerTimer(max(least, mark + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in held if r[2] <= mark], [r for r in held if r[2] > mark]
        if rest:
            if ready:
                self.waiting.put(rest)
            self.handle.registerTimer(max(min(r[2] for r in rest), mark + 1))
        elif ready:
            self.waiting.clear()
        if ready:
            yield self._decided(key, ready)
            if self.idle.exists():
                self.handle.deleteTimer(self.idle.get()[0])
            self.idle.update((mark + self.idle_ms,))
            self.handle.registerTimer(mark + self.idle_ms)
        elif not rest and self.idle.exists() and self.idle.get()[0] <= mark:  # nothing for long
            self.tail.clear()
            self.idle.clear()

    def _decided(self, key: tuple, ready: list[tuple]) -> pd.DataFrame:
        tail = [r[0] for r in self.tail.get()] if self.tail.exists() else []
        line = np.array([0.0] * (self.width - 1 - len(tail)) + tail + [r[1] for r in ready])
        power = np.lib.stride_tricks.sliding_window_view(line, self.width).sum(axis=1) / self.width
        if self.width > 1:
            self.tail.put([(float(x),) for x in line[len(line) - (self.width - 1):]])
        done = pd.DataFrame({"idx": [r[0] for r in ready], "score": [r[1] for r in ready], "pred": (power >= self.threshold).astype("int32")})
        for name, value in reversed(list(zip(self.keys, key))):
            done.insert(0, name, value)
        return done

    def close(self) -> None:
        pass


def live_decisions(
    scored: DataFrame, width: int = FINAL_WIDTH, threshold: float = FINAL_THRESHOLD, keys: list[str] = KEYS,
    ts: str = "ts", late: str = "30 seconds", idle_s: int = 3600,
) -> DataFrame:
    """Trailing firing power of a score stream (`idx`, `score`, event time `ts`): `pred` = 1 where the
    sum of the last `width` scores / width reaches the threshold.

    Rows wait until the watermark passes them and are then taken in order of `idx`, so a row that is
    at most `late` behind counts where it belongs; what comes later is dropped. State is the rows that
    wait and `width - 1` scores per recording; it is forgotten `idle_s` after a recording's last decision. The session needs
    the RocksDB state store (`build_session` sets it).
    """
    types = dict(scored.dtypes)
    out = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "idx bigint", "score double", "pred int"])
    return scored.withWatermark(ts, late).groupBy(*keys).transformWithStateInPandas(
        Decider(keys, ts, width, threshold, 1000 * idle_s), out, "Append", "EventTime",
    )
