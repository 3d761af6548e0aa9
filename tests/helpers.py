from __future__ import annotations

import numpy as np
import pandas as pd

from pulsegrid.schema import CHANNELS


def random_signal(records=3, n=120, seed=1, gaps=True) -> pd.DataFrame:
    """Integer seconds with gaps, nulls and a label."""
    rng = np.random.default_rng(seed)
    frames = []
    for r in range(records):
        t = np.sort(rng.choice(n * 2 if gaps else n, n, replace=False)).astype(float)
        df = pd.DataFrame({"grp": f"P{r % 2}", "record": f"R{r}", "time_elapsed": t})
        for c in CHANNELS:
            v = rng.integers(0, 50, n).astype(float)
            v[rng.random(n) < 0.3] = np.nan
            df[c] = v
        df["label"] = (rng.random(n) < 0.2).astype(int)
        frames.append(df)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame, schema: str | None = None):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]
    if schema is None:
        kinds = {"f": "double", "i": "bigint", "O": "string", "U": "string"}
        schema = ", ".join(f"`{c}` {kinds.get(t.kind, 'string')}" for c, t in pdf.dtypes.items())
    return spark.createDataFrame(rows, schema).repartition(5)


def as_set(df, digits=6):
    def norm(v):
        if isinstance(v, float):
            return None if np.isnan(v) else round(v, digits) + 0.0
        return v

    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
