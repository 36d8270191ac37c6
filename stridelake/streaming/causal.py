"""Causal operators over streams of samples: what needs no later frame. These go beyond batch recordings.

``windowed_stats`` is a watermarked aggregation; ``stream_velocity`` keeps the last sample of each key
as state, so that a difference crosses micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(samples: DataFrame, key: str, time: str, value: str, width: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Statistics of a value for each key and time window; samples later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    stats = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")]
    return samples.withWatermark(time, late).groupBy(w, key).agg(*stats).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std", "least", "most")


def sessions(samples: DataFrame, key: str, time: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Bouts of activity of each key: sessions that end after a gap."""
    return samples.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_velocity(samples: DataFrame, key: str, time: str, value: str, late: str = "10 minutes", forget_ms: int = 3_600_000) -> DataFrame:
    """(key, time, value, velocity): the backward difference per second; null at a key's first sample.

    Within a micro-batch samples are put in order of time; one that is not later than the one before
    is passed on without a velocity and does not change the state. Samples later than ``late`` are
    dropped. A key's state goes when the watermark is ``forget_ms`` past its last sample.
    """
    kind = dict(samples.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        for rows in batches:  # a part of a key's samples at a time
            rows = rows.sort_values("time", kind="stable")
            t = rows["time"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
            v = rows["value"].to_numpy(float)
            # the sample before: the last one with the latest time so far
            so_far = np.maximum.accumulate(np.concatenate([[last[0] if last else -np.inf], t]))
            moves = t > so_far[:-1]
            times = np.concatenate([[last[0] if last else np.nan], t[moves]])
            values = np.concatenate([[last[1] if last else np.nan], v[moves]])
            velocity = np.full(len(t), np.nan)
            velocity[moves] = np.diff(values) / np.diff(times)
            if moves.any():
                last = (float(times[-1]), float(values[-1]))
            out = pd.DataFrame({"key": [k[0]] * len(t), "time": rows["time"].to_numpy(), "value": v, "velocity": pd.array(velocity, dtype="Float64")})
            out["velocity"] = out["velocity"].astype(object).where(~np.isnan(velocity), None)
            yield out
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(int(last[0] * 1000), state.getCurrentWatermarkMs()) + forget_ms)

    source = samples.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(value).cast("double").alias("value")).withWatermark("time", late)
    return source.groupBy("key").applyInPandasWithState(step, f"key {kind}, time timestamp, value double, velocity double", "t double, v double", "append", GroupStateTimeout.EventTimeTimeout)
