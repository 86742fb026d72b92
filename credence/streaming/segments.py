"""Running segments and fused evidence over a stream of observations.

An extension: the batch operators ``segments`` and ``dempster_series_fusion`` over ``readStream``. The
state of a series is its last value, its segment and the sums of log commonalities, whatever its length.
Observations of one series must come in order of time across batches; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series_id long, observation_id long, ts timestamp, value double, segment long"
STATE = "last double, segment long"


def running_segments(observations: DataFrame, jump: float) -> DataFrame:
    """Each observation with the running number of jumps in its series."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, segment = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "observation_id"])
        out = []
        for r in rows.itertuples():
            if last is not None and not pd.isna(r.value) and abs(r.value - last) > jump:
                segment += 1
            last = None if pd.isna(r.value) else float(r.value)
            out.append(segment)
        state.update((last, segment))
        yield pd.DataFrame({"series_id": key[0], "observation_id": rows["observation_id"], "ts": rows["ts"], "value": rows["value"], "segment": out})

    slim = observations.select(F.col("series_id").cast("long").alias("series_id"), F.col("observation_id").cast("long").alias("observation_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return slim.groupBy("series_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(observations: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Observations and mean value of each wave form in tumbling windows; later ones than ``late`` are left out."""
    return (
        observations.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", window), "waveform").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    )
