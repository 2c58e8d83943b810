"""Observation streams: daily gains under a watermark, and the change-only filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def daily_gain(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows and summed value of each key and day; a batch frame works as well."""
    day = F.window("ts", "1 day")
    g = stream.withWatermark("ts", late).groupBy(day, "key").agg(F.count("*").alias("n"), F.sum("value").alias("gained"))
    return g.select(F.col("window.start").cast("date").alias("day"), "key", "n", "gained")


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # a call a key: plain arrays, as frames cost more than the few rows in them
    chunks = [[f[c].to_numpy() for c in ("key", "ts", "value")] for f in frames]  # all chunks of the key in this batch
    keys, ts, values = (np.concatenate(c) for c in zip(*chunks, strict=True)) if chunks else ([], [], [])
    if len(keys):
        order = np.lexsort((values, ts))
        now = values[order]
        before = np.append(state.get[0] if state.exists else np.nan, now[:-1])
        kept = order[np.isnan(before) | (now != before)]
        state.update((float(now[-1]),))
        yield pd.DataFrame({"key": keys[kept], "ts": ts[kept], "value": values[kept]}, copy=False)


def changes(stream: DataFrame) -> DataFrame:
    """Observations (key, ts, value) that differ from the key's last one, in order of time within a batch."""
    return stream.groupBy("key").applyInPandasWithState(
        _changed, "key long, ts timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout
    )


def run_files(spark: SparkSession, folder: str, schema: StructType, work: str, shape: Callable[[DataFrame], DataFrame], mode: str = "append") -> list[dict]:
    """Read the files of ``folder`` that no earlier call has, one a batch, and append what ``shape`` makes of them to ``work``.

    Offsets, state and the list of written files lie in ``work``, so a call after a stop, planned or not, goes on where the
    last finished batch ended. Returns the progress of each batch.
    """
    stream = shape(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/state")
    started = out.trigger(availableNow=True).start()
    started.awaitTermination()
    return list(started.recentProgress)


def dropped(progress: list[dict]) -> int:
    """Rows that came behind the watermark and were left out."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])
