"""Event streams: windows by event time, and the previous-row idiom with state.

Beyond what runs in batch: the same operators over ``readStream`` sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(df: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding event-time windows; rows later than ``late`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return df.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    w = F.session_window(at, gap)
    return df.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def previous(df: DataFrame, key: str, at: str, value: str, key_type: str = "long", value_type: str = "double") -> DataFrame:
    """Each row with the value of its key's row before, kept in state; rows of a batch go by time."""
    out = f"{key} {key_type}, {at} timestamp, {value} {value_type}, previous {value_type}"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        before = state.get[0] if state.exists else None
        rows["previous"] = rows[value].shift(1)
        rows.iloc[0, rows.columns.get_loc("previous")] = before
        state.update((float(rows[value].iloc[-1]),))
        yield rows[[key, at, value, "previous"]]

    return df.select(key, F.col(at).cast("timestamp").alias(at), value).groupBy(key).applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.NoTimeout)


def bucket(at: Column, width: str) -> Column:
    """The start of the tumbling window, for batch frames."""
    return F.window(at, width)["start"]
