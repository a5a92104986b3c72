"""Event streams: the same counts as the batch operators, with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream, with a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, value): counts and sums by time window and type; rows later than the watermark are left out."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_bigrams(events: DataFrame) -> DataFrame:
    """(user_id, a, b): pairs of consecutive events of a user across batches; the state is the user's last type.

    Within a batch a user's events are taken in order of time and id.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        kinds = rows["event_type"].tolist()
        before = [last, *kinds[:-1]]
        state.update((kinds[-1],))
        out = [(key[0], a, b) for a, b in zip(before, kinds) if a is not None]
        yield pd.DataFrame(out, columns=["user_id", "a", "b"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, a string, b string", "last string", "append", GroupStateTimeout.NoTimeout)
