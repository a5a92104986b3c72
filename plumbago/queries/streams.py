"""Streams run to their end over the events table, then read as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.runtime import scratch
from plumbago.streaming import events as S

from .registry import query, read


def _drain(stream, spark, name, mode):
    path = scratch(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(path)

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/{batch}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return spark.read.parquet(f"{path}/{last}")


def _events(spark, sf):
    folder = scratch(spark, "events-in")
    table = read(spark, sf, "events")
    table.repartitionByRange(2, "event_id").write.parquet(folder)
    return S.read_events(spark, folder, table.schema)


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY start, event_type")
def windowed(spark, sf):
    out = _drain(S.windowed_counts(_events(spark, sf)), spark, "counts", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_bigrams", "WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b")
def bigrams(spark, sf):
    out = _drain(S.running_bigrams(_events(spark, sf)), spark, "bigrams", "append")
    return out.groupBy("a", "b").agg(F.count("*").alias("n"))
