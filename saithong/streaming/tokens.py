"""Text operators on streams: native functions need no change; here are counts of tokens in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, tokens: str, time: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, token, n): how often each token occurs in each window; rows later than `late` behind the newest are dropped. time may be a timestamp without zone: it's taken in the session's."""
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.col(tokens).alias("tokens")).withWatermark("t", late)
    each = rows.select("t", F.explode("tokens").alias("token"))
    return each.groupBy(F.window("t", window).alias("w"), "token").agg(F.count("*").alias("n")).select("w.start", "w.end", "token", "n")


def sessions(stream: DataFrame, key: str, time: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): a key's rows that follow each other within `gap`, as sessions of event time; rows later than `late` are dropped."""
    rows = stream.select(key, F.col(time).cast("timestamp").alias("t")).withWatermark("t", late)
    return rows.groupBy(F.session_window("t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def first_of_each(stream: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The stream without rows whose keys were seen within `late`."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])


def run_to_end(result: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that its source has now, to a table in a folder that driver and executors share, and reads it: for backfills and tests. In complete mode each batch replaces the table, in append mode it adds to it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" or number == 0 else "append").parquet(f"{folder}/rows")

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/rows")
