"""Log analytics on streams: windowed counts, sessions, and stalls with state.

Batch operators state the results; on the same rows a stream ends with the same ones. State is bounded by watermarks,
and for stalls it is one line, a run length and a flag for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
#: Milliseconds of event time without a row after which the state of a key is dropped.
IDLE_MS = 24 * 60 * 60 * 1000


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The files called events.parquet below a folder, as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no longer pause than `gap`."""
    return stream.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stalls(stream: DataFrame, threshold: int = 5) -> DataFrame:
    """The first row of each key (doc, ts, seq, line) at which an equal line has come `threshold` times in a row.

    Rows are taken batch by batch, in the order of time and number within a batch; a row that comes later than its place counts
    where it arrives, and one later than LATE not at all. A key without a row for IDLE_MS of event time is forgotten, and begins
    anew.
    """

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        line, length, told = state.get if state.exists else ("", 0, False)
        found = []
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for seq, text in zip(rows["seq"], rows["line"]):
            text = text.strip()
            if not text:
                continue
            length = length + 1 if text == line else 1
            line = text
            if length >= threshold and not told:
                told = True
                found.append((key[0], seq, text))
        state.update((line, length, told))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + IDLE_MS)
        yield pd.DataFrame(found, columns=["doc", "seq", "line"])

    return stream.withWatermark("ts", LATE).groupBy("doc").applyInPandasWithState(run, "doc long, seq long, line string", "line string, length int, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def drain(result: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over what is there now, each micro-batch written below `path` (the last one alone in complete mode), and read that."""
    spark = result.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/rows").select(*result.columns)
