"""Streaming operators over event logs: keyed session state, state changes, windows, upserts, caches with a lifetime.

State is bounded by watermarks and timeouts: a session leaves the state when it has been idle for the gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
CHANGES = "user_id long, event_id long, before string, after string, ts timestamp"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet event files; times are taken as UTC."""
    rows = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def session_windows(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, events): sessions that are idle for the gap are closed and sent out once."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("w.start").alias("started"), "event_type", "n", "mean")


def state_changes(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """A row for each event whose type differs from the user's last; a user's state is dropped after the idle time."""
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for batch in batches:
            out = []
            for row in batch.sort_values(["ts", "event_id"]).itertuples():
                if row.event_type != last:
                    out.append((key[0], row.event_id, last, row.event_type, row.ts))
                last = row.event_type
            yield pd.DataFrame(out, columns=["user_id", "event_id", "before", "after", "ts"])
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + seconds)

    marked = events.withWatermark("ts", idle)
    return marked.groupBy("user_id").applyInPandasWithState(step, CHANGES, "last string", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps, for each key, the row of the highest version; a repeated batch changes nothing.

    The table is written beside the old one and named by the batch, so readers never see half of it.
    """
    from pathlib import Path  # noqa: PLC0415

    def write(batch: DataFrame, number: int) -> None:
        done = sorted(Path(path).glob("v*")) if Path(path).exists() else []
        rows = batch if not done else batch.unionByName(batch.sparkSession.read.parquet(str(done[-1])))
        w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
        rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/v{number + 1:012d}")

    return write


def predict(recent: DataFrame, links: DataFrame, k: int = 20) -> DataFrame:
    """(user_id, item, score): items linked to a user's recent items, confidences added up, the best k of each user.

    `recent` is (user_id, item, confidence), `links` the static table (item, other, weight).
    """
    found = recent.join(links, "item").groupBy("user_id", F.col("other").alias("item")).agg(F.sum(F.col("confidence") * F.col("weight")).alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fresh(cache: DataFrame, as_of: str, seconds: int = 300) -> DataFrame:
    """Cached rows that haven't outlived their time."""
    return cache.where(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("cached_at") <= seconds)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there; its rows are files beside the checkpoint, so none of them passes through the driver.

    Files can only be appended to: other modes, which send an aggregate again and again, go to a table in memory and are for small reports.
    """
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        writer.format("memory").start().awaitTermination()
        return stream.sparkSession.table(name)
    rows = f"{checkpoint}-rows"
    writer.format("parquet").start(rows).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
