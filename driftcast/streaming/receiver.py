"""The receiver: a keyed store that a new session clears, as streaming state and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a receiver emits: its session, how many units it holds, the last packet it took.
OUTPUT = "epoch long, session int, units long, last_seq long"


def sessions(frames: DataFrame) -> DataFrame:
    """frames with the session that each packet names: 0 for an empty frame, else 1 to 3."""
    return frames.withColumn("session", F.when(F.col("zero"), 0).otherwise(1 + F.col("k") % 3))


def final_state(frames: DataFrame) -> DataFrame:
    """Batch twin: the state of every receiver (epoch) after all frames in order of time_ms, seq."""
    order = Window.partitionBy("epoch").orderBy("time_ms", "seq")
    rows = sessions(frames).filter("session <> 0")
    new = F.when(F.col("session") != F.lag("session", 1, 0).over(order), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("part", F.sum("new").over(order))
    rows = rows.withColumn("last_part", F.max("part").over(Window.partitionBy("epoch"))).filter("part = last_part")
    return rows.groupBy("epoch").agg(F.max("session").alias("session"), F.count_distinct("k").alias("units"), F.max("seq").alias("last_seq"))


class Receiver(StatefulProcessor):
    """Session and units of one receiver; frames of a batch are taken in order of time.

    Frames that arrive in a later batch than their successors are late: they are taken as they
    come. State is one row per unit held, so a receiver costs what it stores.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "session int, last_seq long")
        self.units = handle.getMapState("units", "k int", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["time_ms", "seq"])
        session, last = self.session.get() if self.session.exists() else (0, -1)
        for k, seq, now in zip(frames["k"], frames["seq"], frames["session"]):
            if now == 0:
                continue
            if now != session:
                self.units.clear()
                session = int(now)
            self.units.updateValue((int(k),), (int(seq),))
            last = int(seq)
        self.session.update((session, last))
        held = sum(1 for _ in self.units.keys())
        yield pd.DataFrame({"epoch": [key[0]], "session": [session], "units": [held], "last_seq": [last]})

    def close(self) -> None:
        pass


def stream(frames: DataFrame) -> DataFrame:
    """Streaming receivers: a row for each receiver that a batch touches, in update mode.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    rows = sessions(frames).select("epoch", "seq", "time_ms", "k", "session")
    return rows.groupBy("epoch").transformWithStateInPandas(Receiver(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def window_counts(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and their values per window of time and kind, with a watermark (streams) or without (tables)."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")


def burst_windows(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bursts of a user's events as session windows: the streaming twin of operators.windows.bursts."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
