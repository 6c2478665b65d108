"""Redraws at most once an interval of event time, and presence that lapses: state with timers, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What happens to a receiver: present, redraw (with the units that it shows) or lapsed, at a time in milliseconds.
OUTPUT = "receiver long, kind string, at long, units long"


def next_redraw(shown: int | None, t: int, interval: int) -> int | None:
    """When a change at t is drawn, the last redraw being at shown: at once, an interval after it, or with it (None)."""
    if shown is not None and t <= shown:
        return None
    return t if shown is None or t >= shown + interval else shown + interval


def redraws(frames: DataFrame, interval: int) -> DataFrame:
    """Batch twin: receiver, kind, at, units of every redraw.

    frames: receiver, unit, time (long, milliseconds). A unit's first frame is a change. A receiver draws a change at once if its last
    redraw is an interval or more ago, else when the interval is over. First frames are gathered, a receiver's units being bounded.
    """
    first = frames.groupBy("receiver", "unit").agg(F.min("time").alias("t")).groupBy("receiver").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(t <= last, done).otherwise(F.concat(done, F.array(F.greatest(t, last + interval))))

    drawn = F.aggregate(F.slice("ts", F.lit(2), F.size("ts")), F.slice("ts", 1, 1), step)
    rows = first.select("receiver", "ts", F.explode(drawn).alias("at"))
    return rows.select("receiver", F.lit("redraw").alias("kind"), "at", F.size(F.filter("ts", lambda t: t <= F.col("at"))).cast("long").alias("units"))


def presence(frames: DataFrame, gap: int) -> DataFrame:
    """Batch twin: receiver, kind, at, units (null): present at the first frame after a gap, lapsed a gap after the last."""
    order = Window.partitionBy("receiver").orderBy("time")
    rows = frames.select("receiver", "time", F.lag("time").over(order).alias("before"), F.lead("time").over(order).alias("after"))
    come = rows.filter(F.col("before").isNull() | (F.col("time") - F.col("before") > gap)).select("receiver", F.lit("present").alias("kind"), F.col("time").alias("at"))
    gone = rows.filter(F.col("after").isNull() | (F.col("after") - F.col("time") > gap)).select("receiver", F.lit("lapsed").alias("kind"), (F.col("time") + gap).alias("at"))
    return come.unionByName(gone).withColumn("units", F.lit(None).cast("long"))


class Timed(StatefulProcessor):
    """One receiver's redraws and presence, given out when the watermark has passed them.

    Frames up to the watermark's delay late count as if they had come in time: first frames of units and the times not yet
    settled stay in state until the watermark passes, when a timer settles them in order. State is a row for each unit
    and for each frame that is not settled; after a lapse only the units and the last redraw are left.
    """

    def __init__(self, interval: int, gap: int):
        self.interval, self.gap = interval, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getMapState("units", "unit long", "t long")
        self.waiting = handle.getMapState("waiting", "t long", "n long")  # times of frames that are not settled
        self.settled = handle.getValueState("settled", "shown long, last long, upto long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows))
        for unit, t in frames.groupby("unit")["time"].min().items():
            k = (int(unit),)
            if not self.units.containsKey(k) or self.units.getValue(k)[0] > t:
                self.units.updateValue(k, (int(t),))
        for t in frames["time"].unique():
            self.waiting.updateValue((int(t),), (1,))
            self.handle.registerTimer(int(t))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        shown, last, upto = self.settled.get() if self.settled.exists() else (None, None, None)
        if upto is not None and upto >= now:
            return
        firsts, out, ahead = sorted(v[0] for v in self.units.values()), [], []
        for t in firsts:
            if t > now:
                break
            drawn = next_redraw(shown, t, self.interval)
            if drawn is None:
                continue
            if drawn > now:
                ahead.append(drawn)
                break
            shown = drawn
            out.append(("redraw", drawn, sum(f <= drawn for f in firsts)))
        for t in sorted(k[0] for k in self.waiting.keys()):
            if t > now:
                break
            if last is not None and t - last > self.gap:
                out.append(("lapsed", last + self.gap, None))
                last = None
            if last is None:
                out.append(("present", t, None))
            last = t
            self.waiting.removeKey((t,))
        if last is not None:
            if last + self.gap < now:
                out.append(("lapsed", last + self.gap, None))
                last = None
            else:
                ahead.append(last + self.gap + 1)
        self.settled.update((shown, last, now))
        for t in ahead:
            self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame({"receiver": key[0], "kind": [o[0] for o in out], "at": [o[1] for o in out], "units": pd.array([o[2] for o in out], dtype="Int64")})

    def close(self) -> None:
        pass


def stream(frames: DataFrame, interval: int, gap: int, late: str = "10 seconds") -> DataFrame:
    """Redraws and presence of streaming frames (receiver, unit, time in milliseconds), each once, when the watermark has passed it.

    Needs the RocksDB state store. A lapse that the watermark has just reached waits for the next millisecond, as a frame may still come.
    """
    rows = frames.select("receiver", "unit", "time", F.timestamp_millis("time").alias("at")).withWatermark("at", late)
    return rows.groupBy("receiver").transformWithStateInPandas(Timed(interval, gap), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
