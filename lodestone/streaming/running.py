"""A running index over a stream of judgements: state by session, in order of event time, with timers and expiry (an extension: batch programs have no streams).

Verdicts of a session wait until the watermark has passed them; then they are taken in order of time and case, whatever the order and the micro-batches in which they came. Each gives a row with the
totals so far. A session that says nothing for longer than `gap` begins again from nothing: its state goes. What comes later than the watermark allows is left out, as in every windowed
aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session bigint, case bigint, ts timestamp, part int, n bigint, defects bigint, bond_index double"
#: The state store that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A verdict that waits: time in milliseconds, case, and whether it is a defect.
VERDICT = np.dtype([("ts", "<i8"), ("case", "<i8"), ("defect", "<i4")])


class RunningIndex(StatefulProcessor):
    """Waiting verdicts in a list, totals in a value, and one timer: at the first time that waits, or else when the session ends.

    Every call of the state is a round trip to the JVM. So the verdicts of a batch are one item of the list, and the timer that stands is written beside the totals, not asked for: the number of
    calls goes with the sessions, not with their verdicts.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "verdicts binary")
        self.totals = handle.getValueState("totals", "part int, n bigint, defects bigint, last bigint, timer bigint")

    def _totals(self) -> tuple:
        """part, n, defects, last time, timer; the last two are null before the first verdict is taken, and without a timer."""
        return self.totals.get() or (0, 0, 0, None, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        mark, new = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            times = batch["ts"].astype("int64").to_numpy() // (1_000_000 if batch["ts"].dt.unit == "ns" else 1_000)
            on_time = times > mark
            if on_time.any():
                verdicts = np.zeros(int(on_time.sum()), VERDICT)
                verdicts["ts"], verdicts["case"], verdicts["defect"] = times[on_time], batch["case"].to_numpy()[on_time].astype("int64"), batch["defect"].to_numpy()[on_time]
                new.append(verdicts)
        if not new:
            return iter(())
        for verdicts in new:
            self.waiting.appendValue((verdicts.tobytes(),))
        *totals, last, timer = self._totals()
        first = int(min(v["ts"].min() for v in new))
        if timer is None or first < timer or (last is not None and timer == last + self.gap_ms):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.totals.update((*totals, last, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        waiting = np.concatenate([np.zeros(0, VERDICT), *(np.frombuffer(bytes(r[0]), VERDICT) for r in self.waiting.get())])
        waiting = waiting[np.lexsort((waiting["defect"], waiting["case"], waiting["ts"]))]
        ready = int(np.searchsorted(waiting["ts"], mark, "right"))
        waiting, rest = waiting[:ready], waiting[ready:]
        part, n, defects, last, _ = self._totals()
        out = None
        if ready:
            ts, misses, at = waiting["ts"], waiting["defect"].astype("int64"), np.arange(ready)
            opens = np.diff(ts, prepend=ts[0] if last is None else last) > self.gap_ms
            # Where the part of each verdict began; -1: before these.
            began = np.maximum.accumulate(np.where(opens, at, -1))
            own, total = began >= 0, np.cumsum(misses)
            parts, ns = part + np.cumsum(opens), np.where(own, at - began + 1, n + at + 1)
            sums = total - np.where(own, total[began] - misses[began], -defects)
            times = pd.DatetimeIndex(ts.astype("datetime64[ms]").astype("datetime64[ns]")).tz_localize("UTC")
            out = pd.DataFrame({"session": np.full(ready, key[0]), "case": waiting["case"], "ts": times, "part": parts.astype("int32"), "n": ns, "defects": sums, "bond_index": sums / ns})
            part, n, defects, last = int(parts[-1]), int(ns[-1]), int(sums[-1]), int(ts[-1])
        timer = None
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            timer = max(int(rest["ts"][0]), mark + 1)
        else:
            self.waiting.clear()
            if last is not None and last + self.gap_ms > mark:
                timer = last + self.gap_ms
            else:
                # Nothing that can still come goes on from here, but for its number.
                n, defects = 0, 0
        # The timer that has expired goes by itself.
        if timer is not None:
            self.handle.registerTimer(timer)
        self.totals.update((part, n, defects, last, timer))
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def running_index(verdicts: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per verdict (session, case, state, expected, ts): session, case, ts, part (how often the session had fallen silent), n, defects, bond_index. Times are taken to the millisecond."""
    import pandas as pd

    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    defect = F.when(F.col("expected").isNotNull() & (F.col("state") != F.col("expected")), 1).otherwise(0)
    rows = verdicts.select("session", "case", "ts", defect.alias("defect")).withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=RunningIndex(gap_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def to_table(df: DataFrame, path: str, checkpoint: str, with_state: bool = False) -> DataFrame:
    """Runs a stream over what there is into a Parquet table, and reads that."""
    spark: SparkSession = df.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if with_state:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if with_state and before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        elif with_state:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(path)
