"""Stateful twins of operators.events for Structured Streaming, and one stream routed to its sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from veritally import schemas

IDLE_MS = 24 * 3600 * 1000
BURN = StructType().add("run", "long").add("ts", "timestamp").add("event_id", "long").add("slowest", "double")
BACKOFF = StructType().add("run", "long").add("ts", "timestamp").add("event_id", "long").add("consecutive", "integer").add("sleep_s", "integer")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event log's folder as a stream of JSON lines."""
    return spark.readStream.schema(schemas.EVENT).json(folder)


def append_events(events: DataFrame, folder: str, checkpoint: str):
    """Append a stream to the event log's folder, each event once across restarts; the running query."""
    return events.writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).start()


class _PerRun(StatefulProcessor):
    """A run's state with a timer: ``idle_ms`` of event time after the run's last event its state is removed."""

    state = ("", "")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(*self.state)

    def step(self, held, row: tuple) -> tuple[object, tuple | None]:
        """The state after a row, and what the row gives."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.held.get()[0] if self.held.exists() else None, []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for row in frame[self.columns].itertuples(index=False):
            held, given = self.step(held, row)
            if given is not None:
                out.append((key[0], *given))
        self.held.update((held,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(int(frame["ts"].max().value // 1_000_000), timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=self.out.names).astype({c: "int64" for c in ("event_id",)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Burns(_PerRun):
    state, columns, out = ("held", "held array<double>"), ["ts", "event_id", "seconds"], BURN

    def __init__(self, idle_ms: int, last: int, under: float):
        super().__init__(idle_ms)
        self.last, self.under = last, under

    def step(self, held, row):
        held = [*(held or []), float(row[2])][-self.last :]
        full = len(held) == self.last and max(held) < self.under
        return held, (row[0], row[1], max(held)) if full else None


class _Backoffs(_PerRun):
    state, columns, out = ("n", "n int"), ["ts", "event_id", "refused"], BACKOFF

    def __init__(self, idle_ms: int, streak: int, base: int, most: int):
        super().__init__(idle_ms)
        self.streak, self.base, self.most = streak, base, most

    def step(self, held, row):
        n = (held or 0) + 1 if row[2] else 0
        return n, (row[0], row[1], n, 0 if n < self.streak else int(min(self.most, self.base * 2.0 ** (n - self.streak)))) if n else None


def _stateful(stream: DataFrame, run: str, processor: _PerRun, late: str) -> DataFrame:
    # the state store that holds timers
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("ts", late).groupBy(run).transformWithStateInPandas(processor, outputStructType=processor.out, outputMode="Append", timeMode="EventTime")


def burns(outcomes: DataFrame, run: str = "run", last: int = 8, under: float = 25.0, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """(run, ts, event_id, slowest) for each outcome at which the last ones were all fast; state: the last seconds of a run.

    Events may come ``late`` by so much, later ones are dropped. A run's state goes once event time is ``idle_ms`` beyond its last event, so what is held is
    bounded by the runs of that time; a run that goes on after such a pause begins anew. Within it, rows are those of ``operators.events``.
    """
    return _stateful(outcomes, run, _Burns(idle_ms, last, under), late)


def backoffs(pulls: DataFrame, run: str = "run", streak: int = 3, base: int = 60, most: int = 900, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """(run, ts, event_id, consecutive, sleep_s) for each refusal; state: refusals since the last success, held as that of ``burns`` is."""
    return _stateful(pulls, run, _Backoffs(idle_ms, streak, base, most), late)


def routed(events: DataFrame, results: str, refusals: str, checkpoint: str, refused: F.Column | None = None, late: str = "1 hour"):
    """One stream to two sinks: results and refusals, which are no results, each event once; the running query.

    events: event_id, ts and others. An event that comes again within ``late`` of its time is dropped, as is what is later than that. A batch is written
    to a folder of its own in each sink, so one that is run again after a failure replaces what it had written.
    """
    is_refused = F.col("event") == "refused" if refused is None else refused
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def route(batch: DataFrame, batch_id: int) -> None:
        held = batch.withColumn("_refused", F.coalesce(is_refused, F.lit(False))).persist()
        try:
            for path, mine in ((results, ~F.col("_refused")), (refusals, F.col("_refused"))):
                held.where(mine).drop("_refused").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            held.unpersist()

    return once.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).start()
