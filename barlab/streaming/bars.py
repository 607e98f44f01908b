"""Streaming twins: windowed aggregates with watermarks, and the paper replay as a stateful
operator that gives what the batch replay gives."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, fields
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from barlab.operators.commits import Ledger
from barlab.operators.replay import EVENT, Settings, State, close_bar, frame, open_bar


def read_bars(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(event_type, start, n, total) of windows; with ``late``, rows that come later than
    that behind the newest are dropped and their windows' state is freed."""
    rows = events.withWatermark("ts", late) if late else events
    sums = rows.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select("event_type", F.col("window.start").alias("start"), "n", "total")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Drops repeated keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KINDS = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}


@contextmanager
def typed_state(spark: SparkSession):
    """Queries that are started within keep their state in RocksDB, as typed state needs; the
    session's own setting is there again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Replay(StatefulProcessor):
    """A contract's replay as bars come: the fields of its State as a typed value, and the
    newest bar, as what is decided at its close needs the next bar's session. With ``idle``
    seconds, a timer of event time forgets contracts that are flat and had no bar for that
    long, and tells it, so that the state of ended contracts does not stay."""

    def __init__(self, cfg: Settings, idle: float | None):
        self.cfg, self.idle = cfg, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", ", ".join(f"{f.name} {KINDS[f.type]}" for f in fields(State)))
        self.waiting = handle.getValueState("waiting", "ts string, session string, signal bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get()) if self.state.exists() else State()
        newest = self.waiting.get() if self.waiting.exists() else None
        events = []
        for bar in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            if newest is not None:
                before = Bar(pd.Timestamp(newest[0]), newest[1], newest[2])
                if bar.ts <= before.ts:
                    raise ValueError(f"bar out of order: {bar.ts}")
                close_bar(state, before, before.session != str(bar.session), True, self.cfg)
            events += open_bar(state, bar, self.cfg)
            newest = (str(bar.ts), str(bar.session), int(bar.signal))
        self.state.update(astuple(state))
        self.waiting.update(newest)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(int(pd.Timestamp(newest[0]).timestamp() * 1000 + self.idle * 1000))
        yield self._told(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get()) if self.state.exists() else State()
        if state.position == 0 and self.waiting.exists():
            newest = self.waiting.get()
            self.state.clear()
            self.waiting.clear()
            yield self._told(key, [{"kind": "idle", "ts": pd.Timestamp(newest[0])}])

    def close(self) -> None:
        pass

    @staticmethod
    def _told(key, events: list[dict]) -> pd.DataFrame:
        out = frame([{"side": 0, "quantity": 0, **e} for e in events])
        out.insert(0, "contract", key[0])
        return out


class Bar(NamedTuple):
    ts: pd.Timestamp
    session: str
    signal: int


def replay_stream(signals: DataFrame, cfg: Settings | None = None, idle: float | None = None) -> DataFrame:
    """Replay of bars (contract, ts, session, open, close, signal) as they come, in time
    order, to be started within ``typed_state``. Orders are filled as soon as their bar is
    there. ``idle`` needs bars with a watermark of ``ts``."""
    bars = signals.select("contract", "ts", "session", "open", "close", "signal")
    mode = "none" if idle is None else "eventTime"
    return bars.groupBy("contract").transformWithStateInPandas(statefulProcessor=Replay(cfg or Settings(), idle), outputStructType=f"contract string, {EVENT}", outputMode="append", timeMode=mode)


def sessions(rows: DataFrame, key: str, gap: str, at: str = "ts") -> DataFrame:
    """(key, start, n): runs of a key's rows with no gap as long as ``gap``."""
    w = rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), "n")


def append_once(stream: DataFrame, path: str, key: list[str], checkpoint: str):
    """Start a query that appends each row to the ledger at ``path`` once: a batch that is
    run again after a failure, and rows that come again later, add nothing. A batch reads
    the stored rows of the buckets of its own keys only, and is one version of the ledger. A
    key that comes with other content (``digest``) stops the stream."""
    store = Ledger(stream.sparkSession, path, stream.schema, key)
    return stream.writeStream.foreachBatch(lambda batch, _: store.append(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
