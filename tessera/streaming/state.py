"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, folder: str, pattern: str, schema: str, ts: str) -> DataFrame:
    """A stream over the files of a folder; watermarks need timestamps with a zone, so ts is cast."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def counts_by(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running counts and sums by key, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.round(value).cast("long")).alias("total"))


def windowed(stream: DataFrame, ts: str, keys: list[str], width: str, lateness: str | None = None) -> DataFrame:
    """Tumbling windows; with a lateness, late rows are dropped and closed windows forgotten."""
    s = stream.withWatermark(ts, lateness) if lateness else stream
    return s.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, which the trigger bounds."""
    return pd.concat([*rows]).sort_values([*by])


def _millis(at: pd.Timestamp) -> int:
    """Milliseconds since the epoch, rounded up: a timer must not come before its time."""
    return -(-at.value // 1_000_000)


class AnchoredLimit(StatefulProcessor):
    """Allows so many requests of a key within a span from its first; the next one after the span opens anew. A timer
    at the span's end forgets the key."""

    def __init__(self, seconds: float, most: int, ts: str):
        self.span, self.most, self.ts = pd.Timedelta(seconds=seconds), most, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened timestamp, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        opened = first = None if opened is None else pd.Timestamp(opened)
        pdf = _in_order(rows, self.ts, "id")
        counts = []
        for at in pdf[self.ts]:
            if opened is None or at >= opened + self.span:
                opened, n = at, 0
            n += 1
            counts.append(n)
        if opened != first:
            if first is not None:
                self.handle.deleteTimer(_millis(first + self.span))
            self.handle.registerTimer(_millis(opened + self.span))
        self.state.update((opened.to_pydatetime(), n))
        yield pd.DataFrame({"id": pdf["id"], "n": counts, "allowed": [c <= self.most for c in counts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, ts: str, lateness: str, seconds: float = 60, most: int = 10) -> DataFrame:
    """(id, n, allowed) for a stream with the key, id and ts: n is the place in the key's window, so n > 1 tells a
    repeated submission within the span. Rows later than the lateness are dropped."""
    own = stream.select(key, "id", ts).withWatermark(ts, lateness)
    return own.groupBy(key).transformWithStateInPandas(AnchoredLimit(seconds, most, ts), "id long, n long, allowed boolean", "append", "eventTime")


class ExpiringSession(StatefulProcessor):
    """State that each event renews. It is emitted and forgotten when the time to live has passed since the last one."""

    def __init__(self, seconds: float, ts: str, kind: type):
        self.ttl, self.ts, self.kind = pd.Timedelta(seconds=seconds), ts, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "opened timestamp, last timestamp, n long")

    def _out(self, key, closed: list[tuple]) -> pd.DataFrame:
        opened, last, n = ([c[k] for c in closed] for k in range(3))
        return pd.DataFrame({"key": pd.Series([self.kind(key[0])] * len(closed), dtype="object"), "opened": pd.Series(opened, dtype="datetime64[us]"), "last": pd.Series(last, dtype="datetime64[us]"), "n": pd.Series(n, dtype="int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = last = None
        n, closed = 0, []
        if self.state.exists():
            opened, last, n = self.state.get()
            opened, last = pd.Timestamp(opened), pd.Timestamp(last)
            self.handle.deleteTimer(_millis(last + self.ttl))
        for at in _in_order(rows, self.ts)[self.ts]:
            if last is not None and at - last > self.ttl:
                closed.append((opened, last, n))
                opened, n = None, 0
            opened, last, n = at if opened is None else opened, at if last is None else max(last, at), n + 1
        self.state.update((opened.to_pydatetime(), last.to_pydatetime(), n))
        # One millisecond on: an event exactly a time to live after the last one still renews the session.
        self.handle.registerTimer(_millis(last + self.ttl))
        yield self._out(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, last, n = self.state.get()
        self.state.clear()
        yield self._out(key, [(pd.Timestamp(opened), pd.Timestamp(last), n)])

    def close(self) -> None:
        pass


def expired_sessions(stream: DataFrame, key: str, ts: str, ttl_seconds: float, lateness: str) -> DataFrame:
    """(key, opened, last, n) of each session that has ended: no event for longer than its time to live."""
    name = dict(stream.dtypes)[key]
    own = stream.select(key, ts).withWatermark(ts, lateness)
    processor = ExpiringSession(ttl_seconds, ts, str if name == "string" else int)
    return own.groupBy(key).transformWithStateInPandas(processor, f"key {name}, opened timestamp, last timestamp, n long", "append", "eventTime")


class Conversation(StatefulProcessor):
    """Keeps a conversation's messages as a list that only grows at its end, and the agent at work, which a message
    without one doesn't change. A batch writes its own messages, however long the conversation is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "agent string, n long")
        self.messages = handle.getListState("messages", "turn long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        agent, n = self.about.get() if self.about.exists() else (None, 0)
        pdf = _in_order(rows, "turn")
        for turn, text, to in zip(pdf["turn"], pdf["text"], pdf["agent"]):
            self.messages.appendValue((int(turn), text if isinstance(text, str) else None))
            agent = to if isinstance(to, str) and to else agent
        self.about.update((agent, n + len(pdf)))
        yield pd.DataFrame({"key": [str(key[0])], "agent": [agent], "messages": [n + len(pdf)], "new": [len(pdf)]})

    def close(self) -> None:
        pass


def conversations(stream: DataFrame, key: str) -> DataFrame:
    """(key, agent, messages, new) after each batch, for a stream with the key, turn, text and agent."""
    return stream.groupBy(key).transformWithStateInPandas(Conversation(), "key string, agent string, messages long, new long", "update", "none")


def kept_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What a stream of run_once() has kept under a name: the state of each key that it hasn't forgotten."""
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")


#: Keyed state with timers, lists and a time to live needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, mode: str, folder: str, key: str | None = None) -> DataFrame:
    """Work through all input that is there now into Parquet files under folder, with the checkpoint beside them; the next
    call goes on from there. A batch that is tried again overwrites its own files. append: all batches' rows; complete:
    the last one's; update: each key's last row."""
    if mode not in ("append", "complete", "update"):
        raise ValueError("mode must be append, complete or update")
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    try:
        rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    except AnalysisException:  # no batch had any input
        return spark.createDataFrame([], schema)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    if mode == "update":
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), "batch").alias("r")).select("r.*")
    return rows.drop("batch")
