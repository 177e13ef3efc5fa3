"""Booking gateways: one over the engine's own tables, one over a remote service by a function that calls it."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.operators import scheduling


def outcome(code: Column) -> Column:
    """Outcome of a call by its status code; null stands for a timeout."""
    return F.when(code.isNull() | (code >= 500), "unavailable").when(code == 409, "conflict").when(code >= 400, "request_error").otherwise("ok")


class Gateway(Protocol):
    """What a gateway answers for a batch of booking requests: (arrival, outcome)."""

    def book(self, requests: DataFrame) -> DataFrame: ...


class LocalGateway:
    """Books against tables of people and busy intervals."""

    def __init__(self, people: DataFrame, busy: list[DataFrame], now: Column):
        self.people, self.busy, self.now = people, busy, now

    def book(self, requests: DataFrame) -> DataFrame:
        done = scheduling.booked(requests, self.people, self.busy, self.now)
        own = F.when(F.col("outcome").isin("CREATED", "REPLAY"), "ok").when(F.col("outcome") == "CONFLICT", "conflict").otherwise("request_error")
        return done.select("arrival", own.alias("outcome"))


class RemoteGateway:
    """Sends each request, a dictionary, through a function that returns a status code, or none for a timeout; the
    function travels to the tasks."""

    def __init__(self, call: Callable[[dict], int | None]):
        self.call = call

    def book(self, requests: DataFrame) -> DataFrame:
        call = self.call

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                codes = [call(row) for row in pdf.to_dict("records")]
                yield pd.DataFrame({"arrival": pdf["arrival"], "code": pd.array(codes, dtype="Int64")})

        return requests.mapInPandas(send, "arrival long, code long").select("arrival", outcome(F.col("code")).alias("outcome"))


def gateway(kind: str, **options) -> Gateway:
    """A gateway by name: local or remote; ValueError for another."""
    kinds = {"local": LocalGateway, "remote": RemoteGateway}
    if (key := (kind or "").strip().lower()) not in kinds:
        raise ValueError(f"unknown gateway {kind!r}; known: {sorted(kinds)}")
    return kinds[key](**options)


class Client(Protocol):
    """A remote booking service: pages of bookings, and batches of requests. It travels to the tasks."""

    def pages(self) -> int: ...

    def page(self, number: int) -> list[tuple]: ...

    def send(self, requests: list[dict]) -> list[int | None]:
        """A status code for each request, None for a timeout."""

    def report(self, counts: dict[str, int]) -> None:
        """What became of a write, when all of its tasks have ended."""


def outcome_of(code: int | None) -> str:
    """outcome() of one code."""
    return "unavailable" if code is None or code >= 500 else "conflict" if code == 409 else "request_error" if code >= 400 else "ok"


@dataclass
class Page(InputPartition):
    number: int


@dataclass
class Sent(WriterCommitMessage):
    counts: dict


class _Reader(DataSourceReader):
    def __init__(self, client: Client):
        self.client = client

    def partitions(self) -> list[InputPartition]:
        return [Page(k) for k in range(self.client.pages())]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.client.page(partition.number)


class _Writer(DataSourceWriter):
    """Sends batches; what is unavailable is sent again, after a growing pause, up to so many times. A request that stays
    so is counted, and doesn't fail the write; the service's idempotency keys make a task's second attempt harmless."""

    def __init__(self, client: Client, batch: int, tries: int, pause: float):
        self.client, self.batch, self.tries, self.pause = client, batch, tries, pause

    def write(self, rows: Iterator) -> WriterCommitMessage:
        counts: Counter = Counter()
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict())
            if len(held) == self.batch:
                counts += self._send(held)
                held = []
        return Sent(dict(counts + self._send(held)))

    def _send(self, requests: list[dict]) -> Counter:
        counts: Counter = Counter()
        for attempt in range(self.tries):
            if not requests:
                break
            if attempt:
                counts["retries"] += len(requests)
                time.sleep(self.pause * 2 ** (attempt - 1))
            again = []
            for request, code in zip(requests, self.client.send(requests)):
                if outcome_of(code) == "unavailable" and attempt < self.tries - 1:
                    again.append(request)
                else:
                    counts[outcome_of(code)] += 1
            requests = again
        return counts

    def commit(self, messages: list) -> None:
        total: Counter = Counter()
        for m in messages:
            total += Counter(m.counts if m else {})
        self.client.report(dict(total))

    def abort(self, messages: list) -> None:
        pass


def register_bookings(spark: SparkSession, name: str, client: Client, schema: str) -> None:
    """Make a service a data source by name: spark.read.format(name).load() reads its bookings, page by page in tasks of
    their own, and df.write.format(name).mode("append").save() sends requests (options: batch, tries, pause)."""

    class Bookings(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(client)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(client, int(self.options.get("batch", 100)), int(self.options.get("tries", 3)), float(self.options.get("pause", 0.5)))

    spark.dataSource.register(Bookings)
