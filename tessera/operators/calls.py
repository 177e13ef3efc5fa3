"""Calls of outside services from tasks: a fixed number in flight, a time limit each, and results kept as they come."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def in_time(rows: Iterator[dict], fn: Callable[[dict], object], limit: float, width: int) -> Iterator[tuple[dict, object, str | None]]:
    """(row, value, reason) as calls end. At most `width` calls are awaited at once; one that takes longer than `limit`
    seconds is given up as `timeout` (its thread is left alone), one that fails has `error:<text>`."""
    ended: queue.Queue = queue.Queue()
    waiting: dict[int, tuple[dict, float]] = {}

    def call(number: int, row: dict) -> None:
        try:
            ended.put((number, fn(row), None))
        except Exception as e:  # noqa: BLE001  a failed call is an outcome
            ended.put((number, None, f"error:{e}"))

    number, more = 0, True
    while more or waiting:
        while more and len(waiting) < width:
            row = next(rows, None)
            if row is None:
                more = False
                break
            waiting[number] = row, time.monotonic() + limit
            threading.Thread(target=call, args=(number, row), daemon=True).start()
            number += 1
        if not waiting:
            continue
        try:
            done, value, reason = ended.get(timeout=max(0.0, min(end for _, end in waiting.values()) - time.monotonic()))
            if done in waiting:
                yield waiting.pop(done)[0], value, reason
        except queue.Empty:
            now = time.monotonic()
            for late in [n for n, (_, end) in waiting.items() if end <= now]:
                yield waiting.pop(late)[0], None, "timeout"


def called(df: DataFrame, fn: Callable[[dict], object], kind: str, limit: float, width: int) -> DataFrame:
    """df with `value` (of type kind) and `reason` of one call for each row, in any order; fn travels to the tasks."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    value_type = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = ({**row, "": i} for i, row in enumerate(batch.to_pylist()))
            got = [(row[""], value, reason) for row, value, reason in in_time(numbered, fn, limit, width)]
            own = batch.take(pa.array([i for i, _, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([v for _, v, _ in got], value_type), pa.array([r for _, _, r in got], pa.string())], [*batch.schema.names, "value", "reason"])

    return df.mapInArrow(run, f"{fields}, value {kind}, reason string")


def resumed(df: DataFrame, key: str, fn: Callable[[dict], object], kind: str, folder: str, limit: float, width: int, rounds: int = 8) -> DataFrame:
    """called() for the rows whose key has no value in the folder yet, in some rounds; each round's results are there for
    the next run when it ends. What timed out or failed is called again by the next run. All results that are there:
    (key, value, reason), the value where a key has one."""
    spark = df.sparkSession
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, value {kind}, reason string"
    for k in range(rounds):
        have = _results(spark, folder, schema)
        own = df.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k).join(have.filter("reason IS NULL").select(key), key, "left_anti")
        called(own, fn, kind, limit, width).select(key, "value", "reason").write.mode("append").parquet(f"{folder}/results")
    rows = _results(spark, folder, schema)
    return rows.groupBy(key).agg(F.min_by(F.struct("value", "reason"), F.coalesce("reason", F.lit(""))).alias("r")).select(key, "r.*")


def _results(spark, folder: str, schema: str) -> DataFrame:
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/results")
    there = own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)
    return spark.read.schema(schema).parquet(f"{folder}/results") if there else spark.createDataFrame([], schema)
