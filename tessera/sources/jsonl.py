"""JSON-lines logs: reading with a count of bad lines and a time bound, and appending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def instant(value: Column) -> Column:
    """ISO-8601 text (Z or an offset) as a timestamp; null where it isn't one."""
    return F.try_to_timestamp(F.replace(value, F.lit("Z"), F.lit("+00:00")))


def parsed_lines(lines: DataFrame, schema: str, timestamp: str | None = None, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of a text column `value`. Blank lines count as neither; events without a readable
    timestamp stay whatever `since` says."""
    row = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    parsed = lines.filter(F.trim("value") != "").select("value", row.alias("e"))
    bad = parsed.filter("e IS NULL OR e._bad IS NOT NULL").select("value")
    good = parsed.filter("e IS NOT NULL AND e._bad IS NULL").select("e.*").drop("_bad")
    if timestamp and since:
        at = instant(F.col(timestamp))
        good = good.filter(at.isNull() | (at >= instant(F.lit(since))))
    return good, bad


def read_log(spark: SparkSession, path: str, schema: str, timestamp: str | None = None, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parsed_lines(spark.read.text(path), schema, timestamp, since)


def append_log(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Append events to a folder of JSON lines; a failed attempt leaves nothing behind. With a batch's number, events of an
    earlier attempt at the same batch are replaced, so a batch that is tried again is there once."""
    if batch is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")


def log_stream(stream: DataFrame, path: str, checkpoint: str, extra: Callable[[DataFrame, int], None] | None = None):
    """A running query that appends a stream's rows to a log, each once: batches are keyed by their number. extra is
    called with each batch after it is written; where it fails, the batch is written anew by the next run."""

    def keep(batch: DataFrame, number: int) -> None:
        append_log(batch, path, number)
        if extra:
            extra(batch, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


def privacy_safe(df: DataFrame, columns: list[str], keep_raw: bool = False) -> DataFrame:
    """Replace texts by their SHA-256 digests; the raw ones stay only on request."""
    for c in columns:
        df = df.withColumn(f"{c}_sha256", F.sha2(c, 256))
    return df if keep_raw else df.drop(*columns)
