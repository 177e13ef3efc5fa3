"""Folders of text documents, uploads, and versioned snapshots of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.commits import Log, Table

SUFFIXES = ("md", "markdown", "txt")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of a folder's Markdown and text files, but for readme.md in any case."""
    df = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    return df.filter(suffix.isin(*SUFFIXES) & (F.lower("name") != "readme.md")).orderBy("name")


def decode_uploads(files: DataFrame, name: str = "name", content: str = "content", most: int = 2 << 20) -> DataFrame:
    """Adds text and error to (name, binary content) rows; the first failing rule names the error."""
    raw = F.col(content)
    body = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, 4, 1 << 30)).otherwise(raw)
    text = F.try_validate_utf8(body.cast("string"))
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    error = F.when(~suffix.isin(*SUFFIXES), "unsupported_type").when(F.length(raw) > most, "too_large").when(text.isNull(), "not_utf8").when(F.trim(text) == "", "empty")
    return files.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), text))


def write_snapshot(df: DataFrame, folder: str, since: int | None = None) -> int:
    """Write a new immutable version of a table; its number. With `since`, ConcurrentCommit if that isn't the newest."""
    return Table(df.sparkSession, folder).replace(df, since)


def generation(spark: SparkSession, folder: str) -> int | None:
    """The newest version of a table, which is its generation; none without one."""
    return Log(spark, folder).newest()


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version's rows; ValueError for an unknown one."""
    found = Table(spark, folder).read(version)
    if found is None:
        raise ValueError(f"no version in {folder}")
    return found


def refreshed(spark: SparkSession, folder: str, held: int | None, load: Callable[[DataFrame], DataFrame], tries: int = 3) -> tuple[int | None, DataFrame | None]:
    """(generation, result) of load() over the newest version, or (held, None) where it is held already. A result
    during whose loading a newer version came is stale and loaded again, so many times; ValueError after that."""
    for _ in range(tries):
        newest = generation(spark, folder)
        if newest is None or newest == held:
            return held, None
        out = load(read_snapshot(spark, folder, newest))
        if generation(spark, folder) == newest:
            return newest, out
    raise ValueError(f"{folder} changed {tries} times while it was read")


def restore_snapshot(spark: SparkSession, folder: str, version: int) -> int:
    """Make an earlier version the newest, without writing its rows again; the present one stays as a safety copy.
    ValueError for an unknown one."""
    log = Log(spark, folder)
    newest = log.newest()
    if version not in log.versions():
        raise ValueError(f"no version {version} in {folder}")
    return log.commit(log.entry(version), newest)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of one list of objects, or of one object."""
    return spark.read.option("multiLine", "true").json(path)
