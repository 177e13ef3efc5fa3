"""Helpers that the corpus operators share: table reading, the shared folder, sizes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; a temporary one only in a session of one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")


#: Spark's setting to remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back. The shuffle files of the steps before
    go when the table is there, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if _scopes():
        _scopes()[-1].append(path)
    return out


_held = threading.local()


def _scopes() -> list[list[str]]:
    """Of each running function that is cleared(), innermost last, the paths of its tables."""
    if not hasattr(_held, "scopes"):
        _held.scopes = []
    return _held.scopes


def cleared(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn, whose result is written to the shared folder, and whose other stored tables are deleted then."""

    @wraps(fn)
    def run(*args, **options) -> DataFrame:
        _scopes().append([])
        try:
            out = fn(*args, **options)
            done = stored(out, fn.__name__)
        except BaseException:
            _scopes().pop()
            raise
        paths = _scopes().pop()
        for path in paths:
            if path != done._stored_path:
                _delete(done.sparkSession, path)
        if _scopes():
            _scopes()[-1].append(done._stored_path)
        return done

    return run


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(df: DataFrame) -> None:
    """Delete a table written by stored()."""
    path = getattr(df, "_stored_path", None)
    if path:
        _delete(df.sparkSession, path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column of df, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_file(path: str) -> str:
    """A path as it is, or the place of a public tokenizer file by its name, on the machine that asks."""
    if "/" in path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


def release() -> None:
    """Give a Python worker's free memory back to the machine; workers live on between tasks, beside the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one scan, one number."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal df out by keys to as many tasks as the session has shuffle partitions, however few its bytes are:
    for steps that cost far more time than their input's size tells."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)
