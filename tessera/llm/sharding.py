"""Shards along a Hilbert curve over document metadata.

Language, source and size are quantised to a fixed number of bits each and interleaved into a Hilbert
index; the most frequent languages and sources have cells of their own, the others share the last. Equal texts form
one group, which has the index of its first document. All documents are sorted by index; each shard
takes a run of them, and shards' counts differ by one at most (law "rows"), so that a file holds a small box
of metadata and a filter on any of the dimensions skips most files.

Groups stay together: a group of several goes whole to the shard in which its middle lies, and documents
without copies fill the shards up, in runs along the curve. Where a shard can't hold its groups, the rows of its largest ones
that are too many join those that fill up, so only groups too large for a shard, or more groups in
one place than it holds, are split.

Cases: a null text has size 1 and the checksum of nothing, and null texts form one group; null metadata
is a value of its own; repeated rows count again; an empty table gives an empty result; extra columns
are dropped by shard_documents and written by write_shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, stored

BITS = 4


def _cells(docs: DataFrame, column: str, bits: int) -> Column:
    """A metadata value as an integer below 2**bits: the most frequent ones by name, all others the last."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
    top = docs.groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit((1 << bits) - 1).collect()
    names = sorted(r.v for r in top)  # fewer than 2**bits
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), value), F.lit(0)) - 1, F.lit((1 << bits) - 1))


def _numbered(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Adds `at`, the place of each row in this order, from 0: rows are sorted in ranges, and each range starts where
    the counts of those before it end."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    done = stored(ranged, tag)
    # One row for each partition: a size bounded by the number of tasks.
    counts = done.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return done.join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def _shard_at(at: Column, sizes: list[int]) -> Column:
    """The number of the run that holds a place, for runs of these sizes."""
    out = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        out = F.when(at < sum(sizes[: k + 1]), k).otherwise(out)
    return out.cast("int")


def _placed(docs: DataFrame, shards: int, bits: int, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, curve_index, group_id of every document; with whole also _doc, all its columns."""
    kept = ["_doc"] if whole else []
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (bytes_ + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(F.coalesce("text", F.lit("\0null")), 256).alias("_text"),
        _cells(docs, "lang", bits).cast("long").alias("_a"),
        _cells(docs, "source", bits).cast("long").alias("_b"),
        F.least(F.lit((1 << bits) - 1), F.floor(F.log2(bytes_ + 1))).cast("long").alias("_c"),
        *([F.struct(*docs.columns).alias("_doc")] if whole else []),
    )
    first = rows.groupBy("_text").agg(F.min(F.struct("doc_id", "_a", "_b", "_c")).alias("_first"), F.count("*").alias("copies"))
    placed = rows.select("doc_id", "size", "text_crc32", "_text", *kept).join(first, "_text")
    placed = placed.select("doc_id", "size", "text_crc32", "_text", "copies", F.col("_first.doc_id").alias("group_id"), F.col("_first._a").alias("_a"), F.col("_first._b").alias("_b"), F.col("_first._c").alias("_c"), *kept)
    keyed = placed.withColumn("curve_index", _by_table(placed, bits)).drop("_a", "_b", "_c")
    order = ["curve_index", "group_id", "_text", "doc_id"]
    every = _numbered(keyed, order, "sharding")
    short, more = divmod(every.count(), shards)
    sizes = [short + (k < more) for k in range(shards)]
    # Groups of several, each in the shard of its middle; the smaller ones come first where there are too many.
    several = every.filter("copies > 1")
    middle = several.groupBy("_text").agg(F.min("at").alias("start"), F.first("copies").alias("_n")).select("_text", _shard_at(F.col("start") + F.floor(F.col("_n") / 2), sizes).alias("shard"))
    grouped = _numbered(several.drop("at").join(middle, "_text"), ["shard", "copies", *order], "sharding-groups")
    loads = {r["shard"]: r["n"] for r in grouped.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    loads = [loads.get(k, 0) for k in range(shards)]
    starts = F.array(*(F.lit(sum(loads[:k])) for k in range(shards)))
    fits = F.col("at") - F.get(starts, F.col("shard")) < F.get(F.array(*map(F.lit, sizes)), F.col("shard"))
    columns = ["doc_id", "size", "text_crc32", "_text", "group_id", "curve_index", *kept]
    home = grouped.filter(fits).select(*columns, "shard")
    free = every.filter("copies = 1").select(*columns).unionByName(grouped.filter(~fits).select(*columns))
    room = [max(0, n - load) for n, load in zip(sizes, loads)]
    filling = _numbered(free, order, "sharding-rest").withColumn("shard", _shard_at(F.col("at"), room)).select(*columns, "shard")
    out = _numbered(home.unionByName(filling), ["shard", *order], "sharding-slots")
    slot = F.col("at") - F.get(F.array(*(F.lit(sum(sizes[:k])) for k in range(shards))), F.col("shard"))
    return out.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "curve_index", "group_id", *kept)


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and curve_index and group_id."""
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return _placed(docs, shards, bits).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve_index", "group_id")


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = BITS) -> DataFrame:
    """Write whole documents, all their columns, as one Parquet file for each shard, in order of slot, under
    path; returns what the files hold, a row each: n_docs, n_bytes and the least and greatest language, source,
    size and curve index. Columns named shard, slot or curve_index are refused."""
    if clash := {"shard", "slot", "curve_index"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    placed = _placed(docs, shards, bits, whole=True).select("_doc.*", "shard", "slot", "curve_index")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.schema(placed.schema).parquet(path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    ends = [f(c).alias(f"{n}_{name}") for name, c in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size + 1), ("curve_index", F.col("curve_index"))) for n, f in (("min", F.min), ("max", F.max))]
    return written.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes"), *ends)


def hilbert_value(axes: tuple[int, ...], bits: int) -> int:
    """The same index in plain integers."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for k in range(bits - 1, -1, -1):
        for a in x:
            out = out * 2 + ((a ^ t) >> k & 1)
    return out


def _by_table(df: DataFrame, bits: int) -> Column:
    """Curve indexes of all cells as one literal array of 8**bits entries (4,096 for 4 bits)."""
    side = 1 << bits
    values = [hilbert_value((a, b, c), bits) for a in range(side) for b in range(side) for c in range(side)]
    literal = F.from_json(F.lit(str(values)), "array<long>")
    return F.element_at(literal, (F.col("_a") * side * side + F.col("_b") * side + F.col("_c") + 1).cast("int"))
