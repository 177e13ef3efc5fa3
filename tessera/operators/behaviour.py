"""Behaviour analytics: counts, favourites, popularity, cadence, histograms, preferences.

Every operator maps a DataFrame of events to a DataFrame; keys and time columns are parameters, and `asof`
is always explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without time zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def within_days(df: DataFrame, ts: str, asof: str, days: int | None) -> DataFrame:
    """Rows of the last `days` days before asof; no filter without days."""
    return df.filter(F.col(ts) >= F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")) if days else df


def whole_days_since(ts: Column, asof: str) -> Column:
    return F.floor((seconds(F.lit(asof).cast("timestamp_ntz")) - seconds(ts)) / DAY).cast("long")


def activity_counts(df: DataFrame, key: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """Total and conditional counts in one pass over the rows."""
    return df.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == v).alias(n) for n, v in kinds.items()))


def favourite(df: DataFrame, key: str, entity: str) -> DataFrame:
    """The entity each key has most rows with; ties go to the smaller entity."""
    counts = df.filter(F.col(entity).isNotNull()).groupBy(key, entity).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.asc(entity)))
    return counts.withColumn("_r", first).filter("_r = 1").drop("_r")


def popularity(df: DataFrame, entity: str, user: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"))


def recent_mode(df: DataFrame, key: str, value: str, ts: str, least: int = 1) -> DataFrame:
    """Most frequent value for each key, the most recent one on ties; needs `least` rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.max(ts).alias("_last")).filter(F.col("n") >= least)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc("_last"), F.asc(value)))
    return counts.withColumn("_r", first).filter("_r = 1").drop("_r", "_last")


def histogram(df: DataFrame, key: str, value: Column, ts: str, tie: str) -> DataFrame:
    """(key, counts as a map from the value's text, mode): the most frequent value, the one seen first on ties."""
    each = df.select(key, value.alias("_v"), F.struct(ts, tie).alias("_at")).groupBy(key, "_v").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("_v").cast("string").alias("v"), F.col("_n").alias("n")))))  # a value each
    first = F.min_by("_v", F.struct(-F.col("_n"), F.col("_first")))
    return each.groupBy(key).agg(pairs.alias("counts"), first.alias("mode"))


def cadence(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Mean of the whole days between consecutive rows of a key, and its label."""
    gap = F.floor((seconds(F.col(ts)) - seconds(F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie)))) / DAY)
    own = df.withColumn("_gap", gap).groupBy(key).agg(F.count("*").alias("n"), F.avg("_gap").alias("avg_days"))
    label = F.when(F.col("n") < 2, "insufficient_data").when(F.col("avg_days") < 7, "very_frequent").when(F.col("avg_days") < 14, "frequent").when(F.col("avg_days") < 30, "regular").otherwise("occasional")
    return own.withColumn("label", label)


def activity_label(appointments: Column, total: Column) -> Column:
    return F.when(total == 0, "no_data").when(appointments > 2, "active_user").otherwise("occasional_user")


def preference_confidence(df: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Upserts summed by key; each adds at least one."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.lit(1), F.col(confidence).cast("long"))).alias("confidence"))


def day_period(ts: Column) -> Column:
    """Morning (6-11), afternoon (12-17) and evening; fixed labels."""
    h = F.hour(ts)
    return F.when(h.between(6, 11), "上午").when(h.between(12, 17), "下午").otherwise("晚上")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; each task keeps k of its own before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def return_reminder(df: DataFrame, key: str, ts: str, asof: str, least: int = 2, days: int = 30) -> DataFrame:
    """Keys with at least `least` rows, the last at least `days` whole days ago."""
    own = df.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("_last"))
    return own.withColumn("days_since", whole_days_since(F.col("_last"), asof)).withColumn("remind", (F.col("n") >= least) & (F.col("days_since") >= days)).drop("_last")
