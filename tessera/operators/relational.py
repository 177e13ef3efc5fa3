"""Row-level operators: filters, lookups, conditional writes, set comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(df: DataFrame, flag: str, include_inactive: bool = False) -> DataFrame:
    return df if include_inactive else df.filter(F.col(flag))


def equal_where_given(df: DataFrame, **values) -> DataFrame:
    """AND of equalities; a null or empty parameter disables its own."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]) if kv[1] not in (None, "") else d, values.items(), df)


def contains_ignoring_case(column: Column, needle: str | None) -> Column:
    """Literal substring in any case; true without a needle."""
    return F.lit(True) if not needle else F.contains(F.lower(column), F.lit(needle.lower()))


def overlaps_keywords(keywords: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(keywords, F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))


def overlap(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Half-open intervals overlap; adjacent ones don't."""
    return (start < to) & (end > from_)


def seed_if_empty(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to insert: all if the table has none at all, else none."""
    none = existing.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return rows.join(F.broadcast(none.filter("_empty").select(F.lit(1).alias("_one"))), F.col("_one") == 1, "left_semi")


def inserted(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and the rows whose key it doesn't have yet; columns that rows lack are null."""
    new = rows.dropDuplicates([key]).join(df.select(key), key, "left_anti")
    return df.unionByName(new, allowMissingColumns=True).select(*df.columns)


def updated(df: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Non-null values of changes replace those of the same key; unknown keys change nothing. Of several changes of a
    key the last one by `order` counts, as a row (without an order, or where it ties, the greatest one)."""
    names = [c for c in changes.columns if c not in (key, order)]
    last = F.max(F.struct(*([order] if order else []), *names)).alias("_last")
    new = changes.groupBy(key).agg(last).select(key, *(F.col(f"_last.{c}").alias(f"_new_{c}") for c in names))
    return df.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def backfilled(df: DataFrame, values: DataFrame, key: str, version: str, column: str) -> DataFrame:
    """Compare and set: a value is written only where the column is still null or empty and the version unchanged."""
    new = values.select(F.col(key), F.col(version), F.col(column).alias("_new"))
    free = F.col(column).isNull() | (F.size(column) == 0)
    return df.join(new, [key, version], "left").select(*(F.when(free, F.coalesce("_new", column)).otherwise(F.col(column)).alias(c) if c == column else F.col(c) for c in df.columns))


def deleted(df: DataFrame, ids: DataFrame, key: str, soft_flag: str | None = None) -> DataFrame:
    """Hard delete, or with a flag column, soft delete."""
    if not soft_flag:
        return df.join(ids, key, "left_anti")
    marked = df.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn(soft_flag, F.col(soft_flag) & F.col("_gone").isNull()).drop("_gone")


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def set_comparison(expected: DataFrame, actual: DataFrame, key: str, item: str) -> DataFrame:
    """For each key: matches, missing, mismatched or extra, by its set of items; items are compared one by one, so no
    set meets in one row."""
    side = lambda df, n: df.select(key, item).distinct().withColumn(n, F.lit(True))
    both = side(expected, "_e").join(side(actual, "_a"), [key, item], "full")
    n = lambda c: F.count(c)
    state = F.when(n("_a") == 0, "missing").when(n("_e") == 0, "extra").when(F.count_if(F.col("_e").isNull() | F.col("_a").isNull()) == 0, "matches").otherwise("mismatched")
    return both.groupBy(key).agg(state.alias("state"))


def completeness(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, extra or repeated in actual."""
    counts = actual.groupBy(key).agg(F.count("*").alias("_n"))
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(counts, key, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")
