"""Observability and evaluation measures: percentiles, roll-ups, costs, accuracy, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("usage_not_reported", "pricing_tier_exceeded", "pricing_not_configured", "calculated")


#: Up to so many values a group's whole range is looked at; beyond, what lies between two approximate quantiles.
SMALL, ACCURACY, MARGIN = 20_000, 10_000, 0.001
#: Up to so many values in all are put in order at once.
DIRECT = 1_000_000
#: Equal parts of a bracket.
BUCKETS = 1024
Place = Callable[[Column], Column]


def nearest_place(p: float) -> Place:
    """Nearest rank: index round((n - 1) * p) from 0, half to even."""
    return lambda n: F.bround((n - 1) * F.lit(p), 0).cast("long")


def floor_place(p: float) -> Place:
    """The other definition in use: index min(n - 1, int(n * p))."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(p)).cast("long"))


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple[float, Place]]) -> DataFrame:
    """(keys, n, mean, picks) of a group's values: each pick is (p, place), the value at that index in ascending order.

    Exact, without a group's values meeting in one task: approximate quantiles on both sides of p bracket the place, one
    pass counts what lies below the bracket and in each of BUCKETS equal parts of it, and only the distinct values of
    the part that holds the place are put in order. p tells where the place is, to a thousandth of n."""
    # The keys are one struct: it is never null, and equal ones have equal or null fields.
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if rows.limit(DIRECT + 1).count() <= DIRECT:
        return _few_statistics(rows, picks)
    each = range(len(picks))
    shares = [x for p, _ in picks.values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    stats = rows.groupBy("_key").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", shares, ACCURACY).alias("_q"))
    end = lambda k, whole: F.when(F.col("n") <= SMALL, F.col(whole)).otherwise(F.get("_q", k))
    stats = stats.select("_key", "n", "mean", *(end(2 * i, "_min").alias(f"_lo{i}") for i in each), *(end(2 * i + 1, "_max").alias(f"_hi{i}") for i in each))
    both = rows.join(stats.drop("n", "mean"), "_key")
    below = both.groupBy("_key").agg(*(F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in each))
    inside = F.array(*(F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), i) for i in each))
    counts = both.select("_key", "_v", F.explode(F.filter(inside, lambda i: i.isNotNull())).alias("_i")).groupBy("_key", "_i", "_v").agg(F.count("*").alias("_c"))
    bound = lambda end: F.coalesce(*(F.when(F.col("_i") == i, F.col(f"_{end}{i}")) for i in each))
    span = bound("hi") - bound("lo")
    part = F.when(span > 0, F.floor((F.col("_v") - bound("lo")) / span * BUCKETS)).otherwise(0)
    counts = counts.join(stats, "_key").select("_key", "_i", "_v", "_c", "n", "mean", part.alias("_part"))
    # BUCKETS rows a group and pick: the part in which the place is, and where in it.
    parts = counts.groupBy("_key", "_i", "_part", "n", "mean").agg(F.sum("_c").alias("_s"))
    parts = parts.withColumn("_end", F.sum("_s").over(Window.partitionBy("_key", "_i").orderBy("_part"))).join(below, "_key")
    at = F.coalesce(*(F.when(F.col("_i") == i, place(F.col("n")) - F.col(f"_below{i}")) for i, (_, place) in enumerate(picks.values())))
    held = parts.withColumn("_at", at).filter((F.col("_end") > F.col("_at")) & (F.col("_end") - F.col("_s") <= F.col("_at")))
    held = held.select("_key", "_i", "_part", (F.col("_at") - (F.col("_end") - F.col("_s"))).alias("_at"))
    upto = counts.join(held, ["_key", "_i", "_part"]).withColumn("_upto", F.sum("_c").over(Window.partitionBy("_key", "_i").orderBy("_v")))
    own = upto.filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))
    values = [F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(picks)]
    return own.groupBy("_key").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *values).select("_key.*", "n", "mean", *picks)


def _few_statistics(rows: DataFrame, picks: dict[str, tuple[float, Place]]) -> DataFrame:
    """The same for few values: each group's distinct ones in order."""
    counts = rows.groupBy("_key", "_v").agg(F.count("*").alias("_c"))
    own = Window.partitionBy("_key").orderBy("_v")
    upto = counts.withColumn("_upto", F.sum("_c").over(own)).withColumn("n", F.sum("_c").over(Window.partitionBy("_key")))
    held = lambda place: F.when((F.col("_upto") > place(F.col("n"))) & (F.col("_upto") - F.col("_c") <= place(F.col("n"))), F.col("_v"))
    sums = rows.groupBy("_key").agg(F.avg("_v").alias("mean"))
    values = upto.groupBy("_key").agg(F.first("n").alias("n"), *(F.max(held(place)).alias(name) for name, (_, place) in picks.items()))
    return values.join(sums, "_key").select("_key.*", "n", "mean", *picks)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and nearest-rank p50, p95 and p99 of each group, six places; 0 for a group without values."""
    picks = {name: (p, nearest_place(p)) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    own = order_statistics(df, keys, value, picks).withColumn("_key", F.struct(*keys)).drop(*keys)
    out = df.select(F.struct(*keys).alias("_key")).distinct().join(own, "_key", "left")
    return out.select("_key.*", *(F.bround(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("mean", *picks)))


def rate(condition: Column) -> Column:
    """Share of a group's rows; 0 for none."""
    return F.bround(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0)), 6)


def merge_counters(df: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Counters that merge with earlier snapshots of themselves: sums add, maxima take the larger."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))


def cost_status(tokens: Column, largest: Column, tier: Column, price: Column) -> Column:
    """The first reason why a cost can't be told, else calculated."""
    return F.when(tokens.isNull() | (tokens <= 0), STATUSES[0]).when(tier.isNotNull() & (largest > tier), STATUSES[1]).when(price.isNull(), STATUSES[2]).otherwise(STATUSES[3])


def cost(status: Column, tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Money for prices by the million tokens, eight places; unknown is null, never 0."""
    return F.when(status == STATUSES[3], F.bround((tokens_in * price_in + tokens_out * price_out) / 1e6, 8))


def estimated_tokens(chars: Column, chars_per_token: float = 2.0) -> Column:
    return F.ceil(chars / F.lit(chars_per_token)).cast("long")


def accuracy(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Accuracy of each class and overall (class null); the denominator is the class total."""
    hit = F.coalesce(F.col(expected) == F.col(actual), F.lit(False))
    return df.rollup(F.col(expected).alias("class")).agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.bround(F.avg(hit.cast("double")), 6).alias("accuracy"))


def ranking_summary(df: DataFrame, keys: list[str], rank: str = "rank", cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at each cutoff and mean reciprocal rank, from one first-hit rank for each case (null: no hit)."""
    r = F.col(rank)
    recalls = [F.bround(F.avg(F.coalesce(r <= k, F.lit(False)).cast("double")), 6).alias(f"recall_{k}") for k in cutoffs]
    return df.groupBy(*keys).agg(F.count("*").alias("cases"), *recalls, F.bround(F.avg(F.coalesce(1 / r.cast("double"), F.lit(0.0))), 6).alias("mrr"))


COUNTERS = ("logical_calls", "failed_calls", "input_tokens", "output_tokens", "total_tokens", "estimated_input_tokens", "reported_calls")
LARGEST = ("max_input_tokens_per_call",)


def usage_summary(events: DataFrame) -> DataFrame:
    """One row of (events, failed_call_rate, cost_coverage_rate, cost_total, cost_status_counts) over usage events with
    the structs usage (logical_calls, failed_calls) and cost (status, total_cny); a missing status counts as missing."""
    status = F.coalesce(F.nullif(F.col("cost.status"), F.lit("")), F.lit("missing"))
    counts = events.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    states = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("cost_status_counts"))  # one entry a status
    share = lambda a, b: F.bround(F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0)), 6)
    calls, failed = F.sum(F.coalesce("usage.logical_calls", F.lit(0))), F.sum(F.coalesce("usage.failed_calls", F.lit(0)))
    own = events.agg(F.count("*").alias("events"), share(failed, calls).alias("failed_call_rate"), share(F.count("cost.total_cny"), F.count("*")).alias("cost_coverage_rate"), F.bround(F.coalesce(F.sum("cost.total_cny"), F.lit(0.0)), 8).alias("cost_total"))
    return own.crossJoin(F.broadcast(states))  # one row each


def usage_distributions(events: DataFrame) -> DataFrame:
    """(metric, mean, p50, p95, p99) of tokens, estimated embedding tokens, calls and cost of an event; an event
    without a cost has no part in the cost's."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    values = (("provider_token_count", zero("usage.total_tokens")), ("estimated_embedding_token_count", zero("usage.estimated_input_tokens")), ("logical_calls", zero("usage.logical_calls")), ("cost_cny", F.col("cost.total_cny").cast("double")))
    long = events.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), v.alias("value")) for name, v in values))).alias("m")).select("m.*")
    return distribution(long, ["metric"], "value")


def faithfulness(claims: Column) -> Column:
    """Supported claims by all claims, from an array of structs with `supported`; 0 without claims."""
    held = F.coalesce(F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False)))), F.lit(0))
    return F.bround(F.coalesce(held / F.nullif(F.size(claims), F.lit(0)), F.lit(0.0)), 6)


def compression(chunk_chars: Column, whole_chars: Column) -> Column:
    """1 - chunk / whole; null without a whole."""
    return F.bround(1 - chunk_chars / F.nullif(whole_chars.cast("double"), F.lit(0.0)), 6)


def accuracy_gate(df: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of accuracy() with `passed`."""
    return df.withColumn("passed", F.col("accuracy") >= least)


def gates(current: DataFrame, baseline: DataFrame, policy: DataFrame) -> DataFrame:
    """Compare (metric, value) rows with a baseline under (metric, kind, bound): equality, absolute loss or ratio.
    A missing current value fails."""
    both = policy.join(baseline.withColumnRenamed("value", "base"), "metric").join(current, "metric", "left")
    ok = F.when(F.col("kind") == "equal", F.col("value") == F.col("base")).when(F.col("kind") == "loss", F.col("value") >= F.col("base") - F.col("bound") - 1e-9).otherwise(F.col("value") <= F.col("base") * F.col("bound") + 1e-9)
    return both.select("metric", "kind", "value", "base", F.coalesce(ok, F.lit(False)).alias("passed"))


def acceptance(current: DataFrame, baseline: DataFrame, policy: DataFrame, quality: list[str], composite_loss: float = 0.01, cost_required: bool = True, cost_ratio: float = 1.15, cost: str = "cost_per_case") -> DataFrame:
    """(metric, kind, passed) of all gates: those of the policy, the mean of the quality metrics, and the cost, which
    may be missing only where it isn't required."""
    mean = lambda df, name: df.filter(F.col("metric").isin(quality)).agg(F.avg("value").alias(name))
    composite = mean(baseline, "base").crossJoin(mean(current, "value")).select(F.lit("quality_composite").alias("metric"), F.lit("loss").alias("kind"), F.coalesce(F.col("value") >= F.col("base") - composite_loss - 1e-9, F.lit(False)).alias("passed"))
    one = lambda df, name: df.agg(F.max(F.when(F.col("metric") == cost, F.col("value"))).alias(name))
    priced = F.coalesce(F.col("value") <= F.col("base") * cost_ratio + 1e-9, F.lit(not cost_required))
    price = one(baseline, "base").crossJoin(one(current, "value")).select(F.lit(cost).alias("metric"), F.lit("ratio").alias("kind"), priced.alias("passed"))  # one row each
    return gates(current, baseline, policy.filter(F.col("metric") != cost)).select("metric", "kind", "passed").unionByName(composite).unionByName(price)


def unit(value: Column) -> Column:
    """Clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
