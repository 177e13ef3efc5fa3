"""Observability queries; events stand for the log of model calls."""

from pyspark.sql import functions as F

from tessera.operators import metrics as op
from tessera.plans.base import query
from tessera.sources.jsonl import parsed_lines

RANK = "list_sort(list(value))[CAST(round_even((count(*) - 1) * {p}, 0) AS BIGINT) + 1]"


@query(f"SELECT event_type, round_even(avg(value), 6) AS mean, {', '.join(f'round_even({RANK.format(p=p)}, 6) AS {n}' for n, p in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))} FROM events GROUP BY 1")
def latency_percentiles(t):
    return op.distribution(t.events, ["event_type"], "value")


@query("SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p95 FROM events GROUP BY 1")
def latency_p95_alt(t):
    return op.order_statistics(t.events, ["event_type"], "value", {"p95": (0.95, op.floor_place(0.95))}).select("event_type", "p95")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def latency_median(t):
    """The mean of the two values in the middle, which are one where the count is odd."""
    both = op.order_statistics(t.events, ["event_type"], "value", {"low": (0.5, lambda n: F.floor((n - 1) / 2)), "high": (0.5, lambda n: F.floor(n / 2))})
    return both.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"))


@query("""SELECT provider, count(*) AS n, round_even(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS no_answer_rate, round_even(avg(CASE WHEN event_type = 'error' OR k % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate
FROM (SELECT event_type, k, CASE WHEN k < 20 THEN 'llm' WHEN k < 40 THEN 'cross_encoder' ELSE 'hybrid' END AS provider FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) GROUP BY 1""")
def retrieval_rollup(t):
    k = F.get_json_object("props", "$.k").cast("long")
    trace = t.events.select("event_type", F.when(k < 20, "llm").when(k < 40, "cross_encoder").otherwise("hybrid").alias("provider"), (F.col("event_type") == "error").alias("route_fallback"), F.array(F.struct((k % 10 == 0).alias("rerank_fallback"))).alias("candidates"))
    fell = F.col("route_fallback") | F.exists("candidates", lambda c: c["rerank_fallback"])
    return trace.groupBy("provider").agg(F.count("*").alias("n"), op.rate(F.col("event_type") == "view").alias("no_answer_rate"), op.rate(fell).alias("fallback_rate"))


USAGE = """u AS (SELECT event_id, CASE WHEN k % 9 = 0 THEN NULL ELSE 1 + k % 3 END AS calls, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, CAST(round(value) AS BIGINT) AS tokens,
CASE WHEN event_type = 'signup' THEN NULL WHEN value > 1 THEN 'calculated' ELSE 'usage_not_reported' END AS status, CASE WHEN event_type <> 'signup' AND value > 1 THEN CAST(round(value * 100) AS BIGINT) / 1000000.0::DOUBLE END AS cost
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def usage(t):
    """Events as usage events: calls are missing for some, as is the cost's status."""
    k, v = F.get_json_object("props", "$.k").cast("long"), F.col("value")
    counters = F.struct(F.when(k % 9 != 0, 1 + k % 3).alias("logical_calls"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failed_calls"), F.round(v).cast("long").alias("total_tokens"), (F.round(v).cast("long") * 2).alias("estimated_input_tokens"))
    known = (F.col("event_type") != "signup") & (v > 1)
    cost = F.struct(F.when(F.col("event_type") != "signup", F.when(v > 1, "calculated").otherwise("usage_not_reported")).alias("status"), F.when(known, F.round(v * 100).cast("long") / 1e6).alias("total_cny"))
    return t.events.select("event_id", counters.alias("usage"), cost.alias("cost"))


@query(f"""WITH {USAGE} SELECT count(*) AS events, round_even(sum(failed) / sum(coalesce(calls, 0))::DOUBLE, 6) AS failed_call_rate, round_even(count(cost) / count(*)::DOUBLE, 6) AS cost_coverage_rate, round(sum(cost), 6) AS cost_total,
(SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT coalesce(status, 'missing') AS s, count(*) AS n FROM u GROUP BY 1)) AS statuses FROM u""")
def usage_rollup(t):
    own = op.usage_summary(usage(t))
    pairs = F.transform(F.map_entries("cost_status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return own.select("events", "failed_call_rate", "cost_coverage_rate", F.round("cost_total", 6).alias("cost_total"), F.array_join(pairs, ",").alias("statuses"))


@query(f"""WITH {USAGE}, m AS (SELECT 'provider_token_count' AS metric, tokens::DOUBLE AS value FROM u UNION ALL SELECT 'estimated_embedding_token_count', tokens * 2.0::DOUBLE FROM u UNION ALL SELECT 'logical_calls', coalesce(calls, 0)::DOUBLE FROM u UNION ALL SELECT 'cost_cny', cost FROM u WHERE cost IS NOT NULL)
SELECT metric, round(avg(value), 4) AS mean, {', '.join(f'round_even({RANK.format(p=p)}, 6) AS {n}' for n, p in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))} FROM m GROUP BY 1""")
def usage_distributions(t):
    return op.usage_distributions(usage(t)).withColumn("mean", F.round("mean", 4))


COUNTS = ", ".join(f"CAST(sum({i} + CAST(round(value) AS BIGINT) % {i + 2}) AS BIGINT) AS {c}" for i, c in enumerate(op.COUNTERS))


@query(f"SELECT event_type AS stage, {COUNTS}, max(CAST(round(value) AS BIGINT)) AS max_input_tokens_per_call FROM events GROUP BY 1")
def usage_counters(t):
    """All counters of a stage, merged with those of an earlier snapshot."""
    v = F.round("value").cast("long")
    rows = t.events.select(F.col("event_type").alias("stage"), *((i + v % (i + 2)).alias(c) for i, c in enumerate(op.COUNTERS)), v.alias(op.LARGEST[0]), (F.col("event_id") % 3 == 0).alias("early"))
    merge = lambda df: op.merge_counters(df, ["stage"], [*op.COUNTERS], [*op.LARGEST])
    return merge(merge(rows.filter("early")).unionByName(merge(rows.filter("NOT early"))))


@query("SELECT event_id, round_even(CASE WHEN k % 5 = 0 THEN 0 ELSE len(list_filter(range(k % 5), lambda i: (i + event_id) % 2 = 0)) / (k % 5)::DOUBLE END, 6) AS faithfulness FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def claim_support(t):
    k = F.get_json_object("props", "$.k").cast("long")
    claims = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < k % 5), lambda i: F.struct(((i + F.col("event_id")) % 2 == 0).alias("supported")))
    return t.events.select("event_id", op.faithfulness(claims).alias("faithfulness"))


@query("""SELECT stage, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS largest FROM (SELECT event_type AS stage, 1 AS calls, CAST(round(value) AS BIGINT) AS tokens FROM events
UNION ALL SELECT 'judge', 1, CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events) GROUP BY 1""")
def stage_totals(t):
    row = lambda tokens: F.struct(F.lit(1).alias("calls"), tokens.alias("tokens"))
    stages = F.map_from_arrays(F.array(F.col("event_type"), F.lit("judge")), F.array(row(F.round("value").cast("long")), row(F.get_json_object("props", "$.k").cast("long"))))
    df = t.events.select(F.explode(stages).alias("stage", "c")).select("stage", "c.calls", "c.tokens", F.col("c.tokens").alias("largest"))
    return op.merge_counters(df, ["stage"], ["calls", "tokens"], ["largest"])


@query("SELECT event_type AS stage, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens, max(CAST(round(value) AS BIGINT)) AS largest FROM events GROUP BY 1")
def usage_merge(t):
    rows = t.events.select(F.col("event_type").alias("stage"), F.lit(1).cast("long").alias("calls"), F.round("value").cast("long").alias("tokens"), F.round("value").cast("long").alias("largest"), (F.col("event_id") % 2 == 0).alias("early"))
    merge = lambda df: op.merge_counters(df, ["stage"], ["calls", "tokens"], ["largest"])
    return merge(merge(rows.filter("early")).unionByName(merge(rows.filter("NOT early"))))


@query("""SELECT event_id, status, CASE WHEN status = 'calculated' THEN round_even((value * 2 + k * 8) / 1000000.0::DOUBLE, 8) END AS cost FROM (SELECT *, CASE WHEN value <= 1 THEN 'usage_not_reported' WHEN value > 200 THEN 'pricing_tier_exceeded' WHEN event_type = 'signup' THEN 'pricing_not_configured' ELSE 'calculated' END AS status
FROM (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""")
def cost_ladder(t):
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("long")
    tokens, price = F.when(v > 1, v), F.when(F.col("event_type") != "signup", F.lit(2.0))
    df = t.events.withColumn("status", op.cost_status(tokens, v, F.lit(200.0), price))
    return df.select("event_id", "status", op.cost(F.col("status"), v, k, F.lit(2.0), F.lit(8.0)).alias("cost"))


@query("SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(coalesce(sum(length(text)) FILTER (turn % 5 <> 4), 0) / 2.0) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def embedding_token_estimate(t):
    n = F.length("text")
    good = F.coalesce(F.sum(F.when(F.col("turn") % 5 != 4, n)), F.lit(0))
    return t.conversations.groupBy("role").agg(F.count("*").alias("calls"), F.sum(n).alias("chars"), op.estimated_tokens(good).alias("tokens"))


@query("SELECT (SELECT count(*) FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5 AND (event_id % 13 = 0 OR ts >= TIMESTAMP '2024-01-15')) AS kept, (SELECT count(*) FROM events WHERE event_id % 7 = 3 AND event_id % 11 <> 5) AS invalid")
def jsonl_invalid_lines(t):
    at = F.when(F.col("event_id") % 13 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    line = F.when(F.col("event_id") % 11 == 5, F.lit("  ")).when(F.col("event_id") % 7 == 3, F.lit("not-json")).otherwise(F.to_json(F.struct(at.alias("recorded_at"), F.col("event_id").alias("id"))))
    lines = t.events.select(line.alias("value"))
    good, bad = parsed_lines(lines, "recorded_at string, id long", "recorded_at", "2024-01-15T00:00:00Z")
    return good.agg(F.count("*").alias("kept")).crossJoin(bad.agg(F.count("*").alias("invalid")))
