"""Behaviour queries over events and customers."""

from pyspark.sql import functions as F

from tessera.operators import behaviour as op
from tessera.plans.base import ASOF, query

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def service(df):
    """The JSON payload's number as the entity a user chose."""
    return df.withColumn("service", F.get_json_object("props", "$.k").cast("long"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS appointments, count(*) FILTER (event_type = 'view') AS consultations FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY GROUP BY 1")
def user_stats(t):
    return op.activity_counts(op.within_days(t.events, "ts", ASOF, 30), "user_id", "event_type", {"appointments": "purchase", "consultations": "view"})


@query(f"SELECT user_id, service, n FROM (SELECT user_id, {K} AS service, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {K}) AS r FROM events WHERE event_type = 'purchase' AND {K} IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def favorite_entity(t):
    return op.favourite(service(t.events.filter("event_type = 'purchase'")), "user_id", "service")


@query(f"SELECT {K} AS service, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' GROUP BY 1")
def popularity(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    return op.popularity(service(t.events.filter("event_type = 'purchase'")).join(users, "user_id"), "service", "user_id")


@query("SELECT event_id, event_type, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment = 'BUILDING' WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY")
def behaviors_with_names(t):
    names = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return op.within_days(t.events, "ts", ASOF, 7).join(names, "user_id", "left").select("event_id", "event_type", "name")


@query("""SELECT user_id, n, round(avg_days, 6) AS avg_days, CASE WHEN n < 2 THEN 'insufficient_data' WHEN avg_days < 7 THEN 'very_frequent' WHEN avg_days < 14 THEN 'frequent' WHEN avg_days < 30 THEN 'regular' ELSE 'occasional' END AS label
FROM (SELECT user_id, count(*) AS n, avg(floor((epoch_us(ts) - epoch_us(p)) / 86400000000.0)) AS avg_days FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase') GROUP BY 1)""")
def cadence(t):
    return op.cadence(t.events.filter("event_type = 'purchase'"), "user_id", "ts", "event_id").withColumn("avg_days", F.round("avg_days", 6))


@query("SELECT user_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL")
def time_histogram(t):
    return t.events.groupBy("user_id", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS h, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(h || '=' || n, ',' ORDER BY CAST(h AS VARCHAR)) AS counts, arg_min(h, (-n, f)) AS mode FROM e GROUP BY 1""")
def hour_histogram(t):
    own = op.histogram(t.events, "user_id", F.hour("ts"), "ts", "event_id")
    return own.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"), "mode")


@query("""WITH d AS (SELECT user_id, ts, 'service' AS dimension, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT user_id, ts, 'kind', event_type FROM events UNION ALL SELECT user_id, ts, 'weekday', CAST(isodow(ts) - 1 AS VARCHAR) FROM events)
SELECT user_id, dimension, value, n FROM (SELECT user_id, dimension, value, count(*) AS n, row_number() OVER (PARTITION BY user_id, dimension ORDER BY count(*) DESC, max(ts) DESC, value) AS r FROM d GROUP BY 1, 2, 3) WHERE r = 1""")
def modes_by_dimension(t):
    """The favourite of each user in three dimensions."""
    parts = (("service", F.get_json_object("props", "$.k")), ("kind", F.col("event_type")), ("weekday", F.weekday("ts").cast("string")))
    out = [op.recent_mode(t.events.withColumn("value", v), "user_id", "value", "ts").select("user_id", F.lit(name).alias("dimension"), "value", "n") for name, v in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


MODE = f"""SELECT user_id, service, n FROM (SELECT user_id, {K} AS service, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(ts) DESC, {K}) AS r
FROM events WHERE event_type = 'purchase' AND {K} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= $least) WHERE r = 1"""


@query(MODE.replace("$least", "1"))
def mode_by_dimension(t):
    return op.recent_mode(service(t.events.filter("event_type = 'purchase'")), "user_id", "service", "ts")


@query(MODE.replace("$least", "2"))
def repeated_mode(t):
    return op.recent_mode(service(t.events.filter("event_type = 'purchase'")), "user_id", "service", "ts", 2)


@query("""SELECT c_custkey AS user_id, count(event_id) AS total, CASE WHEN count(event_id) = 0 THEN 'no_data' WHEN count(*) FILTER (event_type = 'purchase') > 2 THEN 'active_user' ELSE 'occasional_user' END AS label
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def pattern_label(t):
    counts = op.activity_counts(t.events, "user_id", "event_type", {"appointments": "purchase"})
    out = t.customer.select(F.col("c_custkey").alias("user_id")).join(counts, "user_id", "left").fillna(0, ["total", "appointments"])
    return out.select("user_id", "total", op.activity_label(F.col("appointments"), F.col("total")).alias("label"))


@query(f"SELECT user_id, event_type AS kind, {K} AS value, CAST(sum(greatest(1, CAST(trunc(value) AS BIGINT))) AS BIGINT) AS confidence FROM events GROUP BY 1, 2, 3")
def preference_confidence(t):
    df = t.events.select("user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("value"), F.col("value").alias("c"))
    return op.preference_confidence(df, ["user_id", "kind", "value"], "c")


@query("SELECT user_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN '上午' WHEN hour(ts) BETWEEN 12 AND 17 THEN '下午' ELSE '晚上' END AS period, count(*) AS confidence FROM events GROUP BY 1, 2")
def preference_periods(t):
    df = t.events.select("user_id", op.day_period(F.col("ts")).alias("period"), F.lit(1).alias("c"))
    return op.preference_confidence(df, ["user_id", "period"], "c")


@query(f"""SELECT user_id, value, confidence, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, value) AS r FROM
(SELECT user_id, {K} AS value, count(*) AS confidence FROM events GROUP BY 1, 2)) WHERE r <= 5""")
def top_preferences(t):
    df = op.preference_confidence(service(t.events).select("user_id", F.col("service").alias("value"), F.lit(1).alias("c")), ["user_id", "value"], "c")
    return op.top_per_key(df, ["user_id"], [F.desc("confidence"), F.asc("value")], 5)


@query("""SELECT user_id, n, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(l)) / 86400000000.0) AS BIGINT) AS days_since,
n >= 2 AND floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(l)) / 86400000000.0) >= 30 AS remind FROM (SELECT user_id, count(*) AS n, max(ts) AS l FROM events WHERE event_type = 'purchase' GROUP BY 1)""")
def return_reminder(t):
    return op.return_reminder(t.events.filter("event_type = 'purchase'"), "user_id", "ts", ASOF)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_behaviors(t):
    return t.events.orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "user_id", "event_type")
