"""Session and stream queries over conversations and events."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import sessions as op
from tessera.plans.base import query
from tessera.session import shared_folder
from tessera.streaming import state

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_n_messages(t):
    return op.last_messages(t.conversations, "conv_id", "turn", 4).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN turn > 2 AND conv_id % 2 = 0 THEN 'appointment' ELSE CASE WHEN conv_id % 3 = 0 THEN 'consultation' ELSE 'other' END END AS agent FROM conversations")
def sticky_route(t):
    active = F.when((F.col("turn") > 2) & (F.col("conv_id") % 2 == 0), "appointment")
    return t.conversations.select("conv_id", "turn", op.intent_route(active, F.when(F.col("conv_id") % 3 == 0, "consultation").otherwise("chat")).alias("agent"))


DRAFT = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'p' || turn WHEN turn % 3 = 1 THEN '未知' END AS project, CASE WHEN turn % 2 = 1 THEN '60分钟' END AS duration FROM conversations)"


def draft(t):
    project = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("p"), F.col("turn").cast("string"))).when(F.col("turn") % 3 == 1, "未知")
    df = t.conversations.select("conv_id", "turn", project.alias("project"), F.when(F.col("turn") % 2 == 1, "60分钟").alias("duration"))
    return op.merged_draft(df, "conv_id", "turn", ["project", "duration"])


@query(f"SELECT conv_id, arg_max(project, turn) FILTER (project <> '未知') AS project, arg_max(duration, turn) FILTER (duration IS NOT NULL) AS duration FROM {DRAFT} GROUP BY 1")
def draft_merge(t):
    return draft(t)


@query(f"SELECT conv_id, 'start_time' || CASE WHEN p IS NULL THEN ',project' ELSE '' END || CASE WHEN d IS NULL THEN ',duration' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN ',gender' ELSE '' END AS missing FROM (SELECT conv_id, arg_max(project, turn) FILTER (project <> '未知') AS p, arg_max(duration, turn) FILTER (duration IS NOT NULL) AS d FROM {DRAFT} GROUP BY 1)")
def missing_fields(t):
    df = draft(t).withColumn("start_time", F.lit("无")).withColumn("technician_name", F.when(F.col("conv_id") % 2 == 1, "x")).withColumn("gender", F.lit(None).cast("string"))
    return df.select("conv_id", F.array_join(op.missing_fields(), ",").alias("missing"))


@query("SELECT event_id, CASE k % 5 WHEN 0 THEN k % 2 = 0 WHEN 1 THEN k % 2 = 0 WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS valid FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def payload_validation(t):
    """Of appointments, consultations, no kind at all (null or empty) and other kinds."""
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("q").alias("query"), F.lit("10:00").alias("start_time"), F.lit(60).alias("duration")))).otherwise('{"start_time": "10:00"}')
    kind = F.when(k % 5 == 0, "appointment").when(k % 5 == 1, "consultation").when(k % 5 == 2, F.lit(None).cast("string")).when(k % 5 == 3, "").otherwise("analysis")
    return t.events.select("event_id", op.payload_valid(kind, payload).alias("valid"))


@query("""SELECT conv_id, CAST(count(*) + 2 AS BIGINT) AS messages, sha256(string_agg(coalesce(text, ''), '|' ORDER BY turn) || '|a|b') AS held, sha256(coalesce(string_agg(coalesce(text, ''), '|' ORDER BY turn) FILTER (r > 3) || '|', '') || 'a|b') AS new
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1""")
def conversation_state(t):
    """The append reducer over a conversation, and what came after the first three messages (or all, if they are fewer)."""
    held = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda m: m["text"]).alias("held"))  # a conversation's messages
    state_ = op.appended(F.col("held"), F.array(F.lit("a"), F.lit("b")))
    text = lambda c: F.sha2(F.array_join(c, "|"), 256)
    return held.select("conv_id", F.size(state_).cast("long").alias("messages"), text(state_).alias("held"), text(op.unseen(state_, F.least(F.size("held"), F.lit(3)))).alias("new"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Ann' END AS name, CAST(CASE turn % 4 WHEN 0 THEN 45 WHEN 1 THEN 90 WHEN 2 THEN 60 END AS BIGINT) AS minutes FROM conversations")
def entity_names(t):
    i = F.col("turn") % 4
    text = F.when(i == 0, "Ann please").when(i == 1, "with Bo").when(i == 2, "Bo or Ann").otherwise("anyone")
    given = F.when(i == 0, '{"minutes": 45}').when(i == 1, '{"hours": 1.5}').when(i == 2, "1小时").otherwise("soon")
    return t.conversations.select("conv_id", "turn", op.technician_name(text, ["Ann", "Bo"]).alias("name"), op.duration_of(given).alias("minutes"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 90 WHEN turn % 4 = 1 THEN 120 WHEN turn % 4 = 2 THEN NULL ELSE turn END AS minutes, CASE WHEN turn % 4 = 0 THEN 90 WHEN turn % 4 = 1 THEN 2 WHEN turn % 4 = 2 THEN NULL ELSE turn END AS digits FROM conversations")
def duration_normalize(t):
    text = F.when(F.col("turn") % 4 == 0, "90分钟").when(F.col("turn") % 4 == 1, "2小时").when(F.col("turn") % 4 == 2, "未知").otherwise(F.concat(F.lit("大约"), F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn", op.duration_minutes(text).alias("minutes"), op.all_digits(text).alias("digits"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '未知' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS start_time FROM orders")
def datetime_normalize(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+08:00'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("明天下午")
    return t.orders.select("o_orderkey", op.start_minute(text).alias("start_time"))


@query("SELECT conv_id, turn, CAST([80, 100, 120, 90][turn % 4 + 1] AS BIGINT) AS price, turn AS technician, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false END AS consent FROM conversations")
def entity_price(t):
    i = F.col("turn") % 4
    text = F.concat(F.col("turn").cast("string"), F.lit("号技师 "), F.when(i == 0, "肩颈按摩").when(i == 1, "足底推拿").when(i == 2, "按摩").otherwise("背部按摩"))
    answer = F.when(i == 0, "好的").when(i == 1, "不好").when(i == 2, "嗯").otherwise("No")
    return t.conversations.select("conv_id", "turn", op.service_price(text).cast("long").alias("price"), op.technician_number(text).alias("technician"), op.confirmation(answer).alias("consent"))


@query("SELECT conv_id, turn, text AS reply, len(text) AS thought FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)")
def stream_protocol(t):
    raw = F.concat(F.lit("[THOUGHT][a]"), F.col("text"), F.lit("[REPLY][b]"), F.col("text"), F.lit("[SOURCES][]"), F.lit("[REP"))
    df = op.with_parsed_stream(t.conversations.select("conv_id", "turn", raw.alias("raw")), "raw")
    return df.select("conv_id", "turn", F.col("parsed.reply").alias("reply"), F.length(F.get("parsed.thoughts", 0)["content"]).cast("long").alias("thought"))


ANCHORED = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), w AS (
SELECT event_id, user_id, ts, r, ts AS opened, 1 AS n FROM e WHERE r = 1 UNION ALL
SELECT e.event_id, e.user_id, e.ts, e.r, CASE WHEN e.ts >= w.opened + $span THEN e.ts ELSE w.opened END, CASE WHEN e.ts >= w.opened + $span THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)"""


@query(ANCHORED.replace("$span", "INTERVAL 12 HOUR") + " SELECT event_id, opened AS window_start, CAST(n AS BIGINT) AS n, n <= 2 AS allowed FROM w")
def rate_limit_anchored(t):
    return op.anchored_windows(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 12 * 3600, 2).select("event_id", "window_start", "n", "allowed")


@query(ANCHORED.replace("$span", "INTERVAL 24 HOUR") + " SELECT event_id, n > 1 AS duplicate FROM w")
def idempotent_first(t):
    return op.anchored_windows(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400).select("event_id", (F.col("n") > 1).alias("duplicate"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def rate_limit_tumbling(t):
    return t.events.groupBy("user_id", F.window("ts", "1 hour")["start"].alias("start")).agg(F.count("*").alias("n"), (F.count("*") > 2).alias("limited"))


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN ts - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2""")
def session_ttl(t):
    return op.sessions(t.events, "user_id", "ts", "event_id", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


def stream(t):
    return state.read_events(t.spark, t.folder, "events.parquet", EVENTS, "ts")


def once(df, mode):
    return state.run_once(df, mode, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}")


def keyed(t):
    return stream(t).select(F.col("event_id").alias("id"), "user_id", "ts")


@query(ANCHORED.replace("$span", "INTERVAL 12 HOUR") + " SELECT event_id, CAST(n AS BIGINT) AS n, n <= 2 AS allowed FROM w")
def stream_rate_limit(t):
    """rate_limit_anchored() as a stream whose keys are forgotten after their span."""
    return once(state.rate_limited(keyed(t), "user_id", "ts", "2 days", 12 * 3600, 2), "append").select(F.col("id").alias("event_id"), "n", "allowed")


@query(ANCHORED.replace("$span", "INTERVAL 24 HOUR") + " SELECT event_id, n > 1 AS duplicate FROM w")
def stream_idempotent(t):
    """idempotent_first() as a stream: a submission is known for a day after the first."""
    return once(state.rate_limited(keyed(t), "user_id", "ts", "2 days", 86400), "append").select(F.col("id").alias("event_id"), (F.col("n") > 1).alias("duplicate"))


@query("""SELECT user_id, opened, n FROM (SELECT user_id, session, min(ts) AS opened, max(ts) AS last, count(*) AS n, lead(min(ts)) OVER (PARTITION BY user_id ORDER BY session) AS after FROM (SELECT *, sum(CASE WHEN ts - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, session) WHERE after IS NOT NULL OR last + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_sessions(t):
    """session_ttl() as a stream: a session is written when its time to live has passed, by an event or by the watermark."""
    return once(state.expired_sessions(keyed(t), "user_id", "ts", 3600, "2 days"), "append").select(F.col("key").alias("user_id"), F.col("opened").cast("timestamp_ntz").alias("opened"), "n")


@query("SELECT conv_id, coalesce(arg_max(CASE WHEN turn % 3 = 1 THEN role || turn END, turn) FILTER (turn % 3 = 1), 'none') AS agent, count(*) AS messages, count(*) FILTER (later OR NOT more) AS new FROM (SELECT *, turn >= 3 AS later, max(turn) OVER (PARTITION BY conv_id) >= 3 AS more FROM conversations) GROUP BY 1")
def stream_conversations(t):
    """Conversations whose first three turns and whose others come in two runs; the second goes on from the checkpoint."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    df = t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.when(F.col("turn") % 3 == 1, F.concat("role", F.col("turn").cast("string"))).alias("agent"))
    for part in (df.filter("turn < 3"), df.filter("turn >= 3")):
        part.write.mode("append").parquet(f"{folder}/in")
        got = state.run_once(state.conversations(t.spark.readStream.schema(df.schema).parquet(f"{folder}/in"), "conv_id"), "update", folder, "key")
    return got.select(F.col("key").cast("long").alias("conv_id"), F.coalesce("agent", F.lit("none")).alias("agent"), "messages", "new")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_usage_by_stage(t):
    return once(state.counts_by(stream(t), ["event_type"], "value"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    return once(state.windowed(stream(t), "ts", ["event_type"], "1 hour"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_closed_windows(t):
    """Windows that the watermark, two days behind the newest event, has closed; each is written once."""
    return once(state.windowed(stream(t), "ts", ["event_type"], "1 hour", "2 days"), "append")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def stream_tail(t):
    return once(stream(t).filter("ts >= TIMESTAMP '2024-01-15 00:00:00'").select("event_id", "user_id"), "append")


@query("SELECT conv_id, turn, replace(conv_id || ':' || turn, ':', '_') AS key, regexp_matches(role || '-0123456789abcdef', '^[A-Za-z0-9_-]{16,64}$') AS valid FROM conversations")
def session_keys(t):
    own = F.concat("role", F.lit("-0123456789abcdef"))
    return t.conversations.select("conv_id", "turn", op.key_part(F.concat_ws(":", "conv_id", "turn")).alias("key"), (op.session_id(F.lit("short"), own) == own).alias("valid"))
