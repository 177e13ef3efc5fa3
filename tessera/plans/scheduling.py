"""Scheduling queries: suppliers are technicians, line items their busy intervals."""

from pyspark.sql import functions as F

from tessera.operators import scheduling as op
from tessera.plans.base import query

B = "(SELECT l_suppkey AS id, l_shipdate AS start_time, l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS end_time, l_linestatus AS status, l_orderkey, l_linenumber FROM lineitem)"
START, END = "1998-03-05 00:00:00", "1998-03-07 00:00:00"


def busy(t):
    return t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("start_time"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("end_time"), F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber")


def people(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey", (F.col("s_acctbal") > 0).alias("enabled"))


def at(value):
    return F.lit(value).cast("timestamp_ntz")


BUSY = f"start_time < TIMESTAMP '{END}' AND end_time > TIMESTAMP '{START}'"


@query(f"SELECT s_suppkey AS id, s_name AS name FROM supplier s WHERE s_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM {B} b WHERE b.id = s.s_suppkey AND status = 'O' AND {BUSY}) AND NOT EXISTS (SELECT 1 FROM {B} b WHERE b.id = s.s_suppkey AND status = 'F' AND l_linenumber = 1 AND {BUSY})")
def available_technicians(t):
    b = busy(t)
    return op.available(people(t).filter("enabled"), [b.filter("status = 'O'"), b.filter("status = 'F' AND l_linenumber = 1")], "id", at(START), at(END)).select("id", "name")


@query(f"SELECT s_suppkey AS id FROM supplier s WHERE EXISTS (SELECT 1 FROM {B} b WHERE b.id = s.s_suppkey AND status = 'O' AND {BUSY})")
def busy_exists(t):
    return op.occupied(people(t), busy(t).filter("status = 'O'"), "id", at(START), at(END)).select("id")


@query(f"SELECT id, l_orderkey, l_linenumber FROM {B} WHERE start_time >= TIMESTAMP '1998-03-01' AND end_time < TIMESTAMP '1998-04-01'")
def day_schedule(t):
    return busy(t).filter((F.col("start_time") >= at("1998-03-01 00:00:00")) & (F.col("end_time") < at("1998-04-01 00:00:00"))).select("id", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, s AS slot_start FROM (SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + (1 + o_orderkey % 4) * INTERVAL 60 MINUTE - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS s FROM orders)")
def slot_explode(t):
    df = t.orders.withColumn("end", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (1 + F.col("o_orderkey") % 4).cast("int")))
    return op.slots(df, "o_orderdate", "end").select("o_orderkey", "slot_start")


@query("SELECT person, slot_start, count(*) AS n FROM (SELECT o_custkey % 10 AS person, unnest(generate_series(o_orderdate, o_orderdate + (1 + o_orderkey % 4) * INTERVAL 60 MINUTE - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS slot_start FROM orders) GROUP BY 1, 2 HAVING count(*) > 1")
def slot_conflicts(t):
    df = t.orders.select((F.col("o_custkey") % 10).alias("person"), "o_orderdate", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (1 + F.col("o_orderkey") % 4).cast("int"))).alias("end"))
    return op.slots(df, "o_orderdate", "end").groupBy("person", "slot_start").agg(F.count("*").alias("n")).filter("n > 1")


HOURS = f"""(SELECT s_suppkey AS id, unnest(generate_series(TIMESTAMP '1998-03-05 09:00:00', TIMESTAMP '1998-03-05 21:00:00', INTERVAL 1 HOUR)) AS slot FROM supplier)"""


@query(f"SELECT id, slot, rank FROM (SELECT id, slot, row_number() OVER (PARTITION BY id ORDER BY slot) AS rank FROM {HOURS} h WHERE NOT EXISTS (SELECT 1 FROM {B} b WHERE b.id = h.id AND l_linenumber = 1 AND b.start_time < h.slot + INTERVAL 1 HOUR AND b.end_time > h.slot)) WHERE rank <= 3")
def free_slots(t):
    return op.free_hours(people(t), busy(t).filter("l_linenumber = 1"), "id", "1998-03-05 00:00:00", 9, 21, 3).select("id", "slot", "rank")


@query(f"SELECT id, CAST(start_time AS DATE) AS day, count(*) AS n, string_agg(CAST(date_diff('day', start_time, end_time) AS VARCHAR), ',' ORDER BY end_time) AS spans FROM {B} GROUP BY 1, 2")
def busy_timeline(t):
    line = op.busy_timeline(busy(t), "id", "start_time", "end_time")
    days = F.transform("busy", lambda b: F.datediff(b["end_time"], b["start_time"]).cast("string"))
    return line.select("id", "day", F.size("busy").cast("long").alias("n"), F.array_join(days, ",").alias("spans"))


@query("""WITH s AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS day, l_shipdate + (l_orderkey % 9) * INTERVAL 1 HOUR AS start_time, CASE l_linestatus WHEN 'O' THEN 'busy' ELSE CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END END AS status, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem)
SELECT id, day, arg_min(row_id, (start_time, row_id)) FILTER (status = 'busy') AS completed_row, count(*) FILTER (status = 'completed') + CASE WHEN count(*) FILTER (status = 'busy') > 0 THEN 1 ELSE 0 END AS completed FROM s GROUP BY 1, 2""")
def complete_service(t):
    status = F.when(F.col("l_linestatus") == "O", "busy").when(F.col("l_returnflag") == "R", "cancelled").otherwise("completed")
    start = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 9).cast("int"))
    df = t.lineitem.select(F.col("l_suppkey").alias("id"), start.alias("start_time"), status.alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return op.completed_first(df, "id", "start_time", "status", "row_id")


@query("""SELECT o_orderkey, CASE WHEN s <= TIMESTAMP '1997-01-01' THEN 'START_IN_PAST' WHEN d < 30 OR d > 480 THEN 'DURATION_OUT_OF_RANGE' WHEN d % 30 <> 0 THEN 'DURATION_NOT_ON_GRID' WHEN minute(s) % 30 <> 0 OR second(s) <> 0 THEN 'START_NOT_ON_GRID' END AS error
FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 3) * INTERVAL 15 MINUTE + CASE WHEN o_orderkey % 7 = 0 THEN INTERVAL 30 SECOND ELSE INTERVAL 0 SECOND END AS s, o_custkey % 100 * 10 AS d FROM orders)""")
def booking_validate(t):
    s = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 3 * 15).cast("int"), F.when(F.col("o_orderkey") % 7 == 0, 30).otherwise(0).cast("decimal(18,6)"))
    return t.orders.select("o_orderkey", op.validation_error(s, F.col("o_custkey") % 100 * 10, at("1997-01-01 00:00:00")).alias("error"))


REQUESTS = "(SELECT o_orderkey, o_custkey % 50 AS person, o_orderdate + (o_custkey % 48) * INTERVAL 30 MINUTE AS s, 30 * (1 + o_orderkey % 4) AS d FROM orders)"


def requests(t):
    """Orders as booking requests of 30 to 120 minutes, which overlap in part."""
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 48 * 30).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("arrival"), (F.col("o_custkey") % 50).alias("person"), start.alias("start_time"), (30 * (1 + F.col("o_orderkey") % 4)).alias("minutes"), (F.col("o_orderkey") % 11).alias("again"), "o_custkey")


@query(f"""WITH RECURSIVE q AS (SELECT *, s + d * INTERVAL 1 MINUTE AS e, row_number() OVER (PARTITION BY person ORDER BY o_orderkey) AS r FROM {REQUESTS}),
w AS (SELECT person, r, o_orderkey, true AS accepted, [{{'s': s, 'e': e}}] AS held FROM q WHERE r = 1 UNION ALL
SELECT q.person, q.r, q.o_orderkey, len(list_filter(w.held, lambda x: x.s < q.e AND x.e > q.s)) = 0, CASE WHEN len(list_filter(w.held, lambda x: x.s < q.e AND x.e > q.s)) = 0 THEN list_append(w.held, {{'s': q.s, 'e': q.e}}) ELSE w.held END FROM w JOIN q ON q.person = w.person AND q.r = w.r + 1)
SELECT o_orderkey, accepted FROM w""")
def booking_resolve(t):
    df = requests(t).withColumn("end_time", F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes").cast("int")))
    return op.resolve(df, "person", "arrival", "start_time", "end_time").select(F.col("arrival").alias("o_orderkey"), "accepted")


@query(f"""WITH RECURSIVE a AS (SELECT o_orderkey, person, s, s + d * INTERVAL 1 MINUTE AS e, CASE WHEN o_orderkey % 97 = 0 THEN '  ' WHEN o_orderkey % 101 = 0 THEN repeat('x', 129) WHEN o_orderkey % 3 = 0 THEN 'again' || person || '-' || o_orderkey // 3000 ELSE 'own' || o_orderkey END AS k FROM {REQUESTS}),
c AS (SELECT o_orderkey, person, s, e, k, trim(k) = '' OR len(k) > 128 AS bad, CASE WHEN trim(k) = '' OR len(k) > 128 THEN 'INVALID' WHEN EXISTS (SELECT 1 FROM nation WHERE k = 'again' || n_nationkey || '-1') THEN 'REPLAY' WHEN s <= TIMESTAMP '1996-06-01' THEN 'INVALID' WHEN person >= 45 THEN 'NOT_FOUND' WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = person AND s < TIMESTAMP '1997-07-01' AND e > TIMESTAMP '1997-01-01') THEN 'CONFLICT' END AS o FROM a),
q AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY o_orderkey) AS r FROM c WHERE o IS NULL),
w AS (SELECT person, r, o_orderkey, k, true AS ok, [{{'s': s, 'e': e, 'k': k}}] AS held FROM q WHERE r = 1 UNION ALL
SELECT q.person, q.r, q.o_orderkey, q.k, len(list_filter(w.held, lambda x: x.k = q.k OR (x.s < q.e AND x.e > q.s))) = 0, CASE WHEN len(list_filter(w.held, lambda x: x.k = q.k OR (x.s < q.e AND x.e > q.s))) = 0 THEN list_append(w.held, {{'s': q.s, 'e': q.e, 'k': q.k}}) ELSE w.held END FROM w JOIN q ON q.person = w.person AND q.r = w.r + 1),
f AS (SELECT k, min(o_orderkey) AS first FROM w WHERE ok GROUP BY 1)
SELECT c.o_orderkey, CASE WHEN bad THEN 'INVALID' WHEN c.o = 'REPLAY' OR f.first < c.o_orderkey THEN 'REPLAY' WHEN c.o IS NOT NULL THEN c.o WHEN w.ok THEN 'CREATED' ELSE 'CONFLICT' END AS outcome, CASE WHEN NOT bad AND c.o IS DISTINCT FROM 'REPLAY' AND f.first < c.o_orderkey THEN f.first END AS replay_of FROM c LEFT JOIN f USING (k) LEFT JOIN w ON w.o_orderkey = c.o_orderkey""")
def booking_batch(t):
    """Blank and over-long keys, replays of bookings made earlier and in the batch (a key that was only refused is judged
    anew), invalid requests, unknown persons, times that are taken, and conflicts among the rest."""
    own = F.when(F.col("arrival") % 3 == 0, F.concat(F.lit("again"), F.col("person").cast("string"), F.lit("-"), F.floor(F.col("arrival") / 3000).cast("string"))).otherwise(F.concat(F.lit("own"), F.col("arrival").cast("string")))
    key = F.when(F.col("arrival") % 97 == 0, "  ").when(F.col("arrival") % 101 == 0, F.repeat(F.lit("x"), 129)).otherwise(own)
    df = requests(t).withColumn("request_key", key)
    staff = t.spark.range(50).select(F.col("id").alias("person"), (F.col("id") < 45).alias("enabled"))
    busy = t.nation.select(F.col("n_nationkey").cast("long").alias("person"), at("1997-01-01 00:00:00").alias("start_time"), at("1997-07-01 00:00:00").alias("end_time"))
    earlier = t.nation.select(F.concat(F.lit("again"), F.col("n_nationkey").cast("string"), F.lit("-1")).alias("key"), F.col("n_nationkey").alias("booking"))
    return op.booked(df, staff, [busy], at("1996-06-01 00:00:00"), earlier=earlier).select(F.col("arrival").alias("o_orderkey"), "outcome", "replay_of")


KEY = "sha256(o_orderpriority || '|' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '|' || strftime(o_orderdate + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S'))"


@query(f"SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY {KEY}) AS replay_of, {KEY} AS idempotency_key FROM orders")
def idempotent_booking(t):
    key = op.request_key(F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES"))
    return op.first_of_key(t.orders.withColumn("idempotency_key", key), "idempotency_key", "o_orderkey").select("o_orderkey", "replay_of", "idempotency_key")


@query("SELECT o_orderkey, 'APT' || strftime(o_orderdate, '%Y%m%d') || upper(sha256(CAST(o_orderkey AS VARCHAR))[1:12]) AS appointment_no FROM orders")
def appointment_numbers(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("APT"), F.date_format("o_orderdate", "yyyyMMdd"), F.upper(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12))).alias("appointment_no"))


FREE = f"(SELECT s_suppkey AS id, s_nationkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM {B} b WHERE b.id = s.s_suppkey AND l_linenumber = 1 AND {BUSY}))"


@query(f"SELECT c_custkey, coalesce(n.id, (SELECT min(id) FROM {FREE})) AS id, n.id IS NOT NULL AS preferred FROM customer LEFT JOIN (SELECT s_nationkey, min(id) AS id FROM {FREE} GROUP BY 1) n ON n.s_nationkey = c_nationkey")
def preference_match(t):
    """For each customer the first free supplier of the same nation, else the first free one of all."""
    free = op.available(people(t), [busy(t).filter("l_linenumber = 1")], "id", at(START), at(END))
    own = op.best_choice(free, "s_nationkey", "id", F.lit(0), F.col("id"))
    any_ = free.agg(F.min("id").alias("any_id"))  # one row
    both = t.customer.join(own, F.col("s_nationkey") == F.col("c_nationkey"), "left").crossJoin(F.broadcast(any_))
    return both.select("c_custkey", F.coalesce("id", "any_id").alias("id"), F.col("id").isNotNull().alias("preferred"))


@query(f"SELECT id FROM {FREE} WHERE s_nationkey % 2 = 0 ORDER BY CASE WHEN id % 5 = 3 THEN 0 ELSE 1 END, id LIMIT 5")
def preferred_technicians(t):
    """By gender, then free, then those with the preferred strength first."""
    df = people(t).withColumn("gender", F.when(F.col("s_nationkey") % 2 == 0, "女").otherwise("男"))
    free = op.available(df, [busy(t).filter("l_linenumber = 1")], "id", at(START), at(END))
    return op.preferred(df, free, "id", "gender", "女技师", F.col("id") % 5 == 3, F.col("id"), 5).select("id")


@query(f"SELECT s_suppkey AS id FROM supplier s WHERE s_acctbal > 0 AND s_nationkey % 2 = 1 AND s_suppkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM {B} b WHERE b.id = s.s_suppkey AND l_linenumber = 1 AND start_time < TIMESTAMP '1998-03-05 15:30:00' AND end_time > TIMESTAMP '1998-03-05 14:00:00')")
def technician_search(t):
    df = people(t).withColumn("gender", F.when(F.col("s_nationkey") % 2 == 0, "女").otherwise("男")).withColumn("strength", F.element_at(F.array(F.lit("light"), F.lit("medium"), F.lit("strong")), (F.col("id") % 3 + 1).cast("int")))
    return op.searched(df, [busy(t).filter("l_linenumber = 1")], "id", at("1998-03-05 14:00:00"), F.lit(90), "男", "medium").select("id")


SLOTS = "SELECT id, slot, row_number() OVER (PARTITION BY id ORDER BY slot) AS rank FROM (SELECT s_suppkey AS id, unnest(generate_series(TIMESTAMP '{0}', TIMESTAMP '{1}', INTERVAL 1 HOUR)) AS slot FROM supplier) h WHERE NOT EXISTS (SELECT 1 FROM {2} b WHERE b.id = h.id AND l_linenumber <= 3 AND b.start_time < h.slot + INTERVAL 60 MINUTE AND b.end_time > h.slot)"
TODAY, AFTER = SLOTS.format("1998-03-05 17:00:00", "1998-03-05 21:00:00", B), SLOTS.format("1998-03-06 09:00:00", "1998-03-06 21:00:00", B)


@query(f"WITH a AS ({TODAY}), b AS ({AFTER}) SELECT id, slot, rank, false AS tomorrow FROM a UNION ALL SELECT id, slot, rank, true FROM b WHERE rank <= 3 AND id NOT IN (SELECT id FROM a)")
def slot_proposals(t):
    """Asked at 16:20: today from 17:00 on; tomorrow's first three for those without."""
    return op.proposed(people(t), busy(t).filter("l_linenumber <= 3"), "id", "1998-03-05 16:20:00").select("id", "slot", "rank", "tomorrow")


@query("SELECT o_orderkey, strftime(o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR + INTERVAL 8 HOUR, '%H:%M') AS local_clock, CAST(trunc(date_diff('second', o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR, o_orderdate + (o_custkey % 100) * INTERVAL 90 SECOND) / 60.0) AS BIGINT) AS minutes FROM orders")
def local_clock(t):
    utc = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    to = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_custkey") % 100 * 90).cast("decimal(18,6)"))
    return t.orders.select("o_orderkey", op.clock(op.local_time(utc)).alias("local_clock"), op.minutes_between(utc, to).alias("minutes"))


@query("""WITH day AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS day, l_shipdate + (l_orderkey % 9) * INTERVAL 1 HOUR AS s, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem),
old AS (SELECT id, day, list(s ORDER BY s, r) AS held FROM day WHERE r > 1 GROUP BY 1, 2), one AS (SELECT id, day, s FROM day WHERE r = 1)
SELECT id, day, CASE WHEN list_contains(coalesce(held, []), s) THEN len(held) ELSE coalesce(len(held), 0) + 1 END AS held, len(list_filter(coalesce(held, []), lambda x: x <> s)) AS left_ FROM one LEFT JOIN old USING (id, day)""")
def busy_lists(t):
    """For each supplier and day, its first item's interval is added to the list of the others, unless it is there, and all of its start removed."""
    start = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 9).cast("int"))
    df = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.struct(start.alias("start"), (start + F.expr("INTERVAL 1 HOUR")).alias("end")).alias("b"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    first = df.groupBy("id", "day").agg(F.min(F.struct("at", "b")).alias("f"))
    both = df.join(first, ["id", "day"]).groupBy("id", "day", "f").agg(F.collect_list(F.when(F.col("at") != F.col("f.at"), F.col("b"))).alias("held"))  # a day of one supplier
    more = op.with_busy(F.col("held"), F.col("f.b.start"), F.col("f.b.end"))
    return both.select("id", "day", F.size(more).cast("long").alias("held"), F.size(op.without_busy(more, F.col("f.b.start"))).cast("long").alias("left_"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 2 = 0")
def gender_filtered(t):
    df = people(t).withColumn("gender", F.when(F.col("s_nationkey") % 2 == 0, "女").otherwise("男"))
    return op.gender_filter(df, "gender", "Female").select("id")


@query("SELECT o_orderkey, hour(o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR) BETWEEN 12 AND 21 AS in_hours FROM orders")
def business_hours(t):
    return t.orders.select("o_orderkey", op.in_hours(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int")), 12, 21).alias("in_hours"))


@query(f"SELECT count(*) AS slots, count(*) FILTER (status = 'O') AS busy FROM {B}")
def schedule_totals(t):
    return busy(t).agg(F.count("*").alias("slots"), F.count_if(F.col("status") == "O").alias("busy"))
