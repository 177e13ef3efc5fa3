"""Scheduling over half-open intervals: availability, slots, conflicts, booking, proposals."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import overlap
from tessera.session import checkpointed

HALF_HOUR = 30


def available(people: DataFrame, busy: list[DataFrame], key: str, start: Column, end: Column) -> DataFrame:
    """Those without an overlapping interval in any busy table (key, start_time, end_time): anti joins on the
    key with the range as residual. Rows that can't overlap are filtered out before the join."""
    for b in busy:
        people = people.join(b.filter(overlap(F.col("start_time"), F.col("end_time"), start, end)).select(key), key, "left_anti")
    return people


def occupied(people: DataFrame, busy: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    return people.join(busy.filter(overlap(F.col("start_time"), F.col("end_time"), start, end)).select(key), key, "left_semi")


def searched(people: DataFrame, busy: list[DataFrame], key: str, start: Column, minutes: Column, gender: str | None = None, strength: str | None = None) -> DataFrame:
    """Enabled people who are free for so long from start, of a gender and strength where these are given."""
    own = people.filter("enabled")
    for column, wanted in (("gender", gender), ("strength", strength)):
        own = own.filter(F.col(column) == wanted) if wanted else own
    return available(own, busy, key, start, start + F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, cut towards zero."""
    return ((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000).cast("long")


def in_hours(ts: Column, first: int = 12, last: int = 21) -> Column:
    return F.hour(ts).between(first, last)


def local_time(utc: Column, zone: str = "+08:00") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def slots(df: DataFrame, start: str, end: str, minutes: int = HALF_HOUR) -> DataFrame:
    """A row for each slot of the grid that an interval covers."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return df.filter(F.col(start) < F.col(end)).withColumn("slot_start", F.explode(F.sequence(F.col(start), F.col(end) - step, step)))


def validation_error(start: Column, minutes: Column, now: Column) -> Column:
    """Code of the first rule that a request breaks; null for a valid one."""
    return (
        F.when(start.isNull() | (start <= now), "START_IN_PAST")
        .when((minutes < 30) | (minutes > 480) | minutes.isNull(), "DURATION_OUT_OF_RANGE")
        .when(minutes % 30 != 0, "DURATION_NOT_ON_GRID")
        .when((F.minute(start) % 30 != 0) | (F.unix_micros(start.cast("timestamp")) % 60_000_000 != 0), "START_NOT_ON_GRID")
    )


def first_of_key(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Idempotency over the whole table: later requests with a key replay the first."""
    return requests.withColumn("replay_of", F.first(order).over(Window.partitionBy(key).orderBy(order))).withColumn("is_replay", F.col("replay_of") != F.col(order))


def request_key(session: Column, person: Column, start: Column, end: Column) -> Column:
    """Idempotency key of a booking."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.sha2(F.concat_ws("|", session, person.cast("string"), iso(start), iso(end)), 256)


def key_error(key: Column, longest: int = 128) -> Column:
    """Code of a request without a usable idempotency key; null for a usable one."""
    return F.when(key.isNull() | key.rlike(r"^\p{javaWhitespace}*$") | (F.length(trimmed(key)) > longest), "INVALID_IDEMPOTENCY_KEY")


def trimmed(key: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(key, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def booked(requests: DataFrame, people: DataFrame, busy: list[DataFrame], now: Column, key: str = "request_key", person: str = "person", order: str = "arrival", start: str = "start_time", minutes: str = "minutes", earlier: DataFrame | None = None) -> DataFrame:
    """The outcome of a batch of bookings: (order, outcome, error, replay_of, booking).

    Keys are trimmed; a blank, missing or over-long one is INVALID. Only a booking that was made keeps its key: a
    request is a REPLAY if its key is in `earlier` (key, booking), or of an accepted request before it in the batch;
    one whose key was only refused so far is judged anew. It is INVALID by validation_error(), NOT_FOUND where the
    person is unknown or not enabled, a CONFLICT where it overlaps an interval of `busy` or a request accepted
    before it, else CREATED; a request that isn't accepted blocks nothing.

    Persons are worked on apart. A key that names several persons couples them, so what its acceptance changes
    elsewhere is found by repeating the pass over the persons that such keys name until nothing changes: each
    decision depends on earlier ones only, so the result is that of one pass in order of arrival."""
    end = F.col(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.col(minutes).cast("int"))
    df = requests.withColumn("_key", trimmed(F.col(key))).withColumn("_bad", key_error(F.col(key))).withColumn("error", F.coalesce("_bad", validation_error(F.col(start), F.col(minutes), now))).withColumn("end_time", end)
    known = people.filter("enabled").select(F.col(person).alias("_person")).distinct().withColumn("_known", F.lit(True))
    df = df.join(known, F.col(person) == F.col("_person"), "left")
    if earlier is None:
        df = df.withColumn("_replay", F.lit(False)).withColumn("booking", F.lit(None).cast("string"))
    else:
        before = earlier.select(trimmed(F.col("key")).alias("_earlier"), F.col("booking").cast("string").alias("booking")).groupBy("_earlier").agg(F.min("booking").alias("booking"))
        df = df.join(before, F.col("_bad").isNull() & (F.col("_key") == F.col("_earlier")), "left").withColumn("_replay", F.col("_earlier").isNotNull())
    taken = F.lit(False)
    for k, b in enumerate(busy):
        times = b.select(F.col(person).alias("_p"), F.col("start_time").alias("_s"), F.col("end_time").alias("_e"))
        hits = df.join(times, (F.col(person) == F.col("_p")) & overlap(F.col("_s"), F.col("_e"), F.col(start), F.col("end_time"))).select(F.col(order).alias(f"_hit{k}")).distinct()
        df = df.join(hits, F.col(order) == F.col(f"_hit{k}"), "left")
        taken = taken | F.col(f"_hit{k}").isNotNull()
    early = F.when(F.col("_replay"), "REPLAY").when(F.col("error").isNotNull(), "INVALID").when(F.col("_known").isNull(), "NOT_FOUND").when(taken, "CONFLICT")
    df = checkpointed(df.withColumn("outcome", early).select(order, person, start, "end_time", "outcome", "error", "booking", "_key", "_bad"))
    asked = df.filter("outcome IS NULL").select(order, person, start, "end_time", "_key")
    couples = checkpointed(asked.groupBy("_key").agg(F.min(person) != F.max(person)).toDF("_key", "_several").filter("_several").select("_key"))
    if couples.isEmpty():
        ok = checkpointed(resolve(asked, person, order, start, "end_time", "_key").filter("accepted").select(order, "_key"))
    else:
        touched = asked.join(couples, "_key", "left_semi").select(person).distinct()
        alone = resolve(asked.join(touched, person, "left_anti"), person, order, start, "end_time", "_key")
        alone = alone.filter("accepted").select(order, "_key")
        some = checkpointed(asked.join(touched, person, "left_semi"))
        facts = some.sparkSession.createDataFrame([], f"_key string, _since {some.schema[order].dataType.simpleString()}")
        while True:
            passed = checkpointed(resolve(some.join(facts, "_key", "left"), person, order, start, "end_time", "_key", "_since").filter("accepted").select(order, "_key"))
            new = checkpointed(passed.join(couples, "_key", "left_semi").groupBy("_key").agg(F.min(order).alias("_since")))
            same = new.join(facts, ["_key", "_since"], "left_anti").isEmpty() and facts.join(new, ["_key", "_since"], "left_anti").isEmpty()
            facts = new
            if same:
                break
        ok = alone.unionByName(passed)
    first = ok.groupBy("_key").agg(F.min(order).alias("_first"))
    made = ok.select(F.col(order).alias("_made"))
    df = df.join(first, F.col("_bad").isNull() & df["_key"].eqNullSafe(first["_key"]), "left").drop(first["_key"]).join(made, F.col(order) == F.col("_made"), "left")
    again = F.col("_first") < F.col(order)
    outcome = F.when(F.col("outcome") == "REPLAY", "REPLAY").when(again, "REPLAY").when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("_made").isNotNull(), "CREATED").otherwise("CONFLICT")
    replayed = outcome == "REPLAY"
    return df.select(order, outcome.alias("outcome"), F.when(~replayed, F.col("error")).alias("error"), F.when(again & F.col("booking").isNull(), F.col("_first")).alias("replay_of"), "booking")


def resolve(requests: DataFrame, person: str, order: str, start: str, end: str, key: str | None = None, since: str | None = None) -> DataFrame:
    """First writer wins, in order of arrival, for each person: a request is accepted unless it overlaps one
    accepted before it. Sequential by nature: a rejected request doesn't block later ones. Adds `accepted`.
    With a key, a request isn't accepted after one of its key was, of the same person or, by the order in `since`, of
    another. One person's requests of a batch meet in one task, streamed in sorted order: accepted intervals are kept
    sorted, so each request costs a binary search; a task holds one person's accepted intervals (and their keys), which
    can't overlap and so are bounded by the time that bookings may reach ahead."""
    import bisect

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, starts, ends, keys = None, [], [], set()
        for pdf in groups:
            accepted = []
            own = pdf[key] if key else [None] * len(pdf)
            barred = pdf[since].notna() & (pdf[since] < pdf[order]) if since else [False] * len(pdf)
            for who, s, e, k, bar in zip(pdf[person], pdf[start], pdf[end], own, barred):
                if who != last:
                    last, starts, ends, keys = who, [], [], set()
                at = bisect.bisect_left(starts, e)
                free = not bar and k not in keys and (at == 0 or ends[at - 1] <= s)
                if free:
                    starts.insert(at, s)
                    ends.insert(at, e)
                    if key:
                        keys.add(k)
                accepted.append(free)
            yield pdf.assign(accepted=accepted)

    dealt = requests.repartition(person).sortWithinPartitions(person, order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return dealt.mapInPandas(run, f"{fields}, accepted boolean")


def busy_timeline(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """For each key and day, its intervals in order."""
    return df.groupBy(key, F.to_date(start).alias("day")).agg(F.sort_array(F.collect_list(F.struct(start, end))).alias("busy"))


def completed_first(schedules: DataFrame, key: str, start: str, status: str, tie: str) -> DataFrame:
    """For each key and day: the earliest busy row, which is completed now (null where none is busy), and how many
    are completed with it."""
    busy = F.col(status) == "busy"
    first = F.min_by(F.col(tie), F.when(busy, F.struct(F.col(start), F.col(tie))))
    return schedules.groupBy(key, F.to_date(start).alias("day")).agg(F.when(F.count_if(busy) > 0, first).alias("completed_row"), (F.count_if(F.col(status) == "completed") + F.when(F.count_if(busy) > 0, 1).otherwise(0)).alias("completed"))


def with_busy(held: Column, start: Column, end: Column) -> Column:
    """A list of busy intervals with one more, unless it is there."""
    one = F.struct(start.alias("start"), end.alias("end"))
    return F.when(F.array_contains(held, one), held).otherwise(F.concat(held, F.array(one)))


def without_busy(held: Column, start: Column) -> Column:
    """A list of busy intervals without those that start then."""
    return F.filter(held, lambda b: b["start"] != start)


def free_hours(people: DataFrame, busy: DataFrame, key: str, day: str, first: int, last: int, most: int | None = None, minutes: int = 60) -> DataFrame:
    """Free slots of a day, one an hour, the earliest first, at most `most` of a person."""
    begin = F.lit(day).cast("timestamp_ntz")
    span = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    if first > last:
        return people.select(key, begin.alias("slot"), F.lit(0).cast("long").alias("rank")).limit(0)
    hours = people.select(key).withColumn("h", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("slot", begin + F.make_dt_interval(F.lit(0), F.col("h"))).drop("h")
    taken = busy.select(F.col(key).alias("_k"), F.col("start_time").alias("_s"), F.col("end_time").alias("_e")).filter((F.col("_s") < begin + F.expr("INTERVAL 1 DAY") + span) & (F.col("_e") > begin))
    free = hours.join(taken, (F.col(key) == F.col("_k")) & overlap(F.col("_s"), F.col("_e"), F.col("slot"), F.col("slot") + span), "left_anti")
    ranked = free.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("slot")).cast("long"))
    return ranked.filter(F.col("rank") <= most) if most else ranked


def proposed(people: DataFrame, busy: DataFrame, key: str, now: str, first: int = 9, last: int = 21, most: int = 3, minutes: int = 60) -> DataFrame:
    """Slots to propose: today's from the next full hour on, all of them; for people without any, the first `most` of
    tomorrow."""
    moment = datetime.fromisoformat(now)
    today, after = (d.strftime("%Y-%m-%d 00:00:00") for d in (moment, moment + timedelta(days=1)))
    own = free_hours(people, busy, key, today, max(moment.hour + 1, first), last, None, minutes)
    later = free_hours(people.join(own.select(key).distinct(), key, "left_anti"), busy, key, after, first, last, most, minutes)
    return own.withColumn("tomorrow", F.lit(False)).unionByName(later.withColumn("tomorrow", F.lit(True)))


def best_choice(candidates: DataFrame, group: str, entity: str, tier: Column, rank: Column) -> DataFrame:
    """The first free candidate: preferred tier first, then by rank."""
    return candidates.groupBy(group).agg(F.min_by(entity, F.struct(tier, rank, F.col(entity))).alias(entity))


def preferred(people: DataFrame, free: DataFrame, key: str, gender: str, wanted_gender: str | None, preference: Column, rank: Column, k: int = 1) -> DataFrame:
    """The search without a named person: those of the gender who are free, the preferred ones first; the first k."""
    own = gender_filter(people, gender, wanted_gender or "").join(free.select(key), key, "left_semi")
    return own.withColumn("preferred", preference).withColumn("_rank", rank).orderBy(F.desc("preferred"), "_rank", key).limit(k).drop("_rank")


def gender_filter(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Normalised gender filter; an unknown label, or one that nobody has, leaves everyone in."""
    names = {"男": "男", "男性": "男", "男技师": "男", "male": "男", "女": "女", "女性": "女", "女技师": "女", "female": "女"}
    value = names.get((wanted or "").strip().lower())
    if value is None:
        return df
    hit = F.col(column) == value
    any_ = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("_any"))
    return df.join(F.broadcast(any_), hit | ~F.col("_any"), "inner").drop("_any")
