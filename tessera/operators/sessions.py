"""Session state in batch form: windows anchored at first events, TTLs, last messages, routing, drafts, parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = ("未知", "无", "")
# Answers that confirm or refuse, and prices by service, the first that fits in this order.
POSITIVE = ("是", "好", "可以", "同意", "确定", "yes", "ok", "行")
NEGATIVE = ("不", "不要", "不行", "不同意", "换", "no")
PRICES = (("全身推拿", 120), ("全身按摩", 120), ("肩颈推拿", 80), ("肩颈按摩", 80), ("足底按摩", 100), ("足底推拿", 100), ("背部推拿", 90), ("背部按摩", 90))
MARKERS = ("[THOUGHT]", "[REPLY]", "[SIGNAL]", "[STATE]", "[SOURCES]")


def anchored_windows(df: DataFrame, key: str, ts: str, tie: str, seconds: float, most: int | None = None) -> DataFrame:
    """Fixed windows that open at a key's first event and last `seconds`; the next event after that opens a new one.
    Adds window_start, n (position in the window) and allowed (n <= most). Sequential by nature: sorted
    partitions are streamed with the state of one key at a time, so a hot key costs no memory."""
    span = pd.Timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = opened = None
        n = 0
        for pdf in batches:
            starts, counts = [], []
            for k, at in zip(pdf[key], pdf[ts]):
                if k != last or at >= opened + span:
                    last, opened, n = k, at, 0
                n += 1
                starts.append(opened)
                counts.append(n)
            yield pdf.assign(window_start=pd.Series(starts, dtype="datetime64[us]"), n=counts, allowed=[most is None or c <= most for c in counts])

    dealt = df.repartition(key).sortWithinPartitions(key, ts, tie)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInPandas(run, f"{fields}, window_start timestamp_ntz, n long, allowed boolean")


def sessions(df: DataFrame, key: str, ts: str, tie: str, ttl_seconds: float) -> DataFrame:
    """State that each write renews: a gap of more than the TTL starts a new session. Adds `session`, from 0."""
    own = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(own).cast("timestamp"))
    return df.withColumn("_new", (gap > ttl_seconds * 1e6).cast("long")).withColumn("session", F.coalesce(F.sum("_new").over(own), F.lit(0))).drop("_new")


def last_messages(df: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def appended(state: Column, new: Column) -> Column:
    """The append reducer of a conversation's list."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(state, none), F.coalesce(new, none))


def unseen(messages: Column, seen: Column) -> Column:
    """What came after the first `seen` messages."""
    return F.slice(messages, F.least(seen, F.size(messages)) + 1, F.greatest(F.size(messages), F.lit(1)))


def technician_name(text: Column, names: list[str]) -> Column:
    """The first of the names, in their order, that a text holds."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(n)), n) for n in names), F.lit(None).cast("string"))


def duration_of(value: Column) -> Column:
    """Minutes of a duration as text, or as JSON with `minutes` or `hours`."""
    given = F.coalesce(F.get_json_object(value, "$.minutes").cast("double"), F.get_json_object(value, "$.hours").cast("double") * 60)
    return F.when(F.trim(value).startswith("{"), given.cast("long")).otherwise(duration_minutes(value))


def intent_route(active_agent: Column, label: Column) -> Column:
    """An agent at work keeps the turn; else the label's, unknown ones going to other."""
    known = F.when(label.isin("appointment", "consultation", "analysis", "service"), label).otherwise("other")
    return F.coalesce(active_agent, known)


def merged_draft(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The last known value of each field over a key's turns; null and the sentinels change nothing."""
    known = lambda c: F.when(~F.col(c).isin(*UNKNOWN), F.struct(F.col(order), F.col(c).alias("v")))
    return df.groupBy(key).agg(*(F.max(known(c))["v"].alias(c) for c in fields))


def missing_fields(technician: str = "technician_name", gender: str = "gender", always: tuple[str, ...] = ("start_time", "project", "duration")) -> Column:
    """Ordered names of the fields a booking still lacks; gender only without a technician."""
    lacks = lambda c: F.col(c).isNull() | F.col(c).isin(*UNKNOWN)
    wanted = [F.when(lacks(c), c) for c in always] + [F.when(lacks(technician) & lacks(gender), gender)]
    return F.filter(F.array(*wanted), lambda x: x.isNotNull())


def payload_valid(kind: Column, payload: Column) -> Column:
    has = lambda n: F.get_json_object(payload, f"$.{n}").isNotNull()
    return F.when(kind.isNull() | (kind == ""), F.lit(False)).when(kind == "appointment", has("start_time") & has("duration")).when(kind == "consultation", has("query") | has("question")).otherwise(True)


def session_id(*candidates: Column) -> Column:
    """The first valid candidate, else a fresh one."""
    return F.coalesce(*(F.when(c.rlike("^[A-Za-z0-9_-]{16,64}$"), c) for c in candidates), F.uuid())


def start_minute(text: Column) -> Column:
    """ISO or plain date-times cut to the minute; 未知 for anything else."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "T(.{0,5}).*", " $1"), r"[+-]\d{2}:\d{2}$", ""))
    own = F.regexp_extract(plain, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1)
    return F.when(text.isNull() | (own == ""), "未知").otherwise(own)


def duration_minutes(text: Column) -> Column:
    """The first number, hours turned into minutes; null without one."""
    n = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(n != "", n.cast("long") * F.when(F.contains(text, F.lit("小时")), 60).otherwise(1))


def all_digits(text: Column) -> Column:
    """All digits of a text as one number."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).cast("long")


def service_price(text: Column) -> Column:
    """Price of the first service named, 120 by default."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(s)), p) for s, p in PRICES), F.lit(120))


def technician_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)号(?:技师)?", 1), F.lit("")).cast("long")


def confirmation(text: Column) -> Column:
    """True for consent, false for refusal, null where it isn't clear."""
    some = lambda words: F.lower(text).rlike("|".join(words))
    return F.when(some(POSITIVE) & ~some(NEGATIVE), True).when(some(NEGATIVE), False)


def key_part(text: Column) -> Column:
    return F.translate(text, ":", "_")


# A stream as segments, each from one marker to the next; text before the first marker belongs to none.
_KINDS = "|".join(m[1:-1] for m in MARKERS)
_STARTS = rf"(?=\[(?:{_KINDS})\])"
_HEAD = rf"(?s)\A\[({_KINDS})\](?:\[([^\]]+)\])?(.*)\z"
#: The beginning of a marker at the very end, still to be completed.
_OPEN_END = "(?:" + "|".join(re.escape(m[:n]) for m in MARKERS for n in range(1, len(m))) + r")\z"
NO_AGENT = "处理节点"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def parsed_stream(raw: Column) -> Column:
    """Struct (reply, agent, thoughts, sources) of a marked-up stream, complete or not. Replies are joined by line
    ends, the last one names the agent, and sources is the last segment of them that is a JSON list."""
    raw = F.coalesce(raw, F.lit(""))
    part = lambda x, n: F.regexp_extract(x, _HEAD, n)
    segment = lambda x: F.struct(part(x, 1).alias("kind"), F.when(part(x, 2) == "", NO_AGENT).otherwise(part(x, 2)).alias("agent"), _stripped(F.regexp_replace(part(x, 3), _OPEN_END, "")).alias("body"))
    marked = F.filter(F.transform(F.split(raw, _STARTS), segment), lambda s: s["kind"] != "")
    kind = lambda name: F.filter(marked, lambda s: s["kind"] == name)
    spoken = F.transform(F.filter(kind("REPLY"), lambda s: s["body"] != ""), lambda s: s["body"])
    plain = F.when(_stripped(raw).rlike(rf"\A(?:{_OPEN_END})?\z"), "").otherwise(F.regexp_replace(raw, _OPEN_END, ""))
    json = F.transform(kind("SOURCES"), lambda s: F.try_parse_json(s["body"]))
    lists = F.filter(json, lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    return F.struct(
        F.when(F.size(marked) > 0, _stripped(F.array_join(spoken, "\n"))).otherwise(plain).alias("reply"),
        F.get(kind("REPLY"), F.size(kind("REPLY")) - 1)["agent"].alias("agent"),
        F.transform(F.filter(kind("THOUGHT"), lambda s: s["body"] != ""), lambda s: F.struct(s["agent"].alias("agent"), s["body"].alias("content"))).alias("thoughts"),
        F.coalesce(F.to_json(F.get(lists, F.size(lists) - 1)), F.lit("[]")).alias("sources"),
    )


def with_parsed_stream(df: DataFrame, column: str) -> DataFrame:
    """Adds the struct `parsed`."""
    return df.withColumn("parsed", parsed_stream(F.col(column)))
