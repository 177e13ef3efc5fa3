"""Worked examples of the operators, on small inline tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import behaviour, corpus, evaluation, metrics, relational, retrieval, scheduling, sessions
from tessera.sources import files, jsonl


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def at(text):
    return dt.datetime.fromisoformat(text)


def test_percentiles_take_nearest_rank_half_even(spark):
    df = spark.createDataFrame([(1, 100.0), (1, 300.0)], "k int, v double")
    assert rows(metrics.distribution(df, ["k"], "v").select("p50", "p95", "mean")) == [(100.0, 300.0, 200.0)]


@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_order_statistics_of_large_groups(spark, monkeypatch, direct):
    monkeypatch.setattr(metrics, "DIRECT", direct)
    df = spark.range(60_001).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.floor(F.col("id") / 5000)).cast("double").alias("v"))
    got = {r.k: r for r in metrics.order_statistics(df, ["k"], "v", {n: (p, metrics.nearest_place(p)) for n, p in (("a", 0.0), ("b", 0.5), ("c", 0.999), ("d", 1.0))}).collect()}
    for k in (0, 1):
        values = sorted(float(i if i % 2 == 0 else i // 5000) for i in range(60_001) if i % 2 == k)
        assert [got[k][n] for n in "abcd"] == [values[round((len(values) - 1) * p)] for p in (0.0, 0.5, 0.999, 1.0)] and got[k].n == len(values)
    none = spark.createDataFrame([(None, 2.0), (None, 4.0), (1, None)], "k int, v double")
    assert sorted((str(r.k), r.p50, r["mean"]) for r in metrics.distribution(none, ["k"], "v").collect()) == [("1", 0.0, 0.0), ("None", 2.0, 3.0)]


def test_cost_ladder(spark):
    df = spark.createDataFrame([(1000.0, 250.0, 2.0), (None, None, 2.0), (101.0, 1.0, 2.0), (10.0, 1.0, None)], "i double, o double, p double")
    status = metrics.cost_status(F.col("i"), F.col("i"), F.when(F.col("i") == 101, 100.0), F.col("p"))
    got = df.withColumn("s", status).select("s", metrics.cost(F.col("s"), F.col("i"), F.col("o"), F.lit(2.0), F.lit(8.0)).alias("c"))
    assert sorted(map(str, rows(got.fillna(-1)))) == sorted(map(str, [("calculated", 0.004), ("usage_not_reported", -1.0), ("pricing_tier_exceeded", -1.0), ("pricing_not_configured", -1.0)]))


def test_counters_merge(spark):
    df = spark.createDataFrame([("s", 100, 20), ("s", 110, 25)], "stage string, i long, o long")
    assert rows(metrics.merge_counters(df.withColumn("m", F.col("i")), ["stage"], ["i", "o"], ["m"])) == [("s", 210, 45, 110)]


def test_log_lines(spark):
    lines = spark.createDataFrame([('{"recorded_at": "2026-08-18T00:00:00Z", "id": 1}',), ('{"recorded_at": "2026-08-20T00:00:00Z", "id": 2}',), ("not-json",), ("",), ('{"id": 3}',)], "value string")
    good, bad = jsonl.parsed_lines(lines, "recorded_at string, id long", "recorded_at", "2026-08-19T00:00:00Z")
    assert [r.id for r in good.orderBy("id").collect()] == [2, 3] and bad.count() == 1


def test_log_round_trip(spark, tmp_path):
    jsonl.append_log(spark.range(3), str(tmp_path / "log"))
    jsonl.append_log(spark.range(2), str(tmp_path / "log"))
    assert jsonl.read_log(spark, str(tmp_path / "log"), "id long")[0].count() == 5


def test_documents_and_uploads(spark, tmp_path):
    for name in ("a.md", "README.md", "b.txt", "c.pdf"):
        (tmp_path / name).write_text(name)
    assert [r.name for r in files.scan_documents(spark, str(tmp_path)).collect()] == ["a.md", "b.txt"]
    up = spark.createDataFrame([("a.md", b"\xef\xbb\xbfhi"), ("b.md", b"\xff\xfe"), ("c.exe", b"x"), ("d.txt", b" ")], "name string, content binary")
    assert rows(files.decode_uploads(up).select("name", F.coalesce("error", "text"))) == [("a.md", "hi"), ("b.md", "not_utf8"), ("c.exe", "unsupported_type"), ("d.txt", "empty")]


def test_snapshots(spark, tmp_path):
    first = files.write_snapshot(spark.range(3), str(tmp_path / "t"))
    files.write_snapshot(spark.range(5), str(tmp_path / "t"))
    assert files.read_snapshot(spark, str(tmp_path / "t")).count() == 5
    files.restore_snapshot(spark, str(tmp_path / "t"), first)
    assert files.read_snapshot(spark, str(tmp_path / "t")).count() == 3


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert files.generation(spark, folder) is None and files.refreshed(spark, folder, None, lambda df: df) == (None, None)
    files.write_snapshot(spark.range(3), folder)
    held, out = files.refreshed(spark, folder, None, lambda df: df.count())
    assert out == 3 and files.refreshed(spark, folder, held, lambda df: df.count()) == (held, None)
    calls = []

    def interrupted(df):
        calls.append(1)
        if len(calls) == 1:
            files.write_snapshot(spark.range(5), folder)
        return df.count()

    assert files.refreshed(spark, folder, None, interrupted)[1] == 5 and len(calls) == 2
    with pytest.raises(ValueError):
        files.refreshed(spark, folder, None, lambda df: files.write_snapshot(spark.range(1), folder))
    with pytest.raises(ValueError):
        files.restore_snapshot(spark, folder, 7)


def test_cases_from_json_and_private_logs(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "a", "query": "q"},\n {"id": "b"}]')
    cases = files.read_cases(spark, str(tmp_path / "cases.json"))
    assert rows(evaluation.case_catalog(cases, cases.limit(0)).select("id", "kind")) == [("a", "answer"), ("b", "answer")]
    safe = jsonl.privacy_safe(cases.filter("id = 'a'"), ["query"])
    assert safe.columns == ["id", "query_sha256"] and len(safe.first().query_sha256) == 64
    assert rows(spark.createDataFrame([("a, b，c,",)], "k string").select(corpus.split_keywords(F.col("k")))) == [(["a", "b", "c"],)]


def test_availability(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    busy = spark.createDataFrame([(1, at("2026-01-01 14:00"), at("2026-01-01 15:00"))], "id long, start_time timestamp_ntz, end_time timestamp_ntz")
    ask = lambda a, b: rows(scheduling.available(people, [busy], "id", F.lit(at(a)).cast("timestamp_ntz"), F.lit(at(b)).cast("timestamp_ntz")))
    assert ask("2026-01-01 14:30", "2026-01-01 15:30") == [(2,), (3,)]
    assert ask("2026-01-01 15:00", "2026-01-01 16:00") == [(1,), (2,), (3,)]


def test_rejected_requests_do_not_block(spark):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    df = spark.createDataFrame([(1, 7, t(10), t(11)), (2, 7, t(10, 30), t(12)), (3, 7, t(11), t(12)), (4, 8, t(10), t(11))], "n long, who long, s timestamp_ntz, e timestamp_ntz")
    assert rows(scheduling.resolve(df, "who", "n", "s", "e").select("n", "accepted")) == [(1, True), (2, False), (3, True), (4, True)]


def test_booking_batch(spark):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    asked = [(1, "k1", 7, t(10), 60), (2, "k1", 7, t(10), 60), (3, "k2", 7, t(10, 30), 60), (4, "k3", 7, t(11), 30), (5, "k4", 9, t(10), 30), (6, "k5", 7, t(10), 45), (7, "k6", 8, t(10), 30), (8, None, 7, t(12), 30), (9, " \t", 7, t(12), 30), (10, "k7", 8, t(9), 30), (11, "k5", 7, t(14), 30), (12, "k5", 7, t(15), 30), (13, "old", 7, t(16), 30), (14, "k" * 129, 7, t(17), 30), (15, " k4 ", 7, t(18), 30)]
    df = spark.createDataFrame(asked, "arrival long, request_key string, person long, start_time timestamp_ntz, minutes int")
    people = spark.createDataFrame([(7, True), (8, True), (9, False)], "person long, enabled boolean")
    busy = spark.createDataFrame([(8, t(10), t(10, 30))], "person long, start_time timestamp_ntz, end_time timestamp_ntz")
    earlier = spark.createDataFrame([("old", "B1")], "key string, booking string")
    got = scheduling.booked(df, people, [busy], F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"), earlier=earlier).orderBy("arrival").collect()
    assert [r.outcome for r in got] == ["CREATED", "REPLAY", "CONFLICT", "CREATED", "NOT_FOUND", "INVALID", "CONFLICT", "INVALID", "INVALID", "CREATED", "CREATED", "REPLAY", "REPLAY", "INVALID", "CREATED"]
    assert [got[i].replay_of for i in (1, 11, 12)] == [1, 11, None] and got[12].booking == "B1" and got[7].error == "INVALID_IDEMPOTENCY_KEY"


def test_keys_that_name_several_persons(spark):
    rnd = random.Random(5)
    day = dt.datetime(2026, 1, 1)
    asked = [(i, f"k{rnd.randrange(60)}", rnd.randrange(8), day + dt.timedelta(minutes=30 * rnd.randrange(-2, 40)), 30 * rnd.randrange(1, 5)) for i in range(300)]
    df = spark.createDataFrame(asked, "arrival long, request_key string, person long, start_time timestamp_ntz, minutes int")
    people = spark.range(8).select(F.col("id").alias("person"), (F.col("id") < 7).alias("enabled"))
    got = {r.arrival: (r.outcome, r.replay_of) for r in scheduling.booked(df, people, [], F.lit(day).cast("timestamp_ntz")).collect()}
    held, keys, want = {}, {}, {}
    for i, key, who, s, minutes in asked:
        e = s + dt.timedelta(minutes=minutes)
        if key in keys:
            want[i] = ("REPLAY", keys[key])
        elif s <= day:
            want[i] = ("INVALID", None)
        elif who == 7:
            want[i] = ("NOT_FOUND", None)
        elif any(a < e and b > s for a, b in held.get(who, [])):
            want[i] = ("CONFLICT", None)
        else:
            want[i], keys[key] = ("CREATED", None), i
            held.setdefault(who, []).append((s, e))
    assert got == want


def test_slot_proposals(spark):
    people = spark.createDataFrame([(1,), (2,)], "id long")
    busy = spark.createDataFrame([(2, at("2026-01-01 08:00"), at("2026-01-01 23:00")), (2, at("2026-01-02 09:30"), at("2026-01-02 10:00"))], "id long, start_time timestamp_ntz, end_time timestamp_ntz")
    got = scheduling.proposed(people, busy, "id", "2026-01-01 18:20:00").collect()
    assert sorted((r.id, r.slot.isoformat()[5:13], r.tomorrow) for r in got) == [(1, "01-01T19", False), (1, "01-01T20", False), (1, "01-01T21", False), (2, "01-02T10", True), (2, "01-02T11", True), (2, "01-02T12", True)]
    assert {r.id for r in scheduling.proposed(people, busy.limit(0), "id", "2026-01-01 21:20:00").collect() if r.tomorrow} == {1, 2}


def test_slots_and_validation(spark):
    t = at("2026-01-01 10:00")
    df = spark.createDataFrame([(1, t, at("2026-01-01 11:00"))], "id long, s timestamp_ntz, e timestamp_ntz")
    assert scheduling.slots(df, "s", "e").count() == 2
    code = lambda minutes, now: df.select(scheduling.validation_error(F.col("s"), F.lit(minutes), F.lit(at(now)).cast("timestamp_ntz"))).first()[0]
    assert [code(60, "2025-01-01"), code(60, "2026-01-01 10:00"), code(20, "2025-01-01"), code(45, "2025-01-01")] == [None, "START_IN_PAST", "DURATION_OUT_OF_RANGE", "DURATION_NOT_ON_GRID"]


def test_gender_filter_falls_back(spark):
    df = spark.createDataFrame([(1, "男"), (2, "男")], "id long, g string")
    assert [scheduling.gender_filter(df, "g", x).count() for x in ("male", "女", "?")] == [2, 2, 2]


def test_evidence_gate(spark):
    df = spark.createDataFrame([(1, 0.7, None, None, None), (2, 0.1, 8.1, None, None), (3, 0.1, 1.0, "llm", 9.0), (4, 0.1, 1.0, "cross_encoder", 9.0)], "id long, d double, b double, p string, r double")
    got = df.filter(F.size(retrieval.accepted_by(F.col("d"), F.col("b"), F.col("p"), F.col("r"))) > 0)
    assert [r.id for r in got.orderBy("id").collect()] == [1, 2, 3]


def test_routing(spark):
    ask = lambda q, d, b, **k: spark.createDataFrame([(q, d, b)], "q string, d double, b double").select(retrieval.route(F.col("q"), F.col("d"), F.col("b"), F.lit(True), **k)).first()[0]
    assert ask("短问", 0.86, 3.0, llm=False) == "high_confidence_hybrid"
    assert ask("短问", 0.40, 0.0, llm=False) == "below_evidence_threshold"
    assert ask("按摩之后红肿怎么处理，可以退款吗", 0.75, 9.0) == "high_risk_complex_query"


def test_fusion_prefers_coarse_order(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 1.0)], "q long, d long, c long, s double")
    assert [r.d for r in retrieval.fused(df, "q", "d", "c", "s", 0.8).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.fused(df, "q", "d", "c", "s", 1.5)


def test_rerank_fallback(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, None), (2, 1, None), (2, 2, None)], "q long, c long, s double")
    got = retrieval.reranked(df, "q", "c", "s").orderBy("q", "rank").select("c", "rerank_fallback").collect()
    assert [tuple(r) for r in got] == [(2, False), (1, False), (3, False), (1, True), (2, True)]


def test_registries_and_scorers(spark):
    docs = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "apple pie", [0.9, 0.1])], "d long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "apple", [1.0, 0.0])], "q long, text string, embedding array<double>")
    top = lambda name: [r.d for r in retrieval.retriever(name)(docs, asked, "d", "q", 2).orderBy("rank").collect()]
    assert top("Dense") == [1, 3] and sorted(top("bm25")) == [1, 3] and top("hybrid")[0] == 1
    with pytest.raises(ValueError):
        retrieval.retriever("other")
    assert retrieval.reranker("none") is None
    pairs = spark.createDataFrame([(1, "q", c, i) for i, c in enumerate(("a", "bb", "cc", "d"), 1)], "q long, question string, content string, coarse long").coalesce(1)
    rerank = retrieval.reranker("cross-encoder")
    got = rerank(pairs, "q", "question", "content", "coarse", lambda q, c: [[0.0, len(x)] for x in c], batch=3, k=3).orderBy("rank").collect()
    assert [r.content for r in got] == ["bb", "cc", "a"] and not got[0].rerank_fallback
    fell = rerank(pairs, "q", "question", "content", "coarse", lambda q, c: 1 / 0).orderBy("rank").collect()
    assert [r.content for r in fell] == ["a", "bb", "cc", "d"] and fell[0].rerank_fallback
    vectors = retrieval.embedded(spark.createDataFrame([("ab",), (" ",), (None,)], "t string"), "t", lambda texts: [[len(x), 1] for x in texts]).collect()
    assert [r.embedding for r in vectors] == [[2.0, 1.0], None, None]


def test_okapi_drops_scores_after_the_cut(spark):
    docs = spark.createDataFrame([(i, "common word") for i in range(3)] + [(9, "rare common")], "d long, text string")
    asked = spark.createDataFrame([(1, "common")], "q long, text string")
    scores = retrieval.bm25(docs, asked, "d", "q", okapi=True)
    assert all(r.score > 0 for r in retrieval.sparse_ranking(scores, "q", "d", 2).collect())


def test_query_expansion(spark):
    df = spark.createDataFrame([("明天有空位吗",), ("我不想被碰脚",), ("你好",)], "q string")
    assert [r[0] for r in df.select(retrieval.expand_query(F.col("q"))).collect()] == [["空闲", "可预约"], ["足部", "避开", "不操作"], []]


def test_cjk_tokens(spark):
    got = spark.createDataFrame([("VIP-1 会员卡 abc12",)], "t string").select(retrieval.tokens(F.col("t"), True)).first()[0]
    assert sorted(got) == sorted(["vip-1", "abc", "12", "会", "员", "卡", "会员", "员卡"])


def test_pool_sizes():
    assert [retrieval.pool_size(1, 30, False, True), retrieval.pool_size(1, 4, True, False), retrieval.pool_size(3, 30, False, False)] == [10, 4, 6]


def test_category_is_filtered_after_ranking(spark):
    ranking = spark.createDataFrame([(1, d, d) for d in range(1, 5)], "q long, d long, rank long")
    docs = spark.createDataFrame([(d, "x" if d == 4 else "y") for d in range(1, 5)], "d long, c string")
    assert rows(retrieval.in_category(ranking, docs, "q", "d", "c", "x", 1).select("d", "rank")) == [(4, 1)]


def test_chunks():
    text = "一二三四五六七八九十。" * 60
    for size, overlap in ((120, 20), (500, 100)):
        got = corpus.chunks(text, size, overlap)
        assert all(len(c) <= size for c in got) and all(c.endswith("。") for c in got)
    for bad in ((99, 0), (4001, 0), (500, -1), (500, 251)):
        with pytest.raises(ValueError):
            corpus.checked(*bad)
    words = "alpha beta.\n\n gamma? " * 80
    spans = list(corpus.spans(words, 200, 40))
    assert spans[0][0] == 0 and spans[-1][1] == len(words) and all(0 < b - a <= 200 for a, b in spans) and all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    assert "x" * 450 == "".join(corpus.chunks("x" * 450, 200, 0)) and corpus.chunks("  ") == []


def test_sections(spark):
    ask = lambda text, title: [tuple(x) for x in spark.createDataFrame([(text, title)], "t string, h string").select(corpus.sections(F.col("t"), F.col("h")).alias("s")).first().s]
    assert ask("# A\n\nx\n## B ##\ny", "t") == [("A", "x"), ("B", "y")] and ask("# A", "t") == [("A", "A")]
    assert ask("intro\n   # A\n#B is text\n    # no\n# C #\n\n# D\nend", "t") == [("t", "intro"), ("A", "#B is text\n    # no"), ("D", "end")]
    assert ask("", "t") == [("t", "t")] and ask("", "") == [] and ask("a\n# " + "y" * 300 + "\nb", "")[1][0] == "y" * 255


def test_front_matter(spark):
    def ask(*texts):
        return [r.f for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", corpus.front_matter(F.col("t")).alias("f")).orderBy("i").collect()]

    text = "\ufeff---\nsource_id: s\ntitle: 'T'\n# c\ncategory: faq\nkeywords: [a, \"b, c\", 'd']\nversion: 1\n---\n\nBody\nmore"
    (got,) = ask(text)
    assert (got["source_id"], got["title"], got["category"], got["keywords"], got["version"], got["body"], got["error"]) == ("s", "T", "faq", ["a", "b, c", "d"], "1", "Body\nmore", None)
    bad = ("---\na: 1", "---\nx\n---", "---\nkeywords: a\n---", '---\nkeywords: ["a" b]\n---', f"---\nversion: {'x' * 65}\n---", f"---\nkeywords: [{'x' * 101}]\n---")
    assert [r["error"] for r in ask(*bad)] == ["missing_close", "missing_colon", "bad_keywords", "bad_keywords", "version_too_long", "keyword_too_long"]
    plain, empty, none = ask("no\r\nfence", "---\n---\n", None)
    assert plain["body"] == "no\nfence" and empty["body"] == "" and empty["error"] is None and none["body"] == ""


def test_normalization(spark):
    got = spark.createDataFrame([("﻿ a \r\nb　\r\r\n\n\n\nc ",)], "t string").select(corpus.normalized(F.col("t"))).first()[0]
    assert got == "a\nb\n\nc"


def sync(spark, old, new):
    o = spark.createDataFrame(old, "id long, source_id string, hash string, is_active boolean, category string")
    return corpus.sync_plan(o, spark.createDataFrame(new, "source_id string, hash string, category string"), ["category"])


def test_sync(spark):
    assert rows(sync(spark, [(1, "s", "a", True, "x")], [("s", "a", "x")]).select("action")) == [("noop",)]
    assert rows(sync(spark, [(1, "s", "a", True, "x")], [("s", "a", "y")]).select("action")) == [("update",)]
    plan = sync(spark, [(1, "s", "a", True, "x"), (2, "s", "b", True, "x"), (3, "s", "c", False, "x"), (4, "s", "c", True, "x"), (5, "s", "c", True, "x")], [("s", "d", "x"), ("s", "c", "x")])
    assert sorted((r.hash, r.action) for r in plan.collect()) == [("a", "deactivate"), ("b", "deactivate"), ("c", "deactivate"), ("c", "noop"), ("d", "insert")]
    assert rows(corpus.sync_counts(plan).select("imported", "skipped")) == [(1, 1)]


def test_behaviour(spark):
    df = spark.createDataFrame([(1, "a", at("2024-01-01 00:00")), (1, "a", at("2024-01-03 12:00")), (1, "b", at("2024-01-09 00:00"))], "u long, v string, ts timestamp_ntz")
    assert rows(behaviour.recent_mode(df, "u", "v", "ts").select("v", "n")) == [("a", 2)]
    assert rows(behaviour.cadence(df, "u", "ts", "v").select("n", "avg_days", "label")) == [(3, 3.5, "very_frequent")]
    assert rows(behaviour.preference_confidence(spark.createDataFrame([(1, 2), (1, 3)], "u long, c int"), ["u"], "c")) == [(1, 5)]
    assert rows(behaviour.return_reminder(df, "u", "ts", "2024-02-08 00:00:00").select("days_since", "remind")) == [(30, True)]


def test_anchored_limit(spark):
    df = spark.createDataFrame([(1, "k", at("2024-01-01 00:00:00")), (2, "k", at("2024-01-01 00:00:50")), (3, "k", at("2024-01-01 00:00:59")), (4, "k", at("2024-01-01 00:01:00"))], "id long, k string, ts timestamp_ntz")
    assert rows(sessions.anchored_windows(df, "k", "ts", "id", 60, 2).select("id", "allowed")) == [(1, True), (2, True), (3, False), (4, True)]


def test_stream_protocol(spark):
    def ask(*texts):
        return [r.parsed for r in sessions.with_parsed_stream(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()]

    got, two, bad = ask('[THOUGHT][a]think[REPLY][b] hi [SOURCES] [{"x": 1}][REP', "[REPLY]one[THOUGHT] [REPLY][c]two[STATE]x[SIG", '[REPLY]x[SOURCES]{"a": 1}[SOURCES]oops')
    assert (got["reply"], got["agent"], [tuple(x) for x in got["thoughts"]], got["sources"]) == ("hi", "b", [("a", "think")], '[{"x":1}]')
    assert (two["reply"], two["agent"], two["thoughts"]) == ("one\ntwo", "c", []) and (bad["reply"], bad["agent"], bad["sources"]) == ("x", sessions.NO_AGENT, "[]")
    assert [r["reply"] for r in ask("[TH", "hello [RE", "", None, " [SOURCES", "a [b]")] == ["", "hello ", "", "", "", "a [b]"]


def test_text_parsing(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("2026-06-07T15:00:00+08:00", sessions.start_minute) == "2026-06-07 15:00" and one("soon", sessions.start_minute) == "未知"
    assert one("1小时30", sessions.duration_minutes) == 60 and one("1小时30", sessions.all_digits) == 130
    assert [one(x, sessions.confirmation) for x in ("好的", "不行", "嗯")] == [True, False, None]


def test_gates(spark):
    t = lambda r, s: spark.createDataFrame(r, s)
    policy = t([("cost", "ratio", 1.15), ("safety", "equal", 0.0), ("q", "loss", 0.03)], "metric string, kind string, bound double")
    base = t([("cost", 0.10), ("safety", 1.0), ("q", 0.9)], "metric string, value double")
    assert rows(metrics.gates(t([("cost", 0.116), ("safety", 0.99)], "metric string, value double"), base, policy).select("metric", "passed")) == [("cost", False), ("q", False), ("safety", False)]


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, v string, on boolean")
    assert rows(relational.updated(df, spark.createDataFrame([(1, "z"), (9, "y")], "id long, v string"), "id").select("id", "v")) == [(1, "z"), (2, "b")]
    twice = spark.createDataFrame([(1, "y"), (1, "z"), (1, None)], "id long, v string")
    assert rows(relational.updated(df, twice, "id").select("id", "v")) == [(1, "z"), (2, "b")]
    assert rows(relational.inserted(df, spark.createDataFrame([(2, "q"), (3, "c"), (3, "c")], "id long, v string"), "id")) == [(1, "a", True), (2, "b", True), (3, "c", None)]
    sets = relational.set_comparison(*(spark.createDataFrame(x, "k string, i int") for x in ([("a", 1), ("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 2), ("d", 1)])), "k", "i")
    assert rows(sets) == [("a", "matches"), ("b", "mismatched"), ("c", "missing"), ("d", "extra")]
    assert relational.seed_if_empty(df, df).count() == 0 and relational.seed_if_empty(df.limit(0), df).count() == 2
    assert rows(relational.deleted(df, df.filter("id = 1"), "id", "on").select("id", "on")) == [(1, False), (2, True)]


def test_split_problems(spark):
    t = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert rows(evaluation.split_problems(t(1, 1, 2), t(2, 9), t(1, 2, 3), "id")) == [("duplicate", 1), ("overlap", 2), ("unassigned", 3), ("unknown", 9)]


def test_streaming_rate_limit_forgets(spark, tmp_path):
    from tessera.streaming import state

    moment = lambda seconds: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)
    folder, schema = str(tmp_path / "out"), "id long, k string, ts timestamp"

    def run(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return state.run_once(state.rate_limited(stream, "k", "ts", "5 seconds", 60, 3), "append", folder)

    got = run([(i, "k", moment(i * 10)) for i in range(8)])
    assert [r.allowed for r in got.orderBy("id").collect()] == [True] * 3 + [False] * 3 + [True] * 2
    assert state.kept_state(spark, folder, "window").count() == 1
    got = run([(9, "other", moment(1000))])
    assert [r.n for r in got.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6, 1, 2, 1]
    kept = state.kept_state(spark, folder, "window").select("key.*").collect()
    assert [r[0] for r in kept] == ["other"]  # the span of k is over


def test_sessions_expire(spark, tmp_path):
    from tessera.streaming import state

    moment = lambda seconds: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)
    folder, schema = str(tmp_path / "out"), "k string, ts timestamp"

    def run(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return state.run_once(state.expired_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", 60, "0 seconds"), "append", folder)

    run([("a", moment(0)), ("a", moment(60)), ("a", moment(200)), ("b", moment(210))])
    got = run([("a", moment(240)), ("c", moment(500))])
    assert sorted((r.key, r.n) for r in got.collect()) == [("a", 2), ("a", 2), ("b", 1)]
    assert [r[0] for r in state.kept_state(spark, folder, "session").select("key.*").collect()] == ["c"]


def test_conversation_state(spark, tmp_path):
    from tessera.streaming import state

    schema, folder = "c string, turn long, text string, agent string", str(tmp_path / "out")
    for part in ([("a", 1, "hi", "booking"), ("a", 2, "yes", None), ("b", 1, "x", None)], [("a", 3, None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = state.run_once(state.conversations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "c"), "update", folder, "key")
    assert {r.key: (r.agent, r.messages, r.new) for r in got.collect()} == {"a": ("booking", 3, 1), "b": (None, 1, 1)}
    kept = state.kept_state(spark, folder, "messages")
    assert kept.count() == 4


def test_gateways(spark):
    from tessera.sources import gateway

    t = lambda h: dt.datetime(2026, 1, 1, h)
    df = spark.createDataFrame([(1, "a", 7, t(10), 60), (2, "b", 7, t(10), 60), (3, "a", 7, t(10), 60), (4, "c", 8, t(10), 60)], "arrival long, request_key string, person long, start_time timestamp_ntz, minutes int")
    people = spark.createDataFrame([(7, True)], "person long, enabled boolean")
    local = gateway.gateway("local", people=people, busy=[], now=F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    assert [r.outcome for r in local.book(df).orderBy("arrival").collect()] == ["ok", "conflict", "ok", "request_error"]
    remote = gateway.gateway("Remote", call=lambda row: {1: 201, 2: 409, 3: 503}.get(row["arrival"]))
    assert [r.outcome for r in remote.book(df).orderBy("arrival").collect()] == ["ok", "conflict", "unavailable", "unavailable"]
    with pytest.raises(ValueError):
        gateway.gateway("other")


def test_service(spark):
    from tessera import service

    docs = spark.createDataFrame([(1, "s", "faq", "red apple", True, [1.0, 0.0]), (2, "s", "price", "green pear", True, [0.0, 1.0]), (3, "t", "faq", "old apple", False, [1.0, 0.0])], "doc_id long, source_id string, category string, text string, is_active boolean, embedding array<double>")
    assert [r.doc_id for r in service.knowledge_entries(docs, category="faq", text="APPLE").collect()] == [1] and service.knowledge_entries(docs, inactive=True).count() == 3
    asked = spark.createDataFrame([(9, "apple", [1.0, 0.0])], "item_id long, text string, embedding array<double>")
    assert [r.doc_id for r in service.knowledge_search(docs, asked, k=1, category="price").collect()] == [2] and service.knowledge_search(docs, asked, k=2).count() == 2
    assert service.knowledge_health(docs, docs).first().healthy is False
    lines = spark.createDataFrame([('{"recorded_at": "2026-01-01T00:00:00Z", "usage": {"logical_calls": 2, "failed_calls": 1}, "cost": {"status": "calculated", "total_cny": 0.5}}',), ("oops",)], "value string")
    summary, bad = service.recent_metrics(lines, "2025-01-01T00:00:00Z")
    assert (summary.first().failed_call_rate, summary.first().cost_total, bad.count()) == (0.5, 0.5, 1)
    events = spark.createDataFrame([(1, "appointment", at("2024-01-01 00:00")), (1, "appointment", at("2024-01-05 00:00")), (2, "consultation", at("2024-01-05 00:00"))], "u long, kind string, ts timestamp_ntz")
    assert rows(service.user_analysis(events, "u", "kind", "ts", "2024-03-01 00:00:00").select("u", "total", "label", "remind")) == [(1, 2, "occasional_user", True), (2, 1, "occasional_user", False)]
    busy = spark.createDataFrame([(1, at("2024-01-01 09:00"), at("2024-01-01 10:30")), (1, at("2024-01-02 00:00"), at("2024-01-02 01:00"))], "id long, start_time timestamp_ntz, end_time timestamp_ntz")
    assert rows(service.day_schedule(busy, "id", "2024-01-01").select("from", "to")) == [("09:00", "10:30")]
    people = spark.createDataFrame([(1, True), (2, True)], "id long, enabled boolean")
    assert [r.id for r in service.availability(people, [busy], "id", F.lit(at("2024-01-01 10:00")).cast("timestamp_ntz"), 60).collect()] == [2]
    old = spark.createDataFrame([(1, "s", "h", True, "faq")], "id long, source_id string, hash string, is_active boolean, category string")
    plan, counts = service.knowledge_import(old, spark.createDataFrame([("s", "i", "faq")], "source_id string, hash string, category string"), ["category"])
    assert rows(plan.select("action")) == [("deactivate",), ("insert",)] and counts.count() == 1
