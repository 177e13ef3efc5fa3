"""Calls with deadlines, segmentation, the table function, matrix blocks and counted ranks."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import calls, corpus, retrieval, segment


def test_calls_in_time():
    def fn(row):
        if row["i"] == 3:
            time.sleep(3)
        if row["i"] == 4:
            raise ValueError("no")
        return row["i"] * 2

    began = time.monotonic()
    got = {row["i"]: (value, reason) for row, value, reason in calls.in_time(iter([{"i": i} for i in range(20)]), fn, 0.5, 4)}
    assert time.monotonic() - began < 2.5
    assert got == {i: (None, "timeout") if i == 3 else (None, "error:no") if i == 4 else (i * 2, None) for i in range(20)}


def test_a_slow_reranker_falls_back_to_coarse_order(spark):
    df = spark.createDataFrame([("q", "question", i, str(i), i) for i in range(1, 11)] + [("r", "fast", i, str(i), i) for i in range(1, 4)], "q string, question string, id long, content string, coarse long")

    def scorer(questions, contents):
        if questions[0] == "question":
            time.sleep(5)
        return [float(c) for c in contents]

    got = retrieval.reranked_in_time(df, "q", "question", "id", "content", "coarse", scorer, limit=1.0, k=2).orderBy("q", "rank").collect()
    assert [(r.q, r.id, r.rerank_fallback, r.rerank_error) for r in got] == [("q", 1, True, "timeout"), ("q", 2, True, "timeout"), ("r", 3, False, None), ("r", 2, False, None)]


def test_a_retried_run_resumes(spark, tmp_path):
    df, log = spark.range(40), str(tmp_path / "calls")

    def fn(row, dead=None):
        with open(log, "a") as f:
            f.write(f"{row['id']}\n")
        if row["id"] == dead:
            raise ValueError("later")
        return int(row["id"]) + 1

    first = calls.resumed(df, "id", lambda row: fn(row, 7), "long", str(tmp_path / "r"), 5, 4).collect()
    assert {r.id: r.reason for r in first if r.reason} == {7: "error:later"}
    second = calls.resumed(df, "id", fn, "long", str(tmp_path / "r"), 5, 4).collect()
    assert {r.id: (r.value, r.reason) for r in second} == {i: (i + 1, None) for i in range(40)}
    asked = open(log).read().split()
    assert len(asked) == 41 and asked.count("7") == 2


def brute_cuts(run, words, total):
    """All ways to cut a run into known words or single characters; the best, of equal ones the longer first words."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(run[start:i])
                start = i
        if all(len(p) == 1 or p in words for p in parts):
            score = sum(math.log(max(words.get(p, 1), 1)) - math.log(total) for p in parts)
            key = round(score, 9), [len(p) for p in parts]
            best = max(best, (key, parts)) if best else (key, parts)
    return best[1]


@pytest.mark.parametrize("small", [True, False])
def test_best_cuts(spark, monkeypatch, small):
    rnd = random.Random(2)
    letters = "预约技师时间足部"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))): rnd.randint(1, 50) for _ in range(60)}
    total = sum(words.values())
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 11))) for _ in range(60)]
    if not small:
        monkeypatch.setattr(segment, "SMALL_WORDS", 3)
    dictionary = spark.createDataFrame([*words.items(), ("", 5)], "word string, freq int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "预约 A-12 3.5% é", texts[0]])], "i long, text string")
    got = {r.i: r.words for r in segment.segmented(df, "text", dictionary).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_cuts(t, words, total), t
    assert got[60] == got[61] == [] and got[62] == [*brute_cuts("预约", words, total), "a", "12", "3.5%", "é"] and got[63] == got[0]
    assert segment.segmented(df, "text", dictionary.limit(0)).filter("i = 0").first().words == list(texts[0])


def test_chunk_table(spark):
    rnd = random.Random(1)
    text = "# Head\n" + " ".join(rnd.choice(["one", "two.", "three\n"]) for _ in range(400))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x " * 3000)], "id long, text string")
    corpus.register_chunk_table(spark)
    parts = df.select("id", corpus.sections(F.coalesce(corpus.normalized(F.col("text")), F.lit("")), F.lit("")).alias("parts"))
    same = lambda d: sorted(map(str, d.collect()))
    for size, overlap, most in ((500, 100, 200), (120, 20, 3)):
        got = spark.sql(f"SELECT id, c.* FROM {{d}} d, LATERAL chunk_table(d.parts, {size}, {overlap}, {most}) c", d=parts)
        assert same(got) == same(corpus.chunk_documents(df, "id", "text", size=size, overlap=overlap, most=most)) and got.count() > 1
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT c.* FROM {d} d, LATERAL chunk_table(d.parts, d.id) c", d=parts).collect()


def test_matrix_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 7)
    monkeypatch.setattr(retrieval, "BROADCAST_BLOCKS", 1)
    rnd = random.Random(3)
    vec = lambda n: [round(rnd.uniform(-1, 1), 1) for _ in range(n)]
    docs = [(i, None if i == 4 else [] if i == 5 else vec(3 if i % 10 else 4)) for i in range(60)]
    asks = [(i, vec(3)) for i in range(7)]
    d, q = spark.createDataFrame(docs, "d long, embedding array<double>").repartition(3), spark.createDataFrame(asks, "q long, embedding array<double>")
    for negated, score in ((False, lambda a, b: sum(x * y for x, y in zip(a, b))), (True, lambda a, b: -sum((x - y) ** 2 for x, y in zip(a, b)))):
        for k in (4, None):
            want = {i: [x[1] for x in sorted((-round(score(v, a), 9), n) for n, v in docs if v and len(v) == 3)][:k] for i, a in asks}
            got = retrieval.dense(d, q, "d", "q", k, negated_distance=negated).orderBy("q", "rank").collect()
            assert {i: [r.d for r in got if r.q == i] for i, _ in asks} == want


def test_counted_ranks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "RANGE", 20)
    rnd = random.Random(3)
    rows = [(q, i, float(rnd.randint(0, 40))) for q, n in ((1, 500), (2, 5), (3, 90)) for i in range(n)] + [(4, i, 1.0) for i in range(100)]
    got = {(r.q, r.d): r["rank"] for r in retrieval.counted_ranks(spark.createDataFrame(rows, "q long, d long, score double"), "q", "d").collect()}
    for q in (1, 2, 3, 4):
        order = sorted((-s, i) for a, i, s in rows if a == q)
        assert [got[q, i] for _, i in order] == list(range(1, len(order) + 1))
