"""Tables that are kept: the commit log, merges and the inverted index."""

import os
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus, retrieval
from tessera.operators.index import InvertedIndex
from tessera.sources.commits import ConcurrentCommit, Log, Table, put_if_absent


def test_a_file_is_created_once(spark, tmp_path):
    path, won = str(tmp_path / "log" / "1.json"), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if put_if_absent(spark, path, str(k)) else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(path).read() == str(won[0])
    assert os.listdir(tmp_path / "log") == ["1.json"] or all(n.startswith(".") for n in os.listdir(tmp_path / "log") if n != "1.json")


def test_two_writers_and_a_killed_one(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = Table(spark, folder, "id", 4)
    table.replace(spark.range(10))
    first, second = Table(spark, folder, "id", 4), Table(spark, folder, "id", 4)
    assert first.replace(spark.range(20), since=1) == 2
    with pytest.raises(ConcurrentCommit):
        second.replace(spark.range(30), since=1)
    third = Table(spark, folder, "id", 4)
    third._written(spark.range(40), 4)  # dies before its commit
    assert table.read().count() == 20 and table.read(1).count() == 10 and table.log.newest() == 2
    assert table.log.vacuum() == 2 and table.read().count() == 20 and table.read(1).count() == 10
    assert table.log.vacuum(keep=1) == 1 and table.log.versions() == [2]


def test_merge(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "id", 8)
    table.replace(spark.range(100).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(None).cast("int").alias("n")))
    changes = spark.createDataFrame([(1, "v1", None, False), (2, "new", 5, False), (200, "added", 1, False), (3, "x", 0, True), (300, "x", 0, True)], "id long, v string, n int, gone boolean")
    version, counts = table.merge(changes, "gone")
    assert version == 2 and counts == {"added": 1, "updated": 1, "unchanged": 1, "deleted": 1}
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 100 and got[2] == "new" and got[200] == "added" and 3 not in got and table.read(1).count() == 100
    assert table.merge(changes, "gone") == (2, {"added": 0, "updated": 0, "unchanged": 3, "deleted": 0})
    entry, before = table.log.entry(2), table.log.entry(1)
    same = [k for k in entry["buckets"] if entry["buckets"][k] == before["buckets"][k]]
    assert same and len(same) < 8  # only touched buckets are written again
    table.merge(spark.createDataFrame([(i, "", 0, True) for i in got], "id long, v string, n int, gone boolean"), "gone")
    assert table.read().count() == 0


WORDS = ["alpha", "beta", "gamma", "delta", "rare1", "rare2", "rare3", "the", "of", "and"]


def texts(seed, n):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS, [3, 3, 3, 3, 0.02, 0.02, 0.02, 20, 20, 20], k=rnd.randint(0, 60)))) for i in range(n)]


def test_index_equals_a_scan(spark, tmp_path):
    old, new = texts(1, 1500), texts(2, 200)
    now = [(i, t + " the" * (i % 9 == 0)) for i, t in old if 300 < i] + [(i, t) for i, t in new if i > 100] + [(5000, None), (5001, "rare1 rare2")]
    schema = "doc_id long, text string"
    queries = spark.createDataFrame([(0, "rare1 the"), (1, "the of and"), (2, "alpha alpha rare2"), (3, "unknown"), (4, ""), (5, "gamma of")], "q long, text string")
    index = InvertedIndex(spark, str(tmp_path / "i"), 8)

    def check(docs):
        df = spark.createDataFrame(docs, schema)
        want = retrieval.sparse_ranking(retrieval.bm25(df, queries, "doc_id", "q"), "q", "doc_id", 5)
        pick = lambda d: sorted((r.q, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
        assert pick(index.search(queries, "q", 5)) == pick(want)

    assert index.refresh(spark.createDataFrame(old, schema)) == (1, {"added": 1500, "changed": 0, "deleted": 0})
    check(old)
    read, every = index.blocks_read(queries, "q", 5)
    assert read < every
    version, counts = index.refresh(spark.createDataFrame(now, schema))
    was, is_ = dict(old), {i: t for i, t in now}
    assert version == 2 and counts == {"added": len(is_.keys() - was.keys()), "changed": sum(is_[i] != was[i] for i in is_.keys() & was.keys()), "deleted": len(was.keys() - is_.keys())}
    check(now)
    assert index.refresh(spark.createDataFrame(now, schema))[0] == 2
    by_name = retrieval.retriever("BM25-indexed")(spark.createDataFrame(now, schema).withColumnRenamed("doc_id", "d"), queries, "d", "q", 5, folder=str(tmp_path / "i"), buckets=8)
    assert by_name.count() == index.search(queries, "q", 5).count() and "d" in by_name.columns and index.log.newest() == 2
    assert index.compact() == 3
    check(now)
    plan = index.search(queries.filter("q = 0"), "q", 5)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    assert index.search(queries, "q", 5, version=1).count() > 0
    index.refresh(spark.createDataFrame([], schema))
    assert index.search(queries, "q", 5).count() == 0 and Log(spark, str(tmp_path / "i")).newest() == 4


def test_an_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Each task writes the blocks of its documents; blocks hold many postings, though all lengths differ."""
    rnd = random.Random(5)
    docs = [(i, " ".join(f"w{int(500 * rnd.random() ** 3)}" for _ in range(20 + i))) for i in range(400)]
    plans, write = {}, InvertedIndex._bucketed
    monkeypatch.setattr(InvertedIndex, "_bucketed", lambda self, df, path: (plans.update({os.path.basename(path): df._jdf.queryExecution().executedPlan().toString()}), write(self, df, path)))
    index = InvertedIndex(spark, str(tmp_path / "i"), 4)
    index.refresh(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2))
    assert "Exchange" not in plans["postings"]
    blocks = index._read(index.log.entry(), "postings", "term string, size int")
    postings = len({(i, w) for i, t in docs for w in t.split()})
    assert blocks.agg(F.sum("size")).first()[0] == postings > 8 * blocks.count()


def test_sync_twice(spark, tmp_path):
    kind = "id string, source_id string, hash string, is_active boolean, updated_at string, content string, category string, keywords array<string>, source_name string, title string, chunk_index int, chunk_count int, version string, embedding array<double>"
    table = Table(spark, str(tmp_path / "c"), "id", 8, by="source_id")
    chunk = lambda source, hash_, version="1", vector=None: (source, hash_, hash_, "faq", ["k"], source, "t", 0, 1, version, vector)
    names = "source_id string, hash string, content string, category string, keywords array<string>, source_name string, title string, chunk_index int, chunk_count int, version string, embedding array<double>"
    sync = lambda *rows: corpus.applied_sync(table, spark.createDataFrame(rows, names), F.lit("now"))
    table.replace(spark.createDataFrame([("1", "a", "old", True, "", "old", "faq", ["k"], "a", "t", 0, 1, "1", None), ("9", "b", "other", True, "", "o", "faq", ["k"], "b", "t", 0, 1, "1", None)], kind))
    assert sync(chunk("a", "new", vector=[1.0]))[1] == {"imported": 1, "skipped": 0, "deactivated": 1, "changed": 2}
    assert sync(chunk("a", "new")) == (2, {"imported": 0, "skipped": 1, "deactivated": 0, "changed": 0})
    assert sync(chunk("a", "new", "2")) == (3, {"imported": 0, "skipped": 1, "deactivated": 0, "changed": 1})
    assert sync(chunk("a", "new", "2", [2.0]), chunk("a", "old"))[1] == {"imported": 1, "skipped": 1, "deactivated": 0, "changed": 2}
    got = {(r.source_id, r.hash): (r.is_active, r.version, r.embedding) for r in table.read().collect()}
    assert got == {("a", "new"): (True, "2", [2.0]), ("a", "old"): (True, "1", None), ("b", "other"): (True, "1", None)}

def test_sync_moves_only_new_contents(spark, tmp_path, monkeypatch):
    """Contents that are there already stay in the stored rows; those that differ under one hash, and new ones, come along."""
    kind = "id string, source_id string, hash string, is_active boolean, updated_at string, content string, category string, keywords array<string>, source_name string, title string, chunk_index int, chunk_count int, version string, embedding array<double>"
    table = Table(spark, str(tmp_path / "c"), "id", 4, by="source_id")
    held = lambda id_, hash_, content, active=True: (id_, "a", hash_, active, "", content, "faq", ["k"], "a", "t", 0, 1, "1", None)
    table.replace(spark.createDataFrame([held("1", "gone", "g"), held("2", "off", "o", False), held("3", "re", "before"), held("4", "up", "u"), held("5", "no", "n"), held("6", "nul", None)], kind))
    given = lambda hash_, content, version="1": ("a", hash_, content, "faq", ["k"], "a", "t", 0, 1, version, None)
    new = spark.createDataFrame([given("off", "o"), given("re", "after"), given("up", "u", "2"), given("no", "n"), given("nul", None, "2"), given("more", "m")], "source_id string, hash string, content string, category string, keywords array<string>, source_name string, title string, chunk_index int, chunk_count int, version string, embedding array<double>")
    moved, merge = [], Table.merge
    monkeypatch.setattr(Table, "merge", lambda self, changes, *a, **k: moved.append({r.hash: r.content for r in changes.collect()}) or merge(self, changes, *a, **k))
    assert corpus.applied_sync(table, new, F.lit("now"))[1] == {"imported": 2, "skipped": 4, "deactivated": 1, "changed": 6}
    assert moved == [{"gone": None, "off": None, "re": "after", "up": None, "nul": None, "more": "m"}]
    assert {(r.hash, r.content, r.is_active, r.version) for r in table.read().collect()} == {("gone", "g", False, "1"), ("off", "o", True, "1"), ("re", "after", True, "1"), ("up", "u", True, "2"), ("no", "n", True, "1"), ("nul", None, True, "2"), ("more", "m", True, "1")}
    assert table.merge(table.read().withColumn("content", F.lit("x")).withColumn("keep", F.lit(True)), same={"content": "keep"}) == (2, {"added": 0, "updated": 0, "unchanged": 7, "deleted": 0})


class FakeService:
    """Answers by id and by how often a request came; counts go to a file."""

    def __init__(self, path):
        self.path, self.seen = path, {}

    def pages(self):
        return 3

    def page(self, number):
        return [(number * 10 + i, f"p{number}") for i in range(number)]

    def send(self, requests):
        out = []
        for r in requests:
            self.seen[r["id"]] = self.seen.get(r["id"], 0) + 1
            out.append({0: 201, 1: 409, 2: 422, 3: 503, 4: None if self.seen[r["id"]] < 3 else 200}[r["id"] % 5])
        return out

    def report(self, counts):
        import json

        with open(self.path, "w") as f:
            json.dump(counts, f)


def test_booking_source(spark, tmp_path):
    import json

    from pyspark import cloudpickle

    from tessera.sources import gateway

    cloudpickle.register_pickle_by_value(__import__(__name__))
    path = str(tmp_path / "counts.json")
    gateway.register_bookings(spark, "fake_bookings", FakeService(path), "id long, page string")
    got = spark.read.format("fake_bookings").load()
    assert got.rdd.getNumPartitions() == 3 and sorted((r.id, r.page) for r in got.collect()) == [(10, "p1"), (20, "p2"), (21, "p2")]
    spark.range(50).repartition(4).select("id", F.lit("x").alias("page")).write.format("fake_bookings").option("batch", 7).option("pause", 0.01).mode("append").save()
    assert json.load(open(path)) == {"ok": 20, "conflict": 10, "request_error": 10, "unavailable": 10, "retries": 40}


def test_updates_of_one_key(spark):
    from tessera.operators import relational

    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    changes = spark.createDataFrame([(1, 1, "z", 5), (1, 2, "c", None), (3, 1, "n", 1)], "k int, at int, x string, y int")
    assert sorted(map(tuple, relational.updated(df, changes, "k", "at").collect())) == [(1, "c", 1), (2, "b", 2)]


def test_knowledge_base(spark, tmp_path):
    from tessera import service

    base = service.KnowledgeBase(spark, str(tmp_path / "k"), 4)
    one = base.add("Opening hours are nine to five", category="faq", keywords=["hours"])
    two = base.add(question=" Where? ", answer="Next to the station")
    with pytest.raises(ValueError):
        base.add(" ")
    assert base.entry(two)["content"] == "Where?\nNext to the station" and base.entry("none") is None
    assert [r.id for r in base.search("station hours", 5).collect()] == [two, one] or base.search("station hours", 5).count() == 2
    assert [r.id for r in base.search("hours", 5, category="faq").collect()] == [one] and base.status()["healthy"]
    kept = base.backup()
    assert base.update(one, "Open all night", category="faq") and not base.update("none", "x") and base.search("five").count() == 0
    assert base.delete(two) and not base.delete("none") and base.entries().count() == 1 and base.entries(inactive=True).count() == 2
    uploads = spark.createDataFrame([("a.md", b"# Massage\nshoulder " * 60), ("b.pdf", b"x"), ("c.txt", b" ")], "name string, content binary")
    counts, failed = base.import_documents(uploads)
    assert counts["imported"] > 1 and {(r.name, r.error) for r in failed.collect()} == {("b.pdf", "unsupported_type"), ("c.txt", "empty")}
    assert base.import_documents(uploads)[0]["changed"] == 0 and base.search("shoulder", 2).count() == 2
    base.restore(kept)
    assert base.entry(one)["content"].startswith("Opening") and base.search("shoulder").count() == 0 and base.search("station").count() == 1
    assert base.delete(one, hard=True) and base.entry(one) is None
    with pytest.raises(ValueError):
        base.restore(99)
