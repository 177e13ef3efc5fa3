"""The engine's surface for an application: thin functions from tables and parameters to one DataFrame each.

A web server would call these and send their rows; nothing here opens a port.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import behaviour, corpus, metrics, relational, retrieval, scheduling
from tessera.operators.index import InvertedIndex
from tessera.sources import files, jsonl
from tessera.sources.commits import Table


def knowledge_entries(docs: DataFrame, category: str | None = None, source_id: str | None = None, text: str | None = None, inactive: bool = False) -> DataFrame:
    """Entries of the knowledge base (doc_id, source_id, category, text, is_active) by the filters that are given."""
    own = relational.equal_where_given(relational.active(docs, "is_active", inactive), category=category, source_id=source_id)
    return own.filter(relational.contains_ignoring_case(F.col("text"), text))


def knowledge_import(old: DataFrame, new: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row an action, counts by source) of bringing a new version of sources in; see corpus.sync_plan()."""
    plan = corpus.sync_plan(old, new, fields)
    return plan, corpus.sync_counts(plan)


def knowledge_search(docs: DataFrame, queries: DataFrame, strategy: str = "hybrid", k: int = 3, category: str | None = None, expanded: bool = False) -> DataFrame:
    """The first k documents of each query (item_id, text, embedding) with their scores. With a category the whole
    corpus is ranked before it is looked at."""
    find = retrieval.retriever(strategy)
    if category:
        return retrieval.in_category(find(docs, queries, "doc_id", "item_id"), docs, "item_id", "doc_id", "category", category, k)
    pool = max(4 * k, 10) if expanded else 2 * k
    return find(docs, queries, "doc_id", "item_id", pool).filter(F.col("rank") <= k)


class KnowledgeBase:
    """The stored knowledge base of a folder: entries, imports, versions, and an index that follows them.

    Each change is one version of the table; a reader sees whole versions, and the index is brought up to a version's active
    entries when it is searched. ValueError names what is wrong with a request; None or False stand for an unknown id."""

    SCHEMA = "id string, source_id string, hash string, is_active boolean, updated_at string, content string, category string, keywords array<string>, source_name string, title string, chunk_index int, chunk_count int, version string, embedding array<double>"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.table = spark, Table(spark, f"{folder}/entries", "id", buckets, by="source_id")
        self.index = InvertedIndex(spark, f"{folder}/index", buckets)
        if self.table.log.newest() is None:
            self.table.replace(spark.createDataFrame([], self.SCHEMA))

    def entries(self, category: str | None = None, source_id: str | None = None, text: str | None = None, inactive: bool = False) -> DataFrame:
        own = relational.equal_where_given(relational.active(self.table.read(), "is_active", inactive), category=category, source_id=source_id)
        return own.filter(relational.contains_ignoring_case(F.col("content"), text))

    def entry(self, id_: str) -> dict | None:
        row = self.table.read().filter(F.col("id") == id_).first()
        return row.asDict(True) if row else None

    def add(self, content: str | None = None, question: str | None = None, answer: str | None = None, category: str = "general", keywords: list[str] | None = None) -> str:
        """A new entry from its content, or from a question and its answer; its id, which is its source's too."""
        id_ = uuid.uuid4().hex
        self._put(id_, id_, self._content(content, question, answer), category, keywords, {})
        return id_

    def update(self, id_: str, content: str | None = None, question: str | None = None, answer: str | None = None, category: str = "general", keywords: list[str] | None = None) -> bool:
        held = self.entry(id_)
        if not held:
            return False
        self._put(id_, held["source_id"], self._content(content, question, answer), category, keywords, held)
        return True

    def delete(self, id_: str, hard: bool = False) -> bool:
        """Take an entry out of all answers, or with `hard`, out of the table."""
        row = self.table.read().filter(F.col("id") == id_)
        if row.isEmpty():
            return False
        self.table.merge(row.withColumn("is_active", F.lit(False)).withColumn("gone", F.lit(hard)), "gone")
        return True

    def _content(self, content: str | None, question: str | None, answer: str | None) -> str:
        one = self.spark.createDataFrame([(content, question, answer)], "c string, q string, a string")
        text = one.select(F.coalesce(F.nullif(F.trim("c"), F.lit("")), corpus.question_and_answer(F.col("q"), F.col("a")))).first()[0]
        if not text:
            raise ValueError("an entry needs a content, or a question and an answer")
        return text

    def _put(self, id_: str, source: str, content: str, category: str, keywords: list[str] | None, held: dict) -> None:
        row = {"title": None, "source_name": None, "chunk_index": 0, "chunk_count": 1, "version": None, "is_active": True} | held
        row |= {"id": id_, "source_id": source, "content": content, "category": category, "keywords": keywords or [], "embedding": None}
        df = self.spark.createDataFrame([row], self.SCHEMA).withColumn("hash", corpus.content_hash(F.col("content"))).withColumn("updated_at", F.current_timestamp().cast("string"))
        self.table.merge(df)

    def import_documents(self, uploads: DataFrame, category: str = "general", size: int = corpus.SIZE, overlap: int = corpus.OVERLAP) -> tuple[dict[str, int], DataFrame]:
        """Bring (name, content) files in as chunks, each file a source: (counts, the files with an error). A file whose
        name is there replaces its chunks."""
        decoded = files.decode_uploads(uploads)
        good = decoded.filter("error IS NULL").select("name", "text")
        chunks = corpus.chunk_documents(good, "name", "text", size=size, overlap=overlap)
        failed = decoded.filter("error IS NOT NULL").select("name", "error").unionByName(chunks.filter("error IS NOT NULL").select("name", "error"))
        chunks = chunks.filter("error IS NULL").withColumn("hash", corpus.content_hash(F.col("content")))
        whole = chunks.groupBy("name").agg(F.count("*").cast("int").alias("chunk_count"))
        kept = corpus.deduplicated(chunks, "name", "hash", "chunk_index").join(whole, "name")
        new = kept.select(F.col("name").alias("source_id"), "hash", "content", F.lit(category).alias("category"), F.array().cast("array<string>").alias("keywords"), F.col("name").alias("source_name"), "title", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_count", F.lit(None).cast("string").alias("version"), F.lit(None).cast("array<double>").alias("embedding"))
        return corpus.applied_sync(self.table, new, F.current_timestamp().cast("string"))[1], failed

    def search(self, query: str, k: int = 3, category: str | None = None) -> DataFrame:
        """(id, score, rank, content, category, source_id) of the first k active entries by BM25."""
        if not (query or "").strip():
            raise ValueError("a search needs a query")
        active = self.entries()
        text = retrieval.search_text(F.col("source_id"), F.col("title"), F.col("content"), F.col("keywords"))
        self.index.refresh(active.select(F.xxhash64("id").alias("doc_id"), text.alias("text")))
        asked = self.spark.createDataFrame([(0, query)], "q long, text string")
        found = self.index.search(asked, "q", k if category is None else max(1, active.count())).drop("q")
        own = found.join(active.select(F.xxhash64("id").alias("doc_id"), "id", "content", "category", "source_id"), "doc_id").drop("doc_id")
        own = own.filter(F.col("category") == category) if category else own
        return own.orderBy("rank").limit(k)

    def backup(self) -> int:
        """The version to come back to; every version stays until it is vacuumed."""
        return self.table.log.newest()

    def restore(self, version: int) -> int:
        """Make a version the newest again; the present one stays as a safety copy. ValueError for an unknown one."""
        return files.restore_snapshot(self.spark, self.table.log.folder, version)

    def status(self) -> dict:
        """Counts, versions, and whether the index holds the active entries as they are."""
        sums = self.table.read().agg(F.count("*"), F.count_if("is_active"), F.countDistinct("source_id")).first()
        index = self.index.log.entry() or {"n": 0}
        return {"entries": sums[0], "active": sums[1], "sources": sums[2], "generation": self.table.log.newest(), "indexed": index["n"], "healthy": index["n"] == sums[1]}


def knowledge_health(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row: active documents, indexed ones, and whether they are the same."""
    active = relational.active(docs, "is_active").agg(F.count("*").alias("active"))
    return active.crossJoin(index.agg(F.count("*").alias("indexed"))).withColumn("healthy", F.col("active") == F.col("indexed"))  # one row each


def recent_metrics(lines: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, bad lines) of the usage log's lines from an instant on."""
    schema = "recorded_at string, usage struct<logical_calls: bigint, failed_calls: bigint, total_tokens: bigint, estimated_input_tokens: bigint>, cost struct<status: string, total_cny: double>"
    events, bad = jsonl.parsed_lines(lines, schema, "recorded_at", since)
    return metrics.usage_summary(events), bad


def user_analysis(events: DataFrame, user: str, kind: str, ts: str, asof: str, days: int | None = None) -> DataFrame:
    """Counts, cadence label and return reminder of each user's events."""
    own = behaviour.within_days(events, ts, asof, days)
    counts = behaviour.activity_counts(own, user, kind, {"appointments": "appointment", "consultations": "consultation"})
    remind = behaviour.return_reminder(own.filter(F.col(kind) == "appointment"), user, ts, asof).select(user, "days_since", "remind")
    return counts.join(remind, user, "left").withColumn("label", behaviour.activity_label(F.col("appointments"), F.col("total"))).withColumn("remind", F.coalesce("remind", F.lit(False)))


def day_schedule(busy: DataFrame, key: str, day: str) -> DataFrame:
    """What lies in a day, in local hours and minutes."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    own = busy.filter(relational.overlap(F.col("start_time"), F.col("end_time"), start, start + F.expr("INTERVAL 1 DAY")))
    return own.select("*", scheduling.clock(F.col("start_time")).alias("from"), scheduling.clock(F.col("end_time")).alias("to")).orderBy(key, "start_time")


def availability(people: DataFrame, busy: list[DataFrame], key: str, start: Column, minutes: int, gender: str | None = None, strength: str | None = None) -> DataFrame:
    return scheduling.searched(people, busy, key, start, F.lit(minutes), gender, strength)
