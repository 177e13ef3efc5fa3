"""Row-level queries: documents stand for the knowledge base, supplier and part for other dimensions."""

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.operators import relational as op
from tessera.operators.corpus import question_and_answer
from tessera.plans.base import query
from tessera.session import shared_folder
from tessera.sources import files, jsonl


@query("SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0")
def scan_active_docs(t):
    return op.active(t.documents.withColumn("is_active", F.col("doc_id") % 5 != 0), "is_active").select("doc_id", "source")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def point_lookup(t):
    return t.supplier.filter("s_suppkey = 7").limit(1).select("s_suppkey", "s_name")


@query("SELECT lang AS category, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def docs_by_category(t):
    return t.documents.filter("doc_id % 5 <> 0").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_categories(t):
    return t.documents.select("source").distinct().na.drop()


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src3'])")
def keyword_overlap_search(t):
    return t.documents.filter(op.overlaps_keywords(F.array("lang", "source"), ["de", "src3"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the and')")
def content_search(t):
    return t.documents.filter(op.contains_ignoring_case(F.col("text"), "The And")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND contains(lower(source), 'rc1')")
def optional_filters(t):
    df = op.equal_where_given(t.documents, lang="fr", source=None)
    return df.filter(op.contains_ignoring_case(F.col("source"), "RC1")).select("doc_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE (SELECT count(*) FROM region WHERE r_regionkey < 0) = 0")
def seed_when_empty(t):
    return op.seed_if_empty(t.region.filter("r_regionkey < 0"), t.nation.select("n_nationkey", "n_name"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed ' || s_suppkey ELSE s_name END AS s_name FROM supplier")
def update_by_key(t):
    changes = t.supplier.filter("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("renamed "), F.col("s_suppkey").cast("string")).alias("s_name"))
    return op.updated(t.supplier.select("s_suppkey", "s_name"), changes, "s_suppkey")


@query("SELECT c_custkey, CASE WHEN o.at IS NULL THEN 'none' ELSE o.priority END AS priority, coalesce(o.at, 0) AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS priority, max(o_orderkey) AS at FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def update_by_last(t):
    """Many changes of a key: the last one counts as a row."""
    own = t.customer.select("c_custkey", F.lit("none").alias("priority"), F.lit(0).cast("long").alias("last_order"))
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("last_order"))
    return op.updated(own, changes, "c_custkey", "at")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def insert_new(t):
    """Suppliers whose key no nation has join the nations; each comes twice."""
    new = t.supplier.select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    return op.inserted(t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), new.unionByName(new), "k")


@query("SELECT r_regionkey AS k, r_name AS name, 3 AS versions, 4 AS newest FROM region")
def snapshot_restore(t):
    """Regions, nations and suppliers as versions of one table; then the first one is made the newest again."""
    folder = f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}"
    named = lambda df, p: df.select(F.col(f"{p}_{'suppkey' if p == 's' else 'regionkey' if p == 'r' else 'nationkey'}").cast("long").alias("k"), F.col(f"{p}_name").alias("name"))
    first = files.write_snapshot(named(t.region, "r"), folder)
    files.write_snapshot(named(t.nation, "n"), folder)
    files.write_snapshot(named(t.supplier, "s"), folder)
    newest = files.restore_snapshot(t.spark, folder, first)
    return files.read_snapshot(t.spark, folder).select("k", "name", F.lit(newest - 1).alias("versions"), F.lit(files.generation(t.spark, folder)).alias("newest"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'unsupported_type' WHEN 3 THEN 'not_utf8' WHEN 4 THEN 'empty' WHEN 5 THEN CASE WHEN strlen(text) > 1000 THEN 'too_large' END END AS error, CASE WHEN doc_id % 6 IN (1, 2) OR (doc_id % 6 = 5 AND strlen(text) <= 1000) THEN sha256(text) END AS text FROM documents WHERE text <> ''")
def upload_decode(t):
    """Documents as uploads: of a wrong type, with a byte order mark, plain, not UTF-8, blank, and plain under a limit."""
    k = F.col("doc_id") % 6
    raw = F.col("text").cast("binary")
    content = F.when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), raw)).when(k == 3, F.concat(raw, F.lit(b"\xff"))).when(k == 4, F.lit(b" ")).otherwise(raw)
    up = t.documents.filter("text <> ''").select("doc_id", F.when(k == 0, "a.pdf").otherwise("b.MD").alias("name"), content.alias("content"))
    done = files.decode_uploads(up.filter(k != 5)).unionByName(files.decode_uploads(up.filter(k == 5), most=1000))
    return done.select("doc_id", "error", F.sha2("text", 256).alias("text"))


@query("SELECT event_id, sha256(event_type) AS event_type_sha256, sha256(CAST(user_id AS VARCHAR)) AS user_sha256 FROM events")
def log_privacy(t):
    return jsonl.privacy_safe(t.events.select("event_id", "event_type", F.col("user_id").cast("string").alias("user")), ["event_type", "user"])


@query("SELECT event_id, user_id FROM events")
def log_replay(t):
    """A stream of events into a log whose first batch fails after it is written; the next run writes it anew, once."""
    folder = f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).select("event_id", "user_id")

    def fails(batch, number):
        raise ValueError("lost its connection")

    try:
        jsonl.log_stream(stream, f"{folder}/log", f"{folder}/checkpoint", fails).awaitTermination()
    except StreamingQueryException:
        pass
    jsonl.log_stream(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    good, bad = jsonl.read_log(t.spark, f"{folder}/log", "event_id long, user_id long")
    return good.unionByName(bad.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id")))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'What is ' || source || '?' || chr(10) || lang WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN 'What is ' || source || '?' ELSE '' END) AS content FROM documents")
def entry_content(t):
    """Entries of a question and its answer, with blank or missing parts."""
    k = F.col("doc_id") % 4
    q = F.when(k.isin(0, 2), F.concat(F.lit(" What is "), "source", F.lit("? "))).when(k == 1, " ")
    return t.documents.select("doc_id", F.sha2(question_and_answer(q, F.when(k < 2, F.col("lang"))), 256).alias("content"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 3 = 0 AND e.vec_id IS NOT NULL THEN len(e.embedding) ELSE CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE 1 END END AS size FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_backfill(t):
    own = t.documents.select("doc_id", (F.col("doc_id") % 3).alias("version"), F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("embedding"))
    new = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("version"), F.col("embedding").cast("array<double>").alias("embedding"))
    return op.backfilled(own, new, "doc_id", "version", "embedding").select("doc_id", F.size("embedding").cast("long").alias("size"))


@query("SELECT doc_id, doc_id % 4 <> 1 AS is_active FROM documents")
def soft_delete(t):
    return op.deleted(t.documents.select("doc_id", F.lit(True).alias("is_active")), t.documents.filter("doc_id % 4 = 1").select("doc_id"), "doc_id", "is_active")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def hard_delete(t):
    return op.deleted(t.documents.select("doc_id"), t.documents.filter("doc_id % 4 = 1").select("doc_id"), "doc_id")


@query("SELECT event_id, event_id % 10 = 3 AS is_sent, CASE WHEN event_id % 10 = 3 THEN TIMESTAMP '2024-02-01' END AS sent_at FROM events")
def mark_sent(t):
    sent = F.col("event_id") % 10 == 3
    return t.events.select("event_id", sent.alias("is_sent"), F.when(sent, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("sent_at"))


@query("""SELECT source, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN e = a THEN 'matches' ELSE 'mismatched' END AS state FROM
(SELECT source, list_sort(list(DISTINCT md5(text))) AS e FROM documents WHERE source <> 'src1' GROUP BY 1) FULL JOIN
(SELECT source, list_sort(list(DISTINCT md5(text))) AS a FROM documents WHERE source <> 'src2' AND doc_id % 50 <> 9 GROUP BY 1) USING (source)""")
def hash_set_comparison(t):
    df = t.documents.select("source", "doc_id", F.md5("text").alias("h"))
    return op.set_comparison(df.filter("source <> 'src1'"), df.filter("source <> 'src2' AND doc_id % 50 <> 9"), "source", "h")


@query("""SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN NOT e THEN 'extra' ELSE 'repeated' END AS problem FROM (SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, d.doc_id IS NOT NULL AS e, n FROM documents d FULL JOIN
(SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 9 <> 2 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT -1) GROUP BY 1) a ON a.doc_id = d.doc_id) WHERE n IS NULL OR NOT e OR n > 1""")
def result_completeness(t):
    ids = t.documents.select("doc_id")
    actual = ids.filter("doc_id % 9 <> 2").unionAll(ids.filter("doc_id % 9 = 4")).unionAll(t.spark.sql("SELECT CAST(-1 AS BIGINT) AS doc_id"))
    return op.completeness(ids, actual, "doc_id")


@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id % 5 <> 0 DESC, doc_id) = 1")
def hash_lookup_active_first(t):
    df = t.documents.select("doc_id", "source", F.md5("text").alias("h"), (F.col("doc_id") % 5 != 0).alias("active"))
    return op.first_match(df, ["source", "h"], [F.desc("active"), F.asc("doc_id")]).select("doc_id", "h")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT lang) FROM documents) AS categories, (SELECT count(*) FROM supplier) AS technicians")
def dashboard_counts(t):
    left = t.documents.agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("categories"))
    return left.crossJoin(t.supplier.agg(F.count("*").alias("technicians")))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN k = 9 THEN 'conflict' WHEN k BETWEEN 40 AND 49 THEN 'request_error' WHEN k >= 50 THEN 'unavailable' ELSE 'ok' END AS status FROM (SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 60 = 49 THEN 9 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 60 END AS k FROM events)) GROUP BY 1")
def gateway_status(t):
    from tessera.sources.gateway import outcome

    k = F.get_json_object("props", "$.k").cast("long") % 60
    code = F.when((k == 49) | (k == 9), 409).when(k.between(40, 48), 400 + k - 40).when(k >= 50, 500 + k - 50).otherwise(200)
    return t.events.select(outcome(code).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
