"""Corpus queries over documents."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import corpus as op
from tessera.operators.relational import set_comparison
from tessera.plans.base import query
from tessera.plans.retrieval import spread
from tessera.session import checkpointed, shared_folder
from tessera.sources.commits import Table

HASH = r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))"
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(ltrim(text, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
CHUNKS = rf"""c AS (WITH RECURSIVE d AS (SELECT doc_id, {NORMAL} AS t FROM documents), r(doc_id, t, k, s, e) AS (
SELECT doc_id, t, -1, 0, 0 FROM d UNION ALL
SELECT doc_id, t, k + 1, s2, CASE WHEN s2 + 500 >= length(t) THEN length(t) ELSE s2 + 250 + coalesce(nullif(250 - strpos(reverse(w), chr(10)) + 1, 251), nullif(250 - strpos(reverse(w), '.') + 1, 251), nullif(250 - strpos(reverse(w), '!') + 1, 251), nullif(250 - strpos(reverse(w), '?') + 1, 251), 250) END
FROM (SELECT *, substr(t, s2 + 251, 250) AS w FROM (SELECT *, CASE WHEN k < 0 THEN 0 ELSE greatest(s + 1, e - 100) + length(regexp_extract(substr(t, greatest(s + 1, e - 100) + 1, e - greatest(s + 1, e - 100)), '^\s*')) END AS s2 FROM r WHERE (k < 0 AND length(t) > 0) OR (k >= 0 AND e < length(t)))))
SELECT doc_id, k AS chunk_index, regexp_replace(substr(t, s + 1, e - s), '^\s+|\s+$', '', 'g') AS content, count(*) OVER (PARTITION BY doc_id) AS n FROM r WHERE k >= 0)"""


def chunked(t):
    return op.chunk_documents(spread(t.documents.select("doc_id", "text")), "doc_id", "text")


@query(rf"SELECT doc_id, sha256({NORMAL}) AS normal, {HASH} AS hash, sha256(replace(text, chr(13) || chr(10), chr(10))) AS file_hash FROM documents")
def doc_normalize_hash(t):
    return t.documents.select("doc_id", F.sha2(op.normalized(F.col("text")), 256).alias("normal"), op.content_hash(F.col("text")).alias("hash"), op.file_hash(F.col("text")).alias("file_hash"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'own-' || doc_id WHEN doc_id % 7 = 1 THEN 'front-' || doc_id ELSE sha256(lower('DOC.md') || chr(0) || text) END AS source_id, CASE WHEN lang <> 'en' THEN lang WHEN doc_id % 2 = 0 THEN 'faq' ELSE 'general' END AS category FROM documents")
def source_ids(t):
    name = lambda kind, k: F.when(F.col("doc_id") % 7 == k, F.concat(F.lit(kind), F.col("doc_id").cast("string")))
    asked = F.when(F.col("lang") != "en", F.col("lang")).otherwise("general")
    return t.documents.select("doc_id", op.source_id(name("own-", 0), name("front-", 1), F.lit("DOC.md"), F.col("text")).alias("source_id"), op.category(asked, F.when(F.col("doc_id") % 2 == 0, "faq")).alias("category"))


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(content) AS content, CAST(NULL AS VARCHAR) AS error FROM c WHERE n <= 200 UNION ALL SELECT DISTINCT doc_id, NULL, NULL, 'too_many_chunks' FROM c WHERE n > 200")
def chunk_documents(t):
    return chunked(t).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content"), "error")


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(content) AS content, CAST(NULL AS VARCHAR) AS error FROM c WHERE n <= 200 UNION ALL SELECT DISTINCT doc_id, NULL, NULL, 'too_many_chunks' FROM c WHERE n > 200")
def chunks_lateral(t):
    """chunk_documents() as a table function in SQL."""
    op.register_chunk_table(t.spark)
    parts = spread(t.documents.select("doc_id", "text")).select("doc_id", op.sections(op.normalized(F.col("text")), F.lit("")).alias("parts"))
    return t.spark.sql("SELECT d.doc_id, c.chunk_index, sha2(c.content, 256) AS content, c.error FROM {d} AS d, LATERAL chunk_table(d.parts, 500, 100, 200) AS c", d=parts)


@query(rf"""WITH {CHUNKS}, h AS (SELECT source, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS hash, c.doc_id * 1000 + chunk_index AS place FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE n <= 200)
SELECT source, hash, min(place) AS place, count(*) AS copies FROM h GROUP BY 1, 2""")
def chunk_dedup(t):
    df = chunked(t).filter("error IS NULL").join(t.documents.select("doc_id", "source"), "doc_id")
    df = df.select("source", op.content_hash(F.col("content")).alias("hash"), (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("place"))
    return op.deduplicated(df, "source", "hash", "place")


HEADED = r"""h AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'plain' WHEN doc_id % 11 = 1 THEN 'missing_colon' WHEN doc_id % 11 = 2 THEN 'missing_close' WHEN doc_id % 11 = 4 THEN 'bad_keywords' ELSE 'ok' END AS form, regexp_replace(text, '\r\n?', chr(10), 'g') AS body FROM documents)"""


def headed(t):
    """Documents behind front matter of several forms, broken ones too; every third has none."""
    fields = F.concat(F.lit("---\nsource_id: src-"), F.col("doc_id").cast("string"), F.lit("\ntitle: 'T "), F.col("lang"), F.lit("'\n# a comment\nkeywords: ["), F.col("lang"), F.lit(', "'), F.col("source"), F.lit(', x"]\nversion: '), (F.col("doc_id") % 7).cast("string"), F.lit("\n---\n\n"))
    broken = F.when(F.col("doc_id") % 11 == 1, "---\nno colon\n---\n").when(F.col("doc_id") % 11 == 2, "---\ntitle: x\n").when(F.col("doc_id") % 11 == 4, "---\nkeywords: a, b\n---\n").otherwise(fields)
    form = F.when(F.col("doc_id") % 11 == 2, F.concat(broken, F.replace("text", F.lit("---"), F.lit("==")))).otherwise(F.concat(broken, "text"))
    return spread(t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#"), "text")).otherwise(form).alias("text")))


@query(f"""WITH {HEADED} SELECT doc_id, CASE WHEN form = 'ok' THEN 'src-' || doc_id END AS source_id, CASE WHEN form = 'ok' THEN 'T ' || lang END AS title, CASE WHEN form = 'ok' THEN lang || '|' || source || ', x' ELSE '' END AS keywords, CASE WHEN form = 'ok' THEN CAST(doc_id % 7 AS VARCHAR) END AS version,
CASE form WHEN 'ok' THEN sha256(regexp_replace(body, '^\n+', '')) WHEN 'plain' THEN sha256('#' || body) END AS body, CASE WHEN form NOT IN ('ok', 'plain') THEN form END AS error FROM h""")
def front_matter(t):
    own = op.with_front_matter(headed(t), "text").select("doc_id", "front.*")
    return own.select("doc_id", "source_id", "title", F.array_join("keywords", "|").alias("keywords"), "version", F.sha2("body", 256).alias("body"), "error")


@query(r"""WITH p AS (SELECT doc_id, 1 AS k, 't' AS title, 'intro' AS body FROM documents UNION ALL SELECT doc_id, 2, 'One', regexp_replace(replace(text, '#', ' '), '^\s+|\s+$', '', 'g') FROM documents UNION ALL SELECT doc_id, 3, 'Two ' || lang, source FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, title, sha256(body) AS body FROM p WHERE body <> ''""")
def document_sections(t):
    """Texts with headings, one of them without anything below it."""
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n  ## Two "), F.col("lang"), F.lit(" ##\n"), F.col("source"), F.lit("\n# Empty"))).otherwise("")
    text = F.concat(F.lit("intro\n# One\n"), F.replace("text", F.lit("#"), F.lit(" ")), tail)
    df = spread(t.documents.select("doc_id", text.alias("text"))).select("doc_id", F.posexplode(op.sections(F.col("text"), F.lit("t"))).alias("place", "s"))
    return df.select("doc_id", F.col("place").cast("long").alias("place"), "s.title", F.sha2("s.body", 256).alias("body"))


SYNC = """WITH o AS (SELECT doc_id AS id, source AS source_id, md5(text) AS hash, doc_id % 6 <> 0 AS is_active, lang AS category FROM documents WHERE doc_id % 10 <> 3),
n AS (SELECT source AS source_id, md5(text) AS hash, CASE WHEN min(doc_id) % 8 = 0 THEN 'x' ELSE min(lang) END AS category FROM documents WHERE doc_id % 9 <> 4 GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY source_id, hash ORDER BY is_active DESC, id) AS r FROM o),
a AS (SELECT coalesce(p.source_id, n.source_id) AS source_id, coalesce(p.hash, n.hash) AS hash, id, CASE WHEN p.id IS NULL THEN 'insert' WHEN n.hash IS NULL OR r > 1 THEN CASE WHEN is_active THEN 'deactivate' END WHEN NOT is_active THEN 'reactivate' WHEN p.category IS DISTINCT FROM n.category THEN 'update' ELSE 'noop' END AS action
FROM p FULL JOIN n ON n.source_id = p.source_id AND n.hash = p.hash), f AS (SELECT * FROM a WHERE action IS NOT NULL)"""


def plan(t):
    df = t.documents.select("doc_id", F.col("source").alias("source_id"), F.md5("text").alias("hash"), "lang")
    old = df.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("id"), "source_id", "hash", (F.col("doc_id") % 6 != 0).alias("is_active"), F.col("lang").alias("category"))
    new = df.filter("doc_id % 9 <> 4").groupBy("source_id", "hash").agg(F.when(F.min("doc_id") % 8 == 0, "x").otherwise(F.min("lang")).alias("category"))
    return op.sync_plan(old, new, ["category"])


@query(f"{SYNC} SELECT source_id, hash, id, action FROM f")
def sync_merge(t):
    return plan(t)


@query(f"{SYNC} SELECT source_id, count(*) FILTER (action IN ('insert', 'reactivate')) AS imported, count(*) FILTER (action IN ('update', 'noop')) AS skipped, count(*) FILTER (action = 'deactivate') AS deactivated, count(*) FILTER (action IN ('insert', 'reactivate', 'update', 'deactivate')) AS changed FROM f GROUP BY 1")
def sync_counts(t):
    return op.sync_counts(plan(t))


@query(f"{SYNC} SELECT count(DISTINCT source_id) AS sources, count(*) AS rows, count(*) FILTER (action IN ('insert', 'reactivate')) AS imported, count(*) FILTER (action IN ('update', 'noop')) AS skipped, count(*) FILTER (action = 'deactivate') AS deactivated, count(*) FILTER (action IN ('insert', 'reactivate', 'update', 'deactivate')) AS changed FROM f")
def sync_totals(t):
    return op.sync_counts(plan(t), totals=True)


#: Which fields of the sync below differ: category by language, version by id, embedding where one is supplied.
APPLIED = """WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS source_id, md5(text) AS hash, doc_id % 6 <> 0 AS is_active, lang AS category, 'v' || doc_id % 3 AS version, [doc_id % 7] AS embedding FROM documents WHERE doc_id % 10 <> 3 AND source <> 'src1'
UNION ALL SELECT 'x' || doc_id, doc_id, source, md5('gone' || doc_id), true, lang, 'v0', [1] FROM documents WHERE doc_id % 10 = 3),
n AS (SELECT source AS source_id, md5(text) AS hash, min(lang) AS category, 'v' || min(doc_id) % 2 AS version, CASE WHEN min(doc_id) % 4 = 0 THEN [min(doc_id) % 5] END AS embedding FROM documents WHERE source <> 'src2' AND doc_id % 9 <> 4 GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY source_id, hash ORDER BY is_active DESC, id) AS r FROM o),
f AS (SELECT coalesce(id, sha256(coalesce(p.source_id, n.source_id) || chr(0) || coalesce(p.hash, n.hash))) AS id, coalesce(p.source_id, n.source_id) AS source_id, coalesce(p.hash, n.hash) AS hash, n.hash IS NOT NULL AND coalesce(r, 1) = 1 AS matched, p.source_id IN (SELECT source_id FROM n) AS named, p.is_active AS was, p.category AS c0, n.category AS c1, p.version AS v0, n.version AS v1, p.embedding AS e0, n.embedding AS e1 FROM p FULL JOIN n ON n.source_id = p.source_id AND n.hash = p.hash)"""


@query(f"{APPLIED} SELECT id, source_id, hash, CASE WHEN matched THEN true WHEN named THEN false ELSE was END AS is_active, CASE WHEN matched THEN c1 ELSE c0 END AS category, CASE WHEN matched THEN v1 ELSE v0 END AS version, CAST(CASE WHEN matched THEN coalesce(e1, e0) ELSE e0 END[1] AS BIGINT) AS embedding, 2 AS versions FROM f")
def sync_applied(t):
    """A stored table after two syncs with the same chunks, of which the second changes nothing: its rows and versions."""
    d = t.documents.withColumn("hash", F.md5("text"))
    fixed = [F.col("text").alias("content"), F.array("lang").alias("keywords"), F.col("source").alias("source_name"), F.col("source").alias("title"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count")]
    held = d.filter("doc_id % 10 <> 3 AND source <> 'src1'").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), "hash", (F.col("doc_id") % 6 != 0).alias("is_active"), F.lit("2024-01-01").alias("updated_at"), F.col("lang").alias("category"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"), F.array(F.col("doc_id") % 7).alias("embedding"), *fixed)
    gone = d.filter("doc_id % 10 = 3").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("source_id"), F.md5(F.concat(F.lit("gone"), F.col("doc_id").cast("string"))).alias("hash"), F.lit(True).alias("is_active"), F.lit("2024-01-01").alias("updated_at"), F.col("lang").alias("category"), F.lit("v0").alias("version"), F.array(F.lit(1).cast("long")).alias("embedding"), *fixed)
    new = d.filter("source <> 'src2' AND doc_id % 9 <> 4").groupBy("source", "hash").agg(F.min("lang").alias("category"), F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    new = new.select(F.col("source").alias("source_id"), "hash", "category", F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("version"), F.when(F.col("doc_id") % 4 == 0, F.array(F.col("doc_id") % 5)).alias("embedding"), F.col("text").alias("content"), F.array("category").alias("keywords"), F.col("source").alias("source_name"), F.col("source").alias("title"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"))
    table = Table(t.spark, f"{shared_folder(t.spark)}/chunks-{uuid.uuid4().hex}", "id", 16, by="source_id")
    table.replace(held.unionByName(gone))
    new = checkpointed(new)
    for day in ("2024-02-01", "2024-03-01"):
        op.applied_sync(table, new, F.lit(day), stored=True)
    return table.read().select("id", "source_id", "hash", "is_active", "category", "version", F.get("embedding", F.lit(0)).alias("embedding"), F.lit(len(table.log.versions())).alias("versions"))


@query(rf"""WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS document_count, count(*) AS chunk_count FROM c WHERE n <= 200""")
def manifest_totals(t):
    return op.manifest_totals(op.manifest(chunked(t).filter("error IS NULL"), "doc_id", "chunk_index", "content"))


@query(rf"""WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CASE WHEN doc_id % 10 = 3 THEN 'missing' ELSE 'changed' END AS problem FROM c WHERE n <= 200 AND (doc_id % 10 = 3 OR (doc_id % 10 = 4 AND chunk_index = 1))""")
def manifest_verify(t):
    """A manifest against a corpus from which documents went and in which chunks were changed."""
    df = chunked(t).filter("error IS NULL")
    changed = (F.col("doc_id") % 10 == 4) & (F.col("chunk_index") == 1)
    now = df.filter("doc_id % 10 <> 3").withColumn("content", F.when(changed, F.concat(F.lit("new "), "content")).otherwise(F.col("content")))
    own = op.verified(op.manifest(df, "doc_id", "chunk_index", "content"), now, "doc_id", "chunk_index", "content")
    return own.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(rf"""WITH {CHUNKS} SELECT doc_id, count(*) AS chunk_count, sha256(string_agg(sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))), ',' ORDER BY chunk_index)) AS digest FROM c WHERE n <= 200 GROUP BY 1""")
def manifest(t):
    own = op.manifest(chunked(t).filter("error IS NULL"), "doc_id", "chunk_index", "content")
    return own.select("doc_id", "chunk_count", F.sha2(F.array_join("chunk_sha256", ","), 256).alias("digest"))


@query("""SELECT source, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN e = a THEN 'matches' ELSE 'mismatched' END AS state FROM
(SELECT source, list_sort(list(DISTINCT sha256(text))) AS e FROM documents WHERE lang <> 'es' GROUP BY 1) FULL JOIN (SELECT source, list_sort(list(DISTINCT sha256(text))) AS a FROM documents WHERE lang <> 'es' AND (source <> 'src4' OR lang <> 'de') GROUP BY 1) USING (source)""")
def drift_report(t):
    df = t.documents.filter("lang <> 'es'").select("source", "lang", F.sha2("text", 256).alias("h"))
    return set_comparison(df, df.filter("source <> 'src4' OR lang <> 'de'"), "source", "h")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS active, (SELECT count(*) FROM embeddings) AS indexed, (SELECT max(doc_id) FROM documents) AS generation")
def index_health(t):
    left = t.documents.agg(F.count_if(F.col("doc_id") % 5 != 0).alias("active"), F.max("doc_id").alias("generation"))
    return left.crossJoin(t.embeddings.agg(F.count("*").alias("indexed"))).select("active", "indexed", "generation")
