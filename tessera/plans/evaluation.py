"""Evaluation queries: a benchmark passage is the evidence for the question that its text asks."""

from pyspark.sql import functions as F

from tessera.operators import evaluation as op
from tessera.operators import metrics as m
from tessera.operators import retrieval as r
from tessera.plans.base import query
from tessera.plans.corpus import CHUNKS, chunked
from tessera.plans.retrieval import BM25, HYBRID, dense, hybrid, sparse, spread
from tessera.session import checkpointed

HIT = "contains(d.text, b.text)"


def hits(t, ranking):
    cases = t.benchmark
    both = ranking.join(t.documents.select("doc_id", "text"), "doc_id").join(cases.select("item_id", F.col("text").alias("needle")), "item_id")
    return op.first_hit(both, cases, "item_id", F.contains("text", F.col("needle")))


def summary(name, keys=""):
    own = f"(SELECT b.item_id, min(s.rank) FILTER ({HIT}) AS rank FROM benchmark b LEFT JOIN {name} s ON s.item_id = b.item_id LEFT JOIN documents d ON d.doc_id = s.doc_id GROUP BY 1)"
    cut = ", ".join(f"round_even(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))
    return f"SELECT {keys}count(*) AS cases, {cut}, round_even(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM {own}"


@query(f"WITH {BM25} {summary('sparse')}")
def recall_mrr(t):
    return m.ranking_summary(hits(t, sparse(t)), [])


@query(f"WITH {BM25} {summary('sparse', 'item_id % 3 AS grp, ')} GROUP BY 1")
def recall_by_group(t):
    return m.ranking_summary(hits(t, sparse(t)).withColumn("grp", F.col("item_id") % 3), ["grp"])


RERANKED = "reranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 ELSE -1 END DESC, rank) AS rank FROM fused WHERE rank <= 10)"


@query(f"{HYBRID}, {RERANKED} " + " UNION ALL ".join(summary(n, f"'{k}' AS strategy, item_id % 3 AS grp, ") + " GROUP BY ROLLUP (item_id % 3)" for n, k in (("dense", "dense"), ("sparse", "sparse"), ("fused", "hybrid"), ("reranked", "reranked"))))
def strategy_compare(t):
    """Four strategies, each overall (no group) and by group of cases; the re-ranker's scores are stand-ins."""
    fused = hybrid(t)
    scores = fused.filter("rank <= 10").select("item_id", "doc_id", F.col("rank").alias("coarse"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 10).cast("double")).alias("score"))
    ways = ((dense(t), "dense"), (sparse(t), "sparse"), (fused, "hybrid"), (r.reranked(scores, "item_id", "coarse", "score"), "reranked"))
    parts = [hits(t, x.select("item_id", "doc_id", "rank")).withColumn("strategy", F.lit(n)) for x, n in ways]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumn("grp", F.explode(F.array(F.col("item_id") % 3, F.lit(None).cast("long"))))
    return m.ranking_summary(every, ["strategy", "grp"])


@query(rf"""WITH {BM25}, e AS (SELECT b.item_id, b.text AS needle, CASE WHEN b.item_id % 5 = 4 THEN 'src1' ELSE d.source END AS source FROM benchmark b LEFT JOIN sparse s ON s.item_id = b.item_id AND s.rank = 2 LEFT JOIN documents d ON d.doc_id = s.doc_id),
h AS (SELECT e.item_id, min(s.rank) FILTER (d.source = e.source AND contains(d.text, e.needle)) AS strict, min(s.rank) FILTER (d.source = e.source) AS by_source FROM e LEFT JOIN sparse s ON s.item_id = e.item_id LEFT JOIN documents d ON d.doc_id = s.doc_id GROUP BY 1)
SELECT count(*) AS cases, round_even(avg(coalesce(strict <= 3, false)::INT::DOUBLE), 6) AS strict_recall_3, round_even(avg(coalesce(by_source <= 3, false)::INT::DOUBLE), 6) AS source_recall_3, round_even(avg(coalesce(1.0::DOUBLE / strict, 0)), 6) AS strict_mrr, round_even(avg(coalesce(1.0::DOUBLE / by_source, 0)), 6) AS source_mrr FROM h""")
def evidence_recall(t):
    """Hits of the expected source with the evidence in them, and of the source alone; every fifth case expects one source."""
    ranking = sparse(t).join(t.documents.select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    second = ranking.filter("rank = 2").select(F.col("item_id").alias("_i"), F.col("source").alias("_s"))
    cases = t.benchmark.join(second, F.col("item_id") == F.col("_i"), "left").select("item_id", F.col("text").alias("needle"), F.when(F.col("item_id") % 5 == 4, "src1").otherwise(F.col("_s")).alias("expected_source"))
    h = op.evidence_hits(ranking, cases, "item_id", "source", "needle")
    share = lambda c: F.bround(F.avg(F.coalesce(F.col(c) <= 3, F.lit(False)).cast("double")), 6)
    mrr = lambda c: F.bround(F.avg(F.coalesce(1 / F.col(c).cast("double"), F.lit(0.0))), 6)
    return h.agg(F.count("*").alias("cases"), share("strict").alias("strict_recall_3"), share("by_source").alias("source_recall_3"), mrr("strict").alias("strict_mrr"), mrr("by_source").alias("source_mrr"))


FORMS = rf"""WITH RECURSIVE {CHUNKS.replace('WITH RECURSIVE d AS', 'WITH RECURSIVE d AS', 1)}, pieces AS (SELECT 'whole' AS form, CAST(doc_id AS VARCHAR) AS piece, text FROM documents UNION ALL SELECT 'chunk', doc_id || ':' || chunk_index, content FROM c WHERE n <= 200),
tok AS (SELECT form, piece, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM pieces), tf AS (SELECT form, piece, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT form, piece, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT form, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT form, n, dl / n AS avgdl FROM (SELECT form, count(*)::DOUBLE AS n FROM pieces GROUP BY 1) JOIN (SELECT form, sum(dl)::DOUBLE AS dl FROM dl GROUP BY 1) USING (form)),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT form, item_id, piece, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (form, term) JOIN dl USING (form, piece) JOIN st USING (form) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form, item_id ORDER BY round(score, 9) DESC, piece) AS rank FROM sc) WHERE rank <= 10),
x AS (SELECT f.form, b.item_id, min(t.rank) FILTER (contains(p.text, b.text)) AS rank, sum(length(p.text)) FILTER (t.rank <= 3) AS chars FROM (VALUES ('whole'), ('chunk')) f(form) CROSS JOIN benchmark b LEFT JOIN top t ON t.form = f.form AND t.item_id = b.item_id LEFT JOIN pieces p ON p.form = t.form AND p.piece = t.piece GROUP BY ALL),
y AS (SELECT form, count(*) AS cases, {', '.join(f'round_even(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (1, 3, 5, 10))}, round_even(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(chars), 4) AS top3_chars FROM x GROUP BY 1)
SELECT *, round(1 - top3_chars / (SELECT top3_chars FROM y WHERE form = 'whole'), 6) AS compression FROM y"""


@query(FORMS)
def whole_vs_chunk(t):
    """Whole documents against their chunks: recall, context size and compression; chunks are ranked as documents are."""
    cases = t.benchmark.select("item_id", F.col("text").alias("needle"))
    pieces = checkpointed(chunked(t).filter("error IS NULL").select(F.concat_ws(":", "doc_id", "chunk_index").alias("piece"), F.col("content").alias("text")))  # read six times
    whole = t.documents.select(F.col("doc_id").cast("string").alias("piece"), "text")
    out = []
    for name, df in (("whole", whole), ("chunk", pieces)):
        first = F.broadcast(checkpointed(r.ranked(r.bm25(spread(df), t.benchmark, "piece", "item_id", k=10), "item_id", "piece", 10)))  # ten rows an item
        top = checkpointed(df.join(first, "piece").join(cases, "item_id"))
        own = m.ranking_summary(op.first_hit(top, cases, "item_id", F.contains("text", F.col("needle"))), []).withColumn("form", F.lit(name))
        chars = top.filter("rank <= 3").groupBy("item_id").agg(F.sum(F.length("text")).alias("c")).agg(F.round(F.avg("c"), 4).alias("top3_chars"))
        out.append(own.crossJoin(chars))  # one row each
    both = out[0].unionByName(out[1])
    base = both.filter("form = 'whole'").select(F.col("top3_chars").alias("_whole"))
    return both.crossJoin(F.broadcast(base)).withColumn("compression", m.compression(F.col("top3_chars"), F.col("_whole"))).drop("_whole")


@query(f"""WITH {BM25}, hit AS (SELECT b.item_id, min(s.rank) FILTER (d.source = 'src' || b.item_id % 20) AS rank, sum(length(d.text)) FILTER (s.rank <= 10) AS chars FROM benchmark b LEFT JOIN sparse s ON s.item_id = b.item_id AND s.rank <= 10 LEFT JOIN documents d ON d.doc_id = s.doc_id GROUP BY 1)
SELECT count(*) AS cases, round_even(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round_even(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round_even(avg(coalesce(chars, 0)), 4) AS candidate_chars FROM hit""")
def source_recall(t):
    """Recall by source at 1 and 10, and the characters of the ten candidates of a case."""
    cases = t.benchmark.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected"))
    top = sparse(t).filter("rank <= 10").join(t.documents.select("doc_id", "text", "source"), "doc_id")
    chars = op.candidate_chars(top, cases, "item_id", "text")
    own = op.first_hit(top.join(cases, "item_id"), cases, "item_id", F.col("source") == F.col("expected"))
    return m.ranking_summary(own, [], cutoffs=(1, 10)).select("cases", "recall_1", "recall_10").crossJoin(chars)  # one row each


@query(rf"""WITH {BM25.replace("documents", "documents", 1)}, e AS (SELECT b.item_id, b.text AS needle, CASE WHEN b.item_id % 9 = 8 THEN -1 WHEN b.item_id % 2 = 0 THEN s.doc_id ELSE b.item_id END AS doc_id FROM benchmark b LEFT JOIN sparse s ON s.item_id = b.item_id AND s.rank = 1),
c1 AS ({f"WITH {CHUNKS} SELECT doc_id, content FROM c WHERE n <= 200"}),
k AS (SELECT e.item_id, bool_or(contains(content, needle)) AS whole FROM e JOIN c1 ON c1.doc_id = e.doc_id GROUP BY 1)
SELECT item_id, CASE WHEN d.doc_id IS NULL THEN 'source_missing' WHEN NOT contains(d.text, needle) THEN 'text_missing' WHEN NOT coalesce(whole, false) THEN 'split_across_chunks' ELSE 'ok' END AS state FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id LEFT JOIN k USING (item_id)""")
def case_validate(t):
    """Each item names its source: the document that BM25 finds first, one by its number, or one that isn't there."""
    found = sparse(t).filter("rank = 1").select("item_id", F.col("doc_id").alias("_d"))
    source = F.when(F.col("item_id") % 9 == 8, -1).when(F.col("item_id") % 2 == 0, F.col("_d")).otherwise(F.col("item_id"))
    cases = t.benchmark.join(found, "item_id", "left").select("item_id", F.col("text").alias("needle"), source.alias("doc_id"))
    return op.case_problems(cases, t.documents, chunked(t).filter("error IS NULL"), "item_id", "doc_id", "needle").withColumnRenamed("problem", "state")


@query("""SELECT problem, item_id FROM (SELECT item_id, CASE WHEN n IS NULL THEN 'unassigned' WHEN NOT k THEN 'unknown' WHEN s > 1 THEN 'overlap' WHEN n > 1 THEN 'duplicate' END AS problem FROM (SELECT coalesce(a.item_id, b.item_id) AS item_id, b.item_id IS NOT NULL AS k, n, s FROM
(SELECT item_id, count(*) AS n, count(DISTINCT p) AS s FROM (SELECT item_id, 'd' AS p FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 'd' FROM benchmark WHERE item_id % 12 = 0 UNION ALL SELECT item_id, 'h' FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT -5, 'h') GROUP BY 1) a FULL JOIN benchmark b USING (item_id))) WHERE problem IS NOT NULL""")
def split_validate(t):
    ids = t.benchmark.select("item_id")
    dev = ids.filter("item_id % 3 = 0").unionAll(ids.filter("item_id % 12 = 0"))
    return op.split_problems(dev, ids.filter("item_id % 5 = 0").unionAll(t.spark.sql("SELECT CAST(-5 AS BIGINT) AS item_id")), ids, "item_id")


@query("SELECT doc_id, round_even(len(list_filter(['the', 'que', 'und', 'zzz'], lambda f: contains(text, f))) / 4.0 * 100, 6) AS ratio FROM documents")
def fragment_hit_ratio(t):
    return t.documents.select("doc_id", op.fragment_ratio(F.col("text"), F.array(*map(F.lit, ("the", "que", "und", "zzz")))).alias("ratio"))


@query(f"WITH {BM25} SELECT b.item_id, min(x.rank) FILTER (contains(x.text, 'tion the') OR contains(x.text, 'en la')) AS rank FROM benchmark b LEFT JOIN (SELECT s.item_id, s.rank, d.text FROM sparse s JOIN documents d USING (doc_id)) x ON x.item_id = b.item_id GROUP BY 1")
def first_hit_rank(t):
    any_ = F.exists(F.array(F.lit("tion the"), F.lit("en la")), lambda f: F.contains("text", f))
    return op.first_hit(sparse(t).join(t.documents.select("doc_id", "text"), "doc_id"), t.benchmark, "item_id", any_)


@query("""WITH x AS (SELECT quality AS class, quality = CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS hit FROM labels JOIN documents USING (doc_id))
SELECT class, count(*) AS total, count(*) FILTER (hit) AS correct, round_even(avg(hit::INT::DOUBLE), 6) AS accuracy FROM x GROUP BY ROLLUP (class)""")
def accuracy_by_class(t):
    df = t.labels.join(t.documents, "doc_id").withColumn("guess", F.when(F.col("n_chars") > 400, 1).otherwise(0))
    return m.accuracy(df, "quality", "guess")


@query("""WITH x AS (SELECT quality AS class, quality = CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS hit FROM labels JOIN documents USING (doc_id))
SELECT class, round_even(avg(hit::INT::DOUBLE), 6) >= 0.5 AS passed FROM x GROUP BY ROLLUP (class)""")
def accuracy_passed(t):
    df = t.labels.join(t.documents, "doc_id").withColumn("guess", F.when(F.col("n_chars") > 400, 1).otherwise(0))
    return m.accuracy_gate(m.accuracy(df, "quality", "guess"), 0.5).select("class", "passed")


@query(f"{HYBRID} SELECT kind, count(*) AS n, count(*) FILTER (kept) AS kept FROM (SELECT b.item_id, CASE WHEN b.item_id % 4 = 0 THEN 'unknown' ELSE 'known' END AS kind, coalesce(bool_or(dense_score >= 0.66 OR bm25_score >= 8), false) AS kept FROM benchmark b LEFT JOIN fused s ON s.item_id = b.item_id AND s.rank <= 3 GROUP BY 1) GROUP BY 1")
def no_answer_confusion(t):
    """The evidence gate's verdict on the first three candidates of known and unknown cases."""
    cases = t.benchmark.select("item_id", F.when(F.col("item_id") % 4 == 0, "unknown").otherwise("known").alias("kind"))
    none = F.lit(None)
    passed = F.size(r.accepted_by(F.col("dense_score"), F.col("bm25_score"), none.cast("string"), none.cast("double"))) > 0
    own = cases.join(hybrid(t).filter("rank <= 3"), "item_id", "left").groupBy("item_id", "kind").agg(F.coalesce(F.bool_or(F.col("rank").isNotNull() & passed), F.lit(False)).alias("kept"))
    return own.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query("""SELECT expected, count(*) AS n, round_even(avg(CASE WHEN expected = 'success_or_ask' THEN actual IN ('success', 'ask') WHEN expected = 'reject_or_ask' THEN actual IN ('reject', 'ask') ELSE expected = actual END::INT::DOUBLE), 6) AS accuracy FROM
(SELECT ['success_or_ask', 'reject_or_ask', 'success'][event_id % 3 + 1] AS expected, ['success', 'ask', 'reject'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1] AS actual FROM events) GROUP BY 1""")
def elastic_outcomes(t):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % 3 + 1).cast("int"))
    df = t.events.select(pick(("success_or_ask", "reject_or_ask", "success"), F.col("event_id")).alias("expected"), pick(("success", "ask", "reject"), F.get_json_object("props", "$.k").cast("long")).alias("actual"))
    return df.groupBy("expected").agg(F.count("*").alias("n"), F.bround(F.avg(op.outcome_matches(F.col("expected"), F.col("actual")).cast("double")), 6).alias("accuracy"))


@query("""WITH v AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 2 = 0) AS cur, avg(value) FILTER (event_id % 2 = 1) AS base FROM events GROUP BY 1)
SELECT metric, kind, round(cur, 6) AS value, round(base, 6) AS base, coalesce(CASE kind WHEN 'equal' THEN cur = base WHEN 'loss' THEN cur >= base - bound - 1e-9 ELSE cur <= base * bound + 1e-9 END, false) AS passed
FROM v JOIN (VALUES ('view', 'equal', 0.0), ('click', 'loss', 1.0), ('purchase', 'ratio', 1.2), ('error', 'ratio', 0.5)) p(metric, kind, bound) USING (metric)""")
def acceptance_gates(t):
    own = t.events.groupBy(F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("side")).agg(F.avg("value").alias("value"))
    policy = t.spark.createDataFrame([("view", "equal", 0.0), ("click", "loss", 1.0), ("purchase", "ratio", 1.2), ("error", "ratio", 0.5)], "metric string, kind string, bound double")
    out = m.gates(own.filter("side = 0").select("metric", "value"), own.filter("side = 1").select("metric", "value"), policy)
    return out.withColumn("value", F.round("value", 6)).withColumn("base", F.round("base", 6))


@query("""SELECT kind, count(*) AS cases, count(*) FILTER (error) AS infrastructure_errors, round_even(avg(CASE WHEN NOT error THEN least(1.0, value / 100) END), 6) AS mean_score, round_even(avg((NOT error AND value >= 80 AND k >= 9)::INT::DOUBLE), 6) AS pass_rate FROM
(SELECT CASE WHEN event_id % 3 = 0 THEN 'no_answer' ELSE 'answer' END AS kind, event_type = 'error' AS error, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def case_pass(t):
    k, v = F.get_json_object("props", "$.k").cast("long"), F.col("value") / 100
    error = F.when(F.col("event_type") == "error", "retrieval_error")
    df = t.events.select(F.when(F.col("event_id") % 3 == 0, "no_answer").otherwise("answer").alias("kind"), error.alias("error"), m.unit(v).alias("score"), op.case_passed(v, k / 10.0, v, F.lit(1.0), F.lit(False), F.lit(True), error).alias("passed"))
    return df.groupBy("kind").agg(F.count("*").alias("cases"), F.count("error").alias("infrastructure_errors"), F.bround(F.avg(F.when(F.col("error").isNull(), F.col("score"))), 6).alias("mean_score"), F.bround(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


@query("SELECT event_id FROM events WHERE event_type = 'error' OR event_id % 5 = 0")
def resume_pending(t):
    done = t.events.filter("event_id % 5 <> 0").select("event_id", F.when(F.col("event_type") == "error", "infra").alias("error"))
    return op.pending(t.events.select("event_id"), done, "event_id", "error")


@query("SELECT item_id, item_id % 6 = 0 OR item_id % 5 = 1 AS safety FROM benchmark")
def safety_cases(t):
    group = F.when(F.col("item_id") % 6 == 0, "policy_boundary").otherwise("general")
    question = F.when(F.col("item_id") % 5 == 1, F.concat("text", F.lit(" 退款 "))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", op.safety_case(group, question).alias("safety"))


RESULTS = """(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_answer' ELSE 'answer' END AS kind, CASE WHEN event_type = 'error' THEN 'timeout' WHEN k % 13 = 5 THEN 'retrieval_trace_error: refused' END AS err, event_type = 'purchase' AND k % 13 <> 5 AS passed, k % 3 <> 0 AS refused, least(1.0, value / 100) AS score, value AS latency
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


@query(f"""SELECT count(*) AS cases, count(err) AS infrastructure_errors, round_even(avg(score) FILTER (err IS NULL AND kind = 'answer'), 6) AS correctness, round_even(avg(passed::INT::DOUBLE), 6) AS case_pass_rate, round_even(avg(refused::INT::DOUBLE) FILTER (err IS NULL AND kind = 'no_answer'), 6) AS no_answer_accuracy,
round_even(avg(latency), 6) AS latency_mean, round_even(list_sort(list(latency))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1], 6) AS latency_p95 FROM {RESULTS}""")
def end_to_end_summary(t):
    k = F.get_json_object("props", "$.k").cast("long")
    results = t.events.select(
        F.when(F.col("event_id") % 4 == 0, "no_answer").otherwise("answer").alias("kind"), F.when(F.col("event_type") == "error", "timeout").alias("infrastructure_error"), F.when(k % 13 == 5, "refused").alias("trace_error"),
        (F.col("event_type") == "purchase").alias("passed"), (k % 3 != 0).alias("refusal_correct"), m.unit(F.col("value") / 100).alias("correctness"), F.col("value").alias("latency"),
    )
    own = op.end_to_end(op.normalized_errors(results), ["correctness"])
    speed = m.distribution(results.withColumn("all", F.lit(1)), ["all"], "latency").select(F.col("mean").alias("latency_mean"), F.col("p95").alias("latency_p95"))
    return own.crossJoin(speed)  # one row each


@query("""WITH c AS (SELECT item_id, 'answer' AS kind, item_id % 3 AS grp FROM benchmark UNION ALL SELECT -1 - item_id, 'no_answer', 0 FROM benchmark WHERE item_id % 4 = 1), a AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split, kind, grp, count(*) AS n FROM c GROUP BY ALL)
SELECT split, kind, grp, n AS actual, n + 1 AS expected FROM a WHERE split = 'dev' AND grp = 1 UNION ALL SELECT 'holdout', 'answer', 9, 0, 4""")
def split_count_check(t):
    """The counts of each split by kind and group; two expectations are off."""
    ids = t.benchmark.select("item_id")
    catalog = op.case_catalog(ids.withColumn("grp", F.col("item_id") % 3), ids.filter("item_id % 4 = 1").select((-1 - F.col("item_id")).alias("item_id"), F.lit(0).cast("long").alias("grp")))
    assigned = catalog.select(F.when(F.col("item_id") % 2 == 0, "dev").otherwise("holdout").alias("split"), "item_id")
    actual = op.split_counts(assigned, catalog, "item_id", "grp")
    off = F.when((F.col("split") == "dev") & (F.col("grp") == 1), F.col("n") + 1).otherwise(F.col("n"))
    more = t.spark.sql("SELECT 'holdout' AS split, 'answer' AS kind, CAST(9 AS BIGINT) AS grp, CAST(4 AS BIGINT) AS n")
    return op.count_mismatches(actual, actual.withColumn("n", off).unionByName(more), "grp").select("split", "kind", "grp", "actual", "expected")


@query("""WITH b AS (SELECT event_type AS metric, avg(value) AS base, avg(value) FILTER (event_id % 3 <> 0) AS cur FROM events GROUP BY 1), q AS (SELECT avg(cur) >= avg(base) - 0.01 - 1e-9 AS ok FROM b WHERE metric IN ('view', 'click'))
SELECT metric, 'loss' AS kind, cur >= base - 0.03 - 1e-9 AS passed FROM b WHERE metric IN ('view', 'click') UNION ALL SELECT 'quality_composite', 'loss', ok FROM q UNION ALL SELECT 'cost_per_case', 'ratio', cur <= base * 1.15 + 1e-9 FROM b WHERE metric = 'purchase'""")
def acceptance_composite(t):
    """Single metrics, their mean, and a cost that must be there."""
    own = lambda df: df.groupBy(F.when(F.col("event_type") == "purchase", "cost_per_case").otherwise(F.col("event_type")).alias("metric")).agg(F.avg("value").alias("value"))
    policy = t.spark.createDataFrame([("view", "loss", 0.03), ("click", "loss", 0.03), ("cost_per_case", "ratio", 1.15)], "metric string, kind string, bound double")
    return m.acceptance(own(t.events.filter("event_id % 3 <> 0")), own(t.events), policy, ["view", "click"])


#: The tables that the BM25 SQL reads, as texts of one template and questions for a number.
CONFUSABLE = """documents AS (SELECT s_suppkey AS doc_id, 'staff member number ' || s_suppkey || ' knows shoulder, back and foot massage and is well liked' AS text FROM supplier),
benchmark AS (SELECT s_suppkey AS item_id, 'is number ' || s_suppkey || ' in today' AS text FROM supplier)"""
CONFUSED = """pv AS (SELECT i.item_id, d.vec_id AS doc_id, list_inner_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id + CASE WHEN i.item_id % 3 = 0 THEN 1 ELSE 0 END JOIN embeddings d ON d.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pv) WHERE rank <= 10),
sp AS (SELECT item_id, doc_id, rank FROM sparse WHERE rank <= 10),
hy AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, min(rank) FILTER (k = 1) NULLS LAST, min(rank) FILTER (k = 2) NULLS LAST, doc_id) AS rank FROM (SELECT 1 AS k, item_id, doc_id, rank FROM dense UNION ALL SELECT 2, item_id, doc_id, rank FROM sp) GROUP BY 1, 2),
every AS (SELECT 'dense' AS strategy, item_id, doc_id, rank FROM dense UNION ALL SELECT 'sparse', item_id, doc_id, rank FROM sp UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM hy),
hit AS (SELECT s.strategy, b.item_id, min(rank) FILTER (e.doc_id = b.item_id AND rank <= 3) AS rank FROM benchmark b CROSS JOIN (SELECT unnest(['dense', 'sparse', 'hybrid']) AS strategy) s LEFT JOIN every e ON e.item_id = b.item_id AND e.strategy = s.strategy GROUP BY 1, 2)"""


@query(f"WITH {CONFUSABLE}, {BM25}, {CONFUSED} SELECT strategy, count(*) AS cases, round_even(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round_even(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM hit GROUP BY 1")
def confusable_recall(t):
    """Texts of one template that differ in a number, each asked for by its number, by each channel and both; a third of
    the questions have a neighbour's vector."""
    docs = op.confusable_corpus(t.supplier.select(F.col("s_suppkey").alias("doc_id")))
    asked = docs.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("is number "), F.col("doc_id").cast("string"), F.lit(" in today")).alias("text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    meant = asked.select("item_id", (F.col("item_id") + (F.col("item_id") % 3 == 0).cast("int")).alias("vec_id"))
    near = checkpointed(r.dense(vectors, t.embeddings.join(meant, "vec_id").select("item_id", "embedding"), "doc_id", "item_id", 10))
    words = checkpointed(r.sparse_ranking(r.bm25(spread(docs), asked, "doc_id", "item_id", k=10), "item_id", "doc_id", 10))
    found = None
    for name, ranking in (("dense", near), ("sparse", words), ("hybrid", r.reciprocal_rank_fusion(near, words, "item_id", "doc_id"))):
        own = op.first_hit(ranking.filter("rank <= 3"), asked, "item_id", F.col("doc_id") == F.col("item_id")).withColumn("strategy", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return m.ranking_summary(found, ["strategy"], cutoffs=(3,))
