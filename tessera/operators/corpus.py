"""Corpus preparation: normalize, hash, front matter, sections, chunks, dedup, version sync, manifests.

The chunker follows the text position by position, so it is Arrow-batched Python over one document each;
everything else is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.session import checkpointed
from tessera.sources.commits import Table

SIZE, OVERLAP, MOST = 500, 100, 200
#: Fixed order of cut points, the strongest first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ".", "!", "?")
KEYS = {"source_id": 64, "title": 255, "category": 100, "version": 64}
_BLANKS = re.compile(r"\s*")


def normalized(text: Column) -> Column:
    """No byte-order mark, LF line ends, no trailing blanks, at most one empty line in a row."""
    t = F.regexp_replace(text, "^﻿+", "")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def file_hash(text: Column) -> Column:
    """Independent of line ends."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def question_and_answer(question: Column, answer: Column) -> Column:
    """The content of an entry that is a question and its answer; blank parts are left out."""
    return F.array_join(F.filter(F.array(F.trim(question), F.trim(answer)), lambda x: x.isNotNull() & (x != "")), "\n")


def source_id(explicit: Column, front: Column, name: Column, text: Column) -> Column:
    return F.coalesce(explicit, front, F.sha2(F.concat(F.lower(F.upper(name)), F.lit("\0"), text), 256))


def category(requested: Column, front: Column) -> Column:
    return F.coalesce(F.when(requested != "general", requested), front, F.lit("general"))


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


# Front matter as rules over the lines between two fences; a rule gives the error of a line, or null.
_ITEM = r'(?:"(?:[^"]|"")*"|[^",][^,]*|)'
_LIST = rf"\A\[\s*{_ITEM}(?:,\s*{_ITEM})*\s*\]\z"
LONGEST_KEYWORD = 100


def _unquoted(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"""(?s)\A(['"])(.*)\1\z""", "$2"))


def _keywords(value: Column) -> Column:
    """The items of a bracketed list; those in double quotes may hold commas."""
    inside = F.trim(F.substring(value, F.lit(2), F.length(value) - 2))
    items = F.transform(F.regexp_extract_all(F.concat(F.lit(","), inside), F.lit(rf"(?:,\s*)({_ITEM})(?=,|\z)"), F.lit(1)), lambda x: F.trim(x))
    whole = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(_unquoted(x))
    return F.filter(F.transform(items, lambda x: _unquoted(whole(x))), lambda x: x != "")


def front_matter(text: Column) -> Column:
    """Struct (source_id, title, category, keywords, version, body, error) of a document's text."""
    plain = F.replace(F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff+", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return _once(plain, lambda whole: _once(_fenced(whole), lambda parts: _fields(whole, parts)))


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fenced(plain: Column) -> Column:
    """Whether a fence opens the text, and what is before and after the next one; only the first line and these are cut."""
    lines = F.split(plain, "\n", 2)
    return F.struct((F.trim(F.get(lines, F.lit(0))) == "---").alias("opened"), F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"(?:\A|\n) *--- *(?:\n|\z)", 2).alias("parts"))


def _fields(plain: Column, cut: Column) -> Column:
    fenced, parts = cut["opened"], cut["parts"]
    given = F.filter(F.transform(F.split(F.get(parts, F.lit(0)), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    pairs = F.transform(given, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"), F.contains(x, F.lit(":")).alias("colon")))
    last = lambda key: F.get(F.filter(pairs, lambda p: p["key"] == key), F.size(F.filter(pairs, lambda p: p["key"] == key)) - 1)["value"]
    rule = lambda p: F.when(~p["colon"], "missing_colon").when((p["key"] == "keywords") & ~p["value"].rlike(_LIST), "bad_keywords").when((p["key"] == "keywords") & F.exists(_keywords(p["value"]), lambda k: F.length(k) > LONGEST_KEYWORD), "keyword_too_long")
    values = {key: F.nullif(_unquoted(last(key)), F.lit("")) for key in KEYS}
    lengths = [F.when(F.length(values[key]) > most, f"{key}_too_long") for key, most in KEYS.items()]
    error = F.when(F.size(parts) < 2, "missing_close").otherwise(F.coalesce(F.get(F.filter(F.transform(pairs, rule), lambda e: e.isNotNull()), 0), *lengths))
    body = F.regexp_replace(F.get(parts, F.lit(1)), "^\n+", "")
    known = fenced & error.isNull()
    none = F.array().cast("array<string>")
    return F.struct(
        *(F.when(known, values[key]).alias(key) for key in ("source_id", "title", "category")),
        F.when(known, F.coalesce(_keywords(last("keywords")), none)).otherwise(none).alias("keywords"),
        F.when(known, values["version"]).alias("version"),
        F.when(~fenced, plain).when(known, body).alias("body"),
        F.when(fenced, error).alias("error"),
    )


def with_front_matter(df: DataFrame, text: str) -> DataFrame:
    """Adds the struct `front`."""
    return df.withColumn("front", front_matter(F.col(text)))


_HEADING = r"[^\S\n]{0,3}#{1,6}[^\S\n]+[^\n]+"


def sections(text: Column, title: Column) -> Column:
    """Array of (title, body) by Markdown headings; parts without a body are left out, but a text of headings alone
    gives its last title."""
    pieces = F.split(text, rf"(?mU)(?=^{_HEADING}$)")
    named = F.transform(pieces, lambda x: F.struct(
        F.nullif(F.substring(F.regexp_extract(x, r"(?U)\A\s{0,3}#{1,6}\s+([^\n]*?)\s*#*[^\S\n]*(?:\n|\z)", 1), 1, 255), F.lit("")).alias("head"),
        F.regexp_replace(F.when(x.rlike(rf"(?U)\A{_HEADING}"), F.regexp_replace(x, r"\A[^\n]*", "")).otherwise(x), r"(?U)\A\s+|\s+\z", "").alias("body"),
    ))
    heads = lambda i: F.filter(F.slice(named, F.lit(1), i + 1), lambda s: s["head"].isNotNull())
    titled = F.transform(named, lambda s, i: F.struct(F.coalesce(F.get(heads(i), F.size(heads(i)) - 1)["head"], title).alias("title"), s["body"].alias("body")))
    full = F.filter(titled, lambda s: s["body"] != "")
    only = F.filter(F.slice(F.transform(titled, lambda s: F.struct(s["title"].alias("title"), s["title"].alias("body"))), -1, 1), lambda s: s["title"] != "")
    return F.when(F.size(full) > 0, full).otherwise(only)


def cut_places(text: str) -> list[tuple[int, np.ndarray]]:
    """For each separator its length and, in ascending order, the places right after it."""
    return [(len(s), np.array([m.start() + len(s) for m in re.finditer(f"(?={re.escape(s)})", text)], "i8")) for s in SEPARATORS]


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of at most `size` characters. Each ends at the last place of the strongest separator
    that its later part has, looked up in the sorted places; the next one starts `overlap` characters before."""
    places, begin, n = cut_places(text), 0, len(text)
    while n - begin > size:
        last, least = begin + size, begin + max(size // 2, overlap + 1)
        ends = ((width, at[k]) for width, at in places if (k := int(np.searchsorted(at, last, "right")) - 1) >= 0)
        end = int(next((e for width, e in ends if e - width >= least), last))
        yield begin, end
        begin = min(end, _BLANKS.match(text, max(begin + 1, end - overlap)).end())
    yield begin, n


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text, without white space around them; blank ones are left out."""
    return [piece for a, b in spans(text, size, overlap) if (piece := text[a:b].strip())]


def checked(size: int, overlap: int) -> None:
    if not 100 <= size <= 4000 or not 0 <= overlap <= size / 2:
        raise ValueError("size must lie in [100, 4000] and overlap in [0, size / 2]")


def chunk_documents(df: DataFrame, key: str, text: str, title: str | None = None, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """(key, title, chunk_index, content, error); a document over `most` chunks is one error row."""
    checked(size, overlap)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, parts in zip(pdf["k"], pdf["parts"]):
                own = [(k, part["title"], c) for part in parts for c in chunks(part["body"], size, overlap)]
                rows += [(k, None, None, None, "too_many_chunks")] if len(own) > most else [(k, h, i, c, None) for i, (_, h, c) in enumerate(own)]
            yield pd.DataFrame(rows, columns=[key, "title", "chunk_index", "content", "error"]).astype({"chunk_index": "Int64"})

    head = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    source = df.select(F.col(key).alias("k"), sections(F.coalesce(normalized(F.col(text)), F.lit("")), head).alias("parts"))
    return source.mapInPandas(run, f"`{key}` {kind}, title string, chunk_index long, content string, error string")


class ChunkTable:
    """chunk_table(parts, size, overlap, most) for LATERAL: (title, chunk_index, content, error) of one document's sections,
    an array of structs of title and body as sections() makes it. The numbers are constants, checked when a query is
    analysed."""

    @staticmethod
    def analyze(parts: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(parts.dataType, T.ArrayType) or [f.name for f in getattr(parts.dataType.elementType, "fields", [])] != ["title", "body"]:
            raise ValueError("parts must be an array of structs of title and body")
        for argument in (size, overlap, most):
            if argument is not None and not argument.isConstantExpression:
                raise ValueError("size, overlap and most must be constants")
        value = lambda argument, default: default if argument is None or argument.value is None else int(argument.value)
        checked(value(size, SIZE), value(overlap, OVERLAP))
        return AnalyzeResult(T.StructType().add("title", "string").add("chunk_index", "long").add("content", "string").add("error", "string"))

    def eval(self, parts, size=SIZE, overlap=OVERLAP, most=MOST):
        size, overlap, most = (d if v is None else int(v) for v, d in ((size, SIZE), (overlap, OVERLAP), (most, MOST)))
        own = [(p["title"], c) for p in parts or [] for c in chunks(p["body"], size, overlap)]
        if len(own) > most:
            yield None, None, None, "too_many_chunks"
        else:
            for i, (title, content) in enumerate(own):
                yield title, i, content, None


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, F.udtf(ChunkTable))


def deduplicated(df: DataFrame, source: str, hash_: str, order: str) -> DataFrame:
    """The first of each source's equal hashes, with the count of its copies."""
    own = Window.partitionBy(source, hash_)
    out = df.withColumn("copies", F.count("*").over(own)).withColumn("_r", F.row_number().over(own.orderBy(order)))
    return out.filter("_r = 1").drop("_r")


#: What a sync refreshes in a chunk that is there already.
SYNC_FIELDS = ["content", "category", "keywords", "source_name", "title", "chunk_index", "chunk_count", "version"]


def sync_plan(old: DataFrame, new: DataFrame, fields: list[str], optional: list[str] | None = None) -> DataFrame:
    """One action for each row of a full outer merge of versions, by (source_id, hash).

    old: id, source_id, hash, is_active and fields; new: source_id, hash and fields, each pair once. insert,
    noop, update, reactivate, deactivate; surplus copies of a hash are deactivated; the active, then the
    smallest id, is the one that stays. Inactive rows without a match stay as they are (no row). `optional` fields
    differ only where they are supplied."""
    optional = optional or []
    best = F.row_number().over(Window.partitionBy("source_id", "hash").orderBy(F.desc("is_active"), F.asc("id")))
    left = old.withColumn("_n", best).select("source_id", "hash", "id", "is_active", "_n", *(F.col(f).alias(f"_old_{f}") for f in [*fields, *optional]))
    both = left.join(new.withColumn("_new", F.lit(True)), ["source_id", "hash"], "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"_old_{f}").eqNullSafe(F.col(f))
    for f in optional:
        differs = differs | (F.col(f).isNotNull() & ~F.col(f"_old_{f}").eqNullSafe(F.col(f)))
    action = (
        F.when(F.col("id").isNull(), "insert")
        .when(F.col("_new").isNull() | (F.col("_n") > 1), F.when(F.col("is_active"), "deactivate"))
        .when(~F.col("is_active"), "reactivate")
        .when(differs, "update")
        .otherwise("noop")
    )
    return both.withColumn("action", action).filter("action IS NOT NULL").select("source_id", "hash", "id", "action")


def applied_sync(table: Table, new: DataFrame, now: Column, fields: list[str] = SYNC_FIELDS, embedding: str = "embedding", stored: bool = False) -> tuple[int | None, dict[str, int]]:
    """Make a stored table's sources what `new` says they are: (version, counts of imported, skipped, deactivated, changed).

    The table has id (a string), source_id, hash, is_active, updated_at, the fields and an embedding, keyed by id in buckets
    by source; new has source_id, hash, the fields and an embedding, each (source, hash) once. Sources that new doesn't
    name stay as they are, and only the buckets of named ones are read or written. A chunk that is there keeps its id,
    and its embedding where none is supplied. A sync that changes nothing makes no version. `new` is read several times, and
    kept in the shared folder for that unless it is stored already. Contents are compared by their SHA-256; only those that
    aren't there yet are moved."""
    new = new if stored else checkpointed(new)
    short = lambda df, *more: df.select(*more, "source_id", "hash", *(F.sha2("content", 256).alias(f) if f == "content" else F.col(f) for f in [*fields, embedding]))
    given = checkpointed(short(new))
    sources = given.select("source_id").distinct()
    old = short(table.read(only=table.buckets_of(sources)), "id", "is_active").join(sources, "source_id", "left_semi")
    plan = checkpointed(sync_plan(old, given, fields, [embedding]))
    counts = sync_counts(plan, totals=True).first()
    todo = plan.filter("action <> 'noop'").select(F.col("source_id").alias("_s"), F.col("hash").alias("_h"), F.col("id").alias("_id"), "action")
    rows = todo.join(old.select("id", F.struct(*fields, embedding).alias("_old")), F.col("_id") == F.col("id"), "left").drop("id")
    rows = rows.join(given.select("source_id", "hash", F.struct(*fields, embedding).alias("_new")), (F.col("_s") == F.col("source_id")) & (F.col("_h") == F.col("hash")), "left")
    off = F.col("action") == "deactivate"
    pick = lambda f: F.when(off, F.col(f"_old.{f}")).otherwise(F.col(f"_new.{f}")).alias(f)
    id_ = F.coalesce("_id", F.sha2(F.concat("_s", F.lit("\0"), "_h"), 256)).alias("id")
    kept = F.when(off, F.col(f"_old.{embedding}")).otherwise(F.coalesce(f"_new.{embedding}", f"_old.{embedding}")).alias(embedding)
    same = F.col("_id").isNotNull() & (off | F.col("_old.content").eqNullSafe(F.col("_new.content"))) if "content" in fields else F.lit(False)
    changes = checkpointed(rows.select(id_, F.col("_s").alias("source_id"), F.col("_h").alias("hash"), (~off).alias("is_active"), now.alias("updated_at"), *(pick(f) for f in fields if f != "content"), kept, same.alias("_same")))
    if "content" in fields:
        texts = new.select(F.col("source_id").alias("_s"), F.col("hash").alias("_h"), "content")
        fresh = changes.filter("NOT _same").join(texts, (F.col("source_id") == F.col("_s")) & (F.col("hash") == F.col("_h")), "left").drop("_s", "_h")
        changes = checkpointed(changes.filter("_same").withColumn("content", F.lit(None).cast("string")).unionByName(fresh))
    version, _ = table.merge(changes, same={"content": "_same"} if "content" in fields else None)
    return version, {k: counts[k] for k in ("imported", "skipped", "deactivated", "changed")}


def sync_counts(plan: DataFrame, totals: bool = False) -> DataFrame:
    """Counts of a sync by source, or with totals, of the whole batch."""
    n = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return plan.groupBy(*([] if totals else ["source_id"])).agg(*([F.countDistinct("source_id").alias("sources"), F.count("*").alias("rows")] if totals else []), n("insert", "reactivate").alias("imported"), n("update", "noop").alias("skipped"), n("deactivate").alias("deactivated"), n("insert", "reactivate", "update", "deactivate").alias("changed"))


def manifest(chunks_: DataFrame, source: str, index: str, content: str) -> DataFrame:
    """(source, chunk_count, chunk_sha256 in order of the chunks)."""
    pair = F.struct(F.col(index).alias("i"), content_hash(F.col(content)).alias("h"))
    return chunks_.groupBy(source).agg(F.count("*").alias("chunk_count"), F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["h"]).alias("chunk_sha256"))


def manifest_totals(manifest_: DataFrame) -> DataFrame:
    return manifest_.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"))


def verified(manifest_: DataFrame, chunks_: DataFrame, source: str, index: str, content: str) -> DataFrame:
    """(source, index, problem) of chunks that differ from a manifest's hash, are missing or are extra."""
    want = manifest_.select(source, F.posexplode("chunk_sha256").alias("_at", "_want"))
    have = chunks_.select(F.col(source).alias("_s"), F.col(index).cast("int").alias("_i"), content_hash(F.col(content)).alias("_have"))
    both = want.join(have, (F.col(source) == F.col("_s")) & (F.col("_at") == F.col("_i")), "full")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") != F.col("_have"), "changed")
    return both.select(F.coalesce(source, "_s").alias(source), F.coalesce("_at", "_i").alias(index), problem.alias("problem")).filter("problem IS NOT NULL")
