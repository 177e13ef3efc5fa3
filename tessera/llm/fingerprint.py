r"""Merkle-tree fingerprints of documents, by built-in functions only.

A text is split into sections (at "\n\n"), a section into paragraphs (at "\n"), a paragraph into leaves:
sentences, the longest cut every 160 code points. A leaf's digest is the MD5 of its text, a paragraph's
that of its leaves' digests, a section's that of its paragraphs', and the root is the SHA-256 of the
sections'. Splitting loses nothing, so equal roots mean equal texts. The fingerprint is the root, the
sections' digests and the leaves' digests (SHORT hexadecimal digits each), in three fields.

The likeness of two fingerprints is 1 where they are equal, else the Jaccard index of the sets of leaf digests
that they hold; comparing the trees from the root down locates edits (changed_sections).

Cases: a null text counts as empty; empty texts are equal to each other; documents with the same id are
taken in order of their texts; a null id comes before all others, as a document's predecessor and as the last one's
successor; one document is its own successor; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, text_bytes

SHORT = 8
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Successors are found in ranges of about so many bytes of text, in so many ranges at most.
RANGE, RANGES = 128 << 20, 20_000
LEAVES = r"[^.!?]{1,160}[.!?]*|[.!?]+"


def tree(text: Column) -> Column:
    """Array of sections, each an array of paragraphs, each an array of leaf digests."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), lambda leaf: F.substring(F.md5(leaf), 1, 16))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def with_fingerprint(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add <prefix>sections and <prefix>fingerprint."""
    nodes, sections = f"_{prefix}tree", f"{prefix}sections"
    df = df.withColumn(nodes, tree(F.col(text)))
    df = df.withColumn(sections, F.transform(nodes, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.md5(F.array_join(p, ""))), ""))))
    short = lambda a: F.array_join(F.transform(a, lambda d: F.substring(d, 1, SHORT)), "")
    return df.withColumn(f"{prefix}fingerprint", F.concat_ws(":", F.sha2(F.array_join(sections, ""), 256), short(F.col(sections)), short(F.flatten(F.flatten(nodes))))).drop(nodes)


def leaves_of(fingerprint: Column) -> Column:
    """The leaf digests that a fingerprint holds."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def likeness(fingerprint: Column, other: Column) -> Column:
    """0 to 1: the share of leaves that two fingerprints have in common, 1 for equal ones."""
    a, b = leaves_of(fingerprint), leaves_of(other)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(fingerprint == other, F.lit(1.0)).otherwise(F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0.0)), F.lit(0.0)))


def changed_sections(sections: Column, other: Column) -> Column:
    """Numbers (from 0) of the sections whose branches differ; past the shorter text's end all do."""
    places = F.sequence(F.lit(0), F.greatest(F.size(sections), F.size(other)) - 1)
    return F.filter(places, lambda i: ~F.get(sections, i).eqNullSafe(F.get(other, i)))


def bounds_below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are smaller than a value: blocks of them are looked through first, then one block."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    numbers = lambda own: F.array(*(F.lit(b).cast("long") for b in own))
    count = lambda own: F.size(F.filter(own, lambda b: b < value))
    whole = count(numbers([b[-1] for b in blocks]))
    return whole * step + F.when(whole < len(blocks), count(F.get(F.array(*map(numbers, blocks)), whole))).otherwise(len(bounds) - step * len(blocks))


def with_next(docs: DataFrame, columns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Add next_<column>: those of the next document by ascending doc_id, null first (after the last: the first).

    Documents are dealt to ranges of ids, and a copy of each range's first document goes to the range
    before it, so a range finds all successors by itself: one shuffle of the texts.
    """
    n = min(RANGES, max(2, shuffle_partitions(docs.sparkSession), -(-text_bytes(docs, columns[0]) // RANGE)))
    # Bounds: RANGES numbers at most; beyond, a range's rows spill.
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    placed = docs.withColumn("_order", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_part", bounds_below(sorted(set(bounds)), F.col("_order")))
    firsts = placed.groupBy("_part").agg(F.min("_order").alias("_first"))
    before = F.lag("_part").over(Window.orderBy("_part"))
    last = F.max("_part").over(Window.partitionBy())
    ghosts = firsts.select(F.col("_first").alias("_order"), F.coalesce(before, last).alias("_to"))
    # One row for each partition: a size bounded by the number of partitions.
    marked = placed.join(F.broadcast(ghosts), "_order", "left")
    twice = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("ghost")), F.struct(F.col("_to").alias("p"), F.lit(1).alias("ghost")))
    )
    dealt = marked.withColumn("_at", F.explode(twice)).select("doc_id", *columns, *carried, "_at.*")
    own = Window.partitionBy("p").orderBy("ghost", F.asc_nulls_first("doc_id"), columns[0])
    found = dealt.select("*", *(F.lead(c).over(own).alias(f"next_{c}") for c in columns))
    return found.filter("ghost = 0").drop("p", "ghost")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half is replaced by the next document's head."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A text's tree is made once, and its fingerprint goes with it to the document before.
    df = with_next(with_fingerprint(base, "text"), ["text", "fingerprint"], ("sections",))
    n = F.length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int"))))
    df = with_fingerprint(df, "edited", "edited_")
    near = lambda p: likeness(F.col("fingerprint"), F.col(f"{p}fingerprint"))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_").alias("near_edited"), near("next_").alias("near_next"),
        F.size("sections").cast("long").alias("n_sections"), F.size(changed_sections(F.col("sections"), F.col("edited_sections"))).cast("long").alias("n_changed_sections"),
    )


SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d
), e AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM n
), u AS (
  SELECT doc_id, n, text, edited, nxt, unnest([text, edited, nxt]) AS t, unnest([1, 2, 3]) AS k FROM e
), x AS (
  SELECT doc_id, n, text, edited, k, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,160}[.!?]*|[.!?]+'), lambda v: md5(v)[1:16]))) AS tree FROM u
), y AS (
  SELECT doc_id, n, text, edited, k, list_transform(tree, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))) AS sections,
    flatten(flatten(tree)) AS leaves FROM x
), z AS (
  SELECT doc_id, n, text, edited, k, sections, list_distinct(list_transform(leaves, lambda v: v[1:8])) AS leaves,
    sha256(array_to_string(sections, '')) || ':' || array_to_string(list_transform(sections, lambda v: v[1:8]), '') || ':' || array_to_string(list_transform(leaves, lambda v: v[1:8]), '') AS f FROM y
), w AS (
  SELECT a.doc_id, a.n, a.edited, a.f AS f1, b.f AS f2, c.f AS f3, a.leaves AS l1, b.leaves AS l2, c.leaves AS l3, a.sections AS s1, b.sections AS s2,
    len(list_intersect(a.leaves, b.leaves)) AS i2, len(list_intersect(a.leaves, c.leaves)) AS i3
  FROM z a JOIN z b ON b.doc_id = a.doc_id AND b.k = 2 JOIN z c ON c.doc_id = a.doc_id AND c.k = 3 WHERE a.k = 1
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f1 AS fingerprint, f2 AS edited_fingerprint,
  CASE WHEN f1 = f2 THEN 1.0::DOUBLE ELSE coalesce(i2::DOUBLE / nullif(len(l1) + len(l2) - i2, 0), 0.0::DOUBLE) END AS near_edited,
  CASE WHEN f1 = f3 THEN 1.0::DOUBLE ELSE coalesce(i3::DOUBLE / nullif(len(l1) + len(l3) - i3, 0), 0.0::DOUBLE) END AS near_next,
  len(s1) AS n_sections,
  len(list_filter(range(greatest(len(s1), len(s2))), lambda j: s1[j + 1] IS DISTINCT FROM s2[j + 1])) AS n_changed_sections
FROM w
"""
