"""Phrase collocations by merged count-min sketches and an exact second pass.

(1) Each block of documents (ngrams.py) makes a count-min sketch of its n-grams of 1 to max_words words: two
rows of cells, each n-gram in one cell of each row. The sketch grows with the text and is kept in pages, so
a page's load is alike at every size; blocks send the cells that they touch. (2) Pages add up the blocks' cells.
As cells only overestimate, an n-gram that occurs min_count times has both of its cells at min_count or more;
pages answer each block with one bit for each of its cells. (3) Blocks read their words again and send on only
n-grams whose two cells are both full: their counts are summed exactly, and what falls short of min_count after
all goes. So nothing frequent is lost, whatever the sketch's collisions. (4) Candidates are scored with exact
decimals, and those that a longer candidate explains go.

The first parts and rests of a candidate occur at least as often as itself, so their counts are there too.
Counts of up to 10^15 are exact throughout. Words lie between single spaces in a phrase. N-grams share a
cell only in the sketch; exact counts are summed by language and the phrase itself.

Cases: null texts are empty and have no words; a null language is `und` (together with a literal one); without a
lang column all are `und`; repeated rows count each; ids play no part, null or not; very long texts are one
block; ties in the ranking go by phrase in UTF-8 byte order; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cleared, release, spread, stored, text_bytes
from tessera.llm.ngrams import PAGE, Block, Level, blocks_of, hashes_of, levels_of, opened, page_of, replies_of, sending, word_hashes
from tessera.llm.shingles import mix

MAX_WORDS, MIN_COUNT, TOP, COVERED_PERCENT = 3, 10, 2000, 50
SPACE, CUT = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Rows of the sketch; cells of a page as a power of two.
ROWS, CELLS = 2, 22
#: Bytes of text of a block: with all of its n-grams it has to fit a task beside others.
BLOCK = 5 << 20


def _levels(block: Block, max_words: int) -> tuple[list[str], list[Level], np.ndarray]:
    """(languages, n-grams by length, hashes of all of them in turn)."""
    langs = sorted({a[0] for a in block.about})
    number = {lang: k for k, lang in enumerate(langs)}
    first = np.repeat(np.array([number[a[0]] for a in block.about], "i8"), block.counts)
    levels = levels_of(first, block.ids, block.joined, max(1, len(block.words)), max_words)
    hashes = hashes_of(levels, word_hashes([lang.encode() for lang in langs]), word_hashes(block.words))
    return langs, levels, np.concatenate(hashes)


def cells_of(hashes: np.ndarray, row: int, pages: int, bits: int = CELLS) -> np.ndarray:
    """The cell of each n-gram in a row of the sketch: its page's number, then a place in the page."""
    own = mix(hashes + np.uint64((row + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    return (page_of(own, pages) << bits) | (own & np.uint64((1 << bits) - 1)).astype("i8")


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct cells, their counts)."""
    order = np.argsort(cells)
    cells = cells[order]
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else order
    return cells[starts], np.add.reduceat(counts[order], starts) if len(cells) else counts


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, page_bytes: int = PAGE, bits: int = CELLS) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of 1 to max_words words that occur min_count times or more; words = 0
    has all word occurrences of a language."""
    pages = max(1, math.ceil(text_bytes(docs) / page_bytes))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    blocks = stored(blocks_of(docs, [lang], F.col("text"), SPACE, CUT, BLOCK), "phrase-blocks")

    def sketch(block: Block) -> Iterator[tuple]:
        _, levels, hashes = _levels(block, max_words)
        counts = np.concatenate([x.counts() for x in levels])
        del levels, block
        for row in range(ROWS):
            cells, n = _summed(cells_of(hashes, row, pages, bits), counts)
            yield row * pages, cells >> bits, cells.astype("u8"), np.minimum(n, min_count), lambda k: k << bits

    def merge(table: pa.Table) -> pa.Table:
        page = table.column("page")[0].as_py() % pages
        full, lists = np.zeros(1 << bits, "u4"), []
        for packed in table.column("packed").to_pylist():
            cells, n = opened(packed, page << bits)
            lists.append((cells & np.uint64((1 << bits) - 1)).astype("u4"))
            full[lists[-1]] += n.astype("u4")  # each at most min_count
        enough = full >= min_count
        answers = [np.packbits(enough[c]).tobytes() for c in lists]
        out = pa.table({"block": table.column("block"), "page": table.column("page"), "packed": pa.array(answers, pa.binary())})
        release()
        return out

    sent = blocks.mapInArrow(sending(sketch), "page long, block long, packed binary")
    bits_back = stored(spread(sent, "page").groupBy("page").applyInArrow(merge, "block long, page long, packed binary"), "phrase-bits")

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = replies_of(right)
        for packed in left.column("packed").to_pylist():
            block = Block.unpacked(packed)
            langs, levels, hashes = _levels(block, max_words)
            frequent = np.ones(len(hashes), bool)
            for row in range(ROWS):
                cells, of = np.unique(cells_of(hashes, row, pages, bits), return_inverse=True)
                used, sizes = np.unique(cells >> bits, return_counts=True)
                bits_of = {page - row * pages: data for page, data in answers if row * pages <= page < (row + 1) * pages}
                full = [np.unpackbits(np.frombuffer(bits_of[k], "u1"), count=n) for k, n in zip(used.tolist(), sizes.tolist())]
                frequent &= np.concatenate([*full, np.zeros(0, "u1")]).astype(bool)[of]
                del cells, of, full
            del hashes
            out += _found(block, langs, levels, frequent)
            del block, levels
        release()
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    found = spread(blocks, "block").groupBy("block").cogroup(spread(bits_back, "block").groupBy("block")).applyInArrow(count, "lang string, words int, phrase string, n long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | (F.col("words") == 0))


_FOUND = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _found(block: Block, langs: list[str], levels: list[Level], frequent: np.ndarray) -> list[pa.Table]:
    """A block's surviving phrases with their counts, and its words by language."""
    names, words = pa.array(langs, pa.string()), pa.array(block.words, pa.binary())
    totals = np.bincount(levels[0].before[levels[0].of], minlength=len(langs))
    out = [pa.table([names, pa.array(np.zeros(len(langs), "i4")), pa.array([""] * len(langs), pa.string()), pa.array(totals)], schema=_FOUND)]
    at = 0
    for k, level in enumerate(levels):
        own = np.flatnonzero(frequent[at : at + len(level.keys)])
        at += len(level.keys)
        counts, chain, parts = level.counts()[own], own, []
        for lower in levels[k::-1]:
            parts.append(words.take(pa.array(lower.last[chain])).cast(pa.string()))
            chain = lower.before[chain]
        phrase = pc.binary_join_element_wise(*parts[::-1], " ") if k else parts[0]
        out.append(pa.table([names.take(pa.array(chain)), pa.array(np.full(len(own), k + 1, "i4")), phrase, pa.array(counts)], schema=_FOUND))
    return out


@cleared
def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    counts = stored(phrase_counts(docs, max_words, min_count), "phrases")
    known = counts.filter("words > 0").select("lang", "phrase", F.col("n").alias("a"))
    longer = counts.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice(word, 1, F.col("k")), " ")).withColumn("tail", F.array_join(F.slice(word, F.col("k") + 1, F.col("words")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The longer candidates' parts of two words and more, each with its most frequent whole.
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    parts = longer.filter("words > 2").select("lang", "words", "phrase", "a", size).select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    whole = parts.groupBy("lang", F.array_join(F.slice(word, F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("whole"))
    left = best.join(whole, ["lang", "phrase"], "left").filter(F.col("whole").isNull() | (100 * F.col("whole") < covered_percent * F.col("a")))
    left = stored(left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), "phrases-scored")
    # The best of random shares first: shares and the last sort both have about the square root of top x candidates.
    ranks = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(math.ceil(math.sqrt(max(1, left.count()) / top))))
    some = left.withColumn("share", share).withColumn("rank", ranks("share")).filter(F.col("rank") <= top).drop("rank", "share")
    total = counts.filter("words = 0").select("lang", "n")
    some = some.withColumn("rank", ranks()).filter(F.col("rank") <= top)
    return some.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH piece AS (SELECT row_number() OVER () AS p, lang, ws FROM (SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)) WHERE len(ws) > 0),
gram AS (SELECT lang, 1 AS words, unnest(ws) AS phrase FROM piece
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM piece WHERE len(ws) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM piece WHERE len(ws) > 2),
f AS (SELECT lang, words, phrase, count(*) AS a FROM gram GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
cut AS (SELECT lang, phrase, words, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c UNION ALL SELECT lang, phrase, words, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
whole AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE words = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN whole ON whole.lang = best.lang AND whole.part = best.phrase WHERE whole.a IS NULL OR 100 * whole.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""
