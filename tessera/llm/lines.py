r"""Line dedup by an exact set-similarity join over all lines of a corpus, with built-in functions only.

A line (texts are split at "\n") is the set of its lower-case tokens, which spaces, tabs and returns
separate. Lines with equal sets are one set, which stands at its first line by (doc_id, line number). Of
the sets of at least `min_tokens` tokens (1: all but the empty one), one is dropped if an earlier set has a
Jaccard index of at least the threshold with it, whether that set is dropped itself or not. A line goes if
its set is dropped or it isn't its set's first line.

Tokens are ordered by rarity. Their counts are kept in a table of fixed size (SLOTS counters, one byte
each); any order gives the same result. By the prefix filter, matching sets share one of their first
n - ceil(t * n) + 1 tokens; the length filter and the positional filter bound the overlap, as does a signature
of 128 bits, each the parity of some tokens: the bits in which two differ are tokens that only one set has. Of a
pair the smaller set shares 2t / (1 + t) of its tokens, so of two prefixes' parts behind where that many are left, none meet. The
lines of the pairs that remain are read again from their documents, and compared whole.

A large group of near copies would give the square of its size. So every set is compared first with the
LEADERS earliest that share one of KEYS pairs of neighbours, the most common tokens of its prefix, if more than LEADERS sets
do; sets that match one of them are dropped, and only the others look for an earlier match among all sets, dropped ones too.

Each line's tokens are kept as 64-bit hashes on the executors' disks until they are counted and put in order; what a
lost executor held is made again. Equal sets are found by 192 bits over their codes (a hash of them all and the
signature). Tables of fixed size that every task gets: the counters, and a bitmap (BITS) that tells which documents and
lines to read again. More than FEW_PAIRS pairs would fill it; then the documents and lines to read again are found by joins.

Cases: a null or empty text has one empty line, which stays; documents that share a doc_id follow each
other in order of their texts; repeated rows are later copies; a null doc_id comes first; extra columns,
whatever their names, are kept by dedup_lines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_stored, free_names, stored

THRESHOLD, LEADERS, KEYS, SLOTS, BITS = 0.8, 16, 3, 1 << 20, 1 << 25
#: Up to so many pairs, of two lines and two documents each, a bitmap tells what to read again; beyond, it would be full.
FEW_PAIRS = BITS // 8
_PAGE = 1 << 15  # bits of one page of Spark's bitmaps


def spaced(text: Column) -> Column:
    """A text with spaces for its tabs and returns. Finding out that there are none is cheaper than replacing none."""
    for c in "\t\r":
        text = F.when(F.contains(text, F.lit(c)), F.replace(text, F.lit(c), F.lit(" "))).otherwise(text)
    return text


def tokens(line: Column) -> Column:
    """The hashes of the distinct tokens of a line that spaced() has passed. A line is lower-cased by itself, as one
    without letters beyond ASCII takes far less; no letter's lower case depends on another line."""
    hashes = F.array_distinct(F.transform(F.split(F.lower(line), " "), lambda t: F.xxhash64(t)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def rarity_levels(words: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row: an array of `slots` levels, four for each doubling of the count of the tokens in a slot; half of all
    tokens, about, have a level below zero."""
    slot = F.pmod("w", F.lit(slots)).cast("int").alias("slot")
    counts = words.select(F.explode("h").alias("w")).groupBy(slot).agg(F.count("*").alias("n"))
    # A table of at most `slots` rows, whatever the input's size; missing slots hold no token.
    whole = words.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    level = F.coalesce(F.least(F.lit(127), F.floor(4 * F.log2(F.col("n")))), F.lit(0))
    both = whole.join(counts, "slot", "left").select("slot", level.cast("byte").alias("level"), F.coalesce("n", F.lit(0)).alias("n"))
    all_ = both.agg(F.sort_array(F.collect_list(F.struct("slot", "level"))).alias("all"), F.coalesce(F.percentile("level", 0.5, F.col("n")), F.lit(0)).cast("int").alias("middle"))
    return all_.select(F.transform("all", lambda s: (s["level"] - F.col("middle")).cast("byte")).alias("levels"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, _at, text) with _at unique and in order of (doc_id, text), in steps of 2**bits (room for a document's lines), and bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    s = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    bits = 31  # no text has more bytes than that, so none has more lines
    if s["n"] == s["d"] and (not s["n"] or (s["hi"] - s["lo"]) < 1 << (62 - bits)):
        return rows.select("doc_id", F.shiftleft(F.col("doc_id") - F.lit(s["lo"] or 0), bits).alias("_at"), "text"), bits
    bits = ((rows.agg(F.max(F.octet_length("text"))).first()[0] or 0) + 1).bit_length()
    # Repeated, missing or far-spread ids: number the rows in order instead.
    ranged = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    part, row = F.spark_partition_id().cast("long"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    done = stored(ranged.withColumn("_part", part).withColumn("_row", row), "numbered")
    shift = max(1, (done.agg(F.coalesce(F.max("_row"), F.lit(0))).first()[0] + 1).bit_length())
    return done.select("doc_id", F.shiftleft(F.shiftleft("_part", shift) + F.col("_row"), bits).alias("_at"), "text"), bits


def lines_of(rows: DataFrame) -> DataFrame:
    """(at, line): a line's at is its document's plus its number."""
    lines = rows.select("_at", F.posexplode_outer(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.select((F.col("_at") + F.col("line_no")).alias("at"), "line")


def hashed_sets(words: DataFrame, levels: DataFrame, threshold: float, slots: int) -> DataFrame:
    """(at, key, n, sig, odd, prefix) of every line. A token's code is its level and 48 bits of its hash; prefix holds
    the codes of the rarest. sig and odd have the parity of the tokens of each of 64 values of six bits, sig of those
    with a level below zero, odd of the rest."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    fold = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))
    code = lambda x: F.shiftleft(F.get("levels", F.pmod(x, F.lit(slots)).cast("int")).cast("long"), 48).bitwiseOR(F.shiftrightunsigned(x, 16))
    zero, n = F.lit(0).cast("long"), F.size("z") - 1
    # A zero between the halves tells where to cut. No code is null; Spark sorts faster if it knows that.
    codes = F.transform("h", lambda x: F.coalesce(code(x), zero))
    # The table of levels stays out of the rows: it is named once, so that it is read inside the one projection.
    own = words.select("at", "h", levels.scalar().alias("levels")).select("at", F.sort_array(F.concat(codes, F.array(zero))).alias("z"))
    own = own.select("at", F.xxhash64("z").alias("key"), n.alias("n"), "z", F.array_position("z", zero).cast("int").alias("cut"))
    own = own.select("at", "key", "n", F.slice("z", F.lit(1), F.col("cut") - 1).alias("rare"), F.slice("z", F.col("cut") + 1, F.col("n") + 1).alias("common"))
    length = (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    return own.select("at", "key", "n", fold("rare").alias("sig"), fold("common").alias("odd"), F.slice(F.concat("rare", "common"), F.lit(1), length).alias("prefix"))


def bitmap(ids: DataFrame, bits: int = BITS) -> DataFrame:
    """One row: pages of a bitmap of the hashes of a column `id`."""
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    pages = ids.select(F.floor(slot / _PAGE).cast("int").alias("page"), F.pmod(slot, F.lit(_PAGE)).alias("place")).groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits"))
    whole = ids.sparkSession.range(bits // _PAGE).select(F.col("id").cast("int").alias("page")).join(pages, "page", "left")
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("bits", F.lit(b"")).alias("bits")))), lambda p: p["bits"]).alias("pages"))


def maybe_in(pages: DataFrame, id_: Column, bits: int = BITS) -> Column:
    """Whether an id may be in the bitmap; an eighth as sharp as its bits."""
    slot = F.pmod(F.xxhash64(id_), F.lit(bits))
    own = F.get(pages.scalar(), F.floor(slot / _PAGE).cast("int"))
    return F.bitmap_count(F.substring(own, (F.pmod(slot, F.lit(_PAGE)) / 8).cast("int") + 1, F.lit(1))) > 0


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = 1, leaders: int = LEADERS, keys: int = KEYS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(numbered documents, (at) of each line, (at) of each line to drop, bits); a line's at is its document's plus its number."""
    rows, bits = numbered(docs)
    words = lines_of(rows).select("at", tokens(F.col("line")).alias("h")).persist(StorageLevel.DISK_ONLY)
    try:
        levels = stored(rarity_levels(words, slots), "levels")
        all_lines = stored(hashed_sets(words, levels, threshold, slots), "line-sets")
    finally:
        words.unpersist(blocking=True)
    lines = all_lines.filter(F.col("n") >= max(min_tokens, 1))
    # Equal sets meet once, after each task has picked its own first; all but `at` follows from the set.
    sets = stored(lines.groupBy("key", "n", "sig", "odd", "prefix").agg(F.min("at").alias("id")).drop("key"), "first-lines")

    def pairs(a: DataFrame, b: DataFrame, places: bool, either: bool = False) -> DataFrame:
        """(id_a, id_b) of earlier sets and later open ones; closed sets have a negative n. places: the tokens hold the
        first one that two matching sets share, which passes the positional filter. either: a's set may be the later one."""
        a, b = (df.select("tok", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "i", "sig", "odd"))) for df, side in ((a, "a"), (b, "b")))
        n_a, n_b = F.abs("n_a"), F.abs("n_b")
        need = F.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)
        # Whether the later set is open is asked of both, so that one shuffle of postings serves both sides.
        order = F.when(F.col("id_a") < F.col("id_b"), F.col("n_b")).otherwise(F.col("n_a")) > 0 if either else F.col("id_a") < F.when(F.col("n_b") > 0, F.col("id_b")).otherwise(-1)
        sizes = (n_a >= threshold * n_b - 1e-9) & (n_b >= threshold * n_a - 1e-9)
        fits = F.least(n_a - F.col("i_a"), n_b - F.col("i_b")) >= need if places else F.lit(True)
        apart = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) + F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= n_a + n_b - 2 * need
        return a.join(b, "tok").filter(order & sizes & fits & apart).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))

    def matched(found: DataFrame, tag: str) -> DataFrame:
        """(id) of the later sets of the candidate pairs at or over the threshold."""
        found = stored(found, f"line-pairs-{tag}")
        ids = found.select(F.explode(F.array("id_a", "id_b")).alias("id"))
        if found.count() <= FEW_PAIRS:
            asked = ids.unionByName(ids.select((-1 - F.shiftright("id", bits)).alias("id")))  # lines, and their documents below zero
            pages = stored(bitmap(asked), "line-bitmap")
            again = lines_of(rows.filter(maybe_in(pages, -1 - F.shiftright("_at", bits)))).filter(maybe_in(pages, F.col("at")))
        else:
            pages = stored(ids.distinct(), "line-ids")
            held = pages.select(F.shiftright("id", bits).alias("doc")).distinct()
            again = lines_of(rows.join(held, F.shiftright("_at", bits) == F.col("doc"), "left_semi")).join(pages, F.col("at") == F.col("id"), "left_semi")
        whole = stored(again.select("at", tokens(F.col("line")).alias("h")), "line-tokens")
        one = found.join(whole.select(F.col("at").alias("id_a"), F.col("h").alias("a")), "id_a")
        both = one.join(whole.select(F.col("at").alias("id_b"), F.col("h").alias("b")), "id_b")
        enough = F.size(F.array_intersect("a", "b")) * (1 + threshold) >= threshold * (F.size("a") + F.size("b")) - 1e-9
        done = stored(both.filter(enough).select(F.col("id_b").alias("id")).distinct(), f"matched-{tag}")
        for df in (found, pages, whole):
            drop_stored(df)
        return done

    # Most pairs of neighbours stand in few sets, which the second step can compare all. So pairs are counted first, without
    # their sets, and only larger groups have leaders, by a top-k, which each task applies before the shuffle too. Of a
    # smaller group that leaves `leaders` sets open at most, in place of its first.
    last = F.greatest(F.size("prefix") - keys - 1, F.lit(0))
    two = F.arrays_zip(F.slice("prefix", last + 1, F.lit(keys)).alias("x"), F.slice("prefix", last + 2, F.lit(keys)).alias("y"))
    neighbours = sets.select("id", "n", "sig", "odd", F.posexplode(two).alias("i", "two")).withColumn("tok", F.xxhash64("two.x", "two.y")).drop("two")
    large = stored(neighbours.groupBy("tok").agg(F.count("*").alias("sets")).filter(F.col("sets") > leaders).select("tok"), "line-groups")
    common = stored(neighbours.join(large, "tok", "left_semi"), "line-neighbours")
    heads = common.withColumn("rank", F.row_number().over(Window.partitionBy("tok").orderBy("id"))).filter(F.col("rank") <= leaders)
    early = matched(pairs(heads, common, False).distinct(), "early")
    drop_stored(large)
    drop_stored(common)
    size = F.when(F.col("early"), -F.col("n")).otherwise(F.col("n"))
    rest = sets.join(early.withColumn("early", F.lit(True)), "id", "left").select("id", size.alias("n"), "sig", "odd", F.posexplode("prefix").alias("i", "tok"))
    rest = rest.filter(" AND ".join(f"{c} IS NOT NULL" for c in rest.columns))  # both sides alike
    # Of two matching sets the smaller one shares 2t/(1+t) of its tokens at least, so the first one stands where as many
    # are left; the larger one may have it further on, with fewer left.
    front = F.abs("n") - F.col("i") >= F.ceil(2 * threshold / (1 + threshold) * F.abs("n") - 1e-9)
    fronts = rest.filter(front)
    late = matched(pairs(fronts, fronts, True).unionByName(pairs(fronts, rest.filter(~front), True, True)).distinct(), "late")
    kept = stored(sets.select("id").join(early.unionByName(late), "id", "left_anti"), "line-places")
    drop_stored(sets)
    lost = lines.select("at").join(kept, lines["at"] == kept["id"], "left_anti")
    return rows, all_lines.select("at"), lost, bits


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (numbers from 0, joined by commas) of every document."""
    rows, lines, lost, bits = dropped_lines(docs, **options)
    at = F.shiftleft(F.shiftright("at", bits), bits).alias("_at")
    gone = lost.select(at, F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).alias("line_no")).groupBy("_at").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    # Each document has a line at least; counting lines that are stored spares reading its text again.
    out = rows.select("doc_id", "_at").join(lines.groupBy(at).agg(F.count("*").alias("n_lines")), "_at").join(gone, "_at", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents without the dropped lines (n_chars, where there is one, counts anew); those left without
    any text go, if they had one. All columns stay, as does their order."""
    rows, _, lost, bits = dropped_lines(docs, **options)
    doc, hash_, gone, cut = free_names(docs, "doc", "hash", "gone", "cut")
    each = lost.select(F.shiftleft(F.shiftright("at", bits), bits).alias("_at"), F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("line_no"))
    each = each.groupBy("_at").agg(F.collect_list("line_no").alias("gone"))
    # Rows with one doc_id and one text are copies: the first stands for the rest, whose long lines go.
    about = rows.select("doc_id", F.xxhash64("text").alias("hash"), "_at").join(each, "_at").groupBy("doc_id", "hash").agg(F.min(F.struct("_at", "gone")).alias("least"))
    about = about.select(F.col("doc_id").alias(doc), F.col("hash").alias(hash_), F.col("least.gone").alias(gone))
    found = docs.join(about, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")
    out = found.withColumn(cut, F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).filter(F.col(gone).isNull() | (F.trim(cut) != ""))
    names = [F.col(cut).alias("text") if c == "text" else F.length(cut).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" and isinstance(docs.schema[c].dataType, T.IntegralType) else F.col(c) for c in docs.columns]
    return out.select(*names)


SQL = r"""
WITH l AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), s AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split(replace(replace(lower(line), chr(9), ' '), chr(13), ' '), ' '), lambda x: x <> ''))) AS t FROM l
), d AS (
  SELECT t, len(t) AS n, min((doc_id, line_no)) AS f, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM s WHERE len(t) >= 1 GROUP BY t
), w AS (
  SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM d) GROUP BY w
), o AS (
  SELECT id, n, x.w, row_number() OVER (PARTITION BY id ORDER BY c, x.w) AS i FROM (SELECT id, n, unnest(t) AS w FROM d) x JOIN w ON w.w = x.w
), p AS (
  SELECT * FROM o WHERE i <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1
), c AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
), m AS (
  SELECT DISTINCT c.b AS id FROM c JOIN d x ON x.id = c.a JOIN d y ON y.id = c.b
  WHERE len(list_intersect(x.t, y.t)) >= 0.8 * (x.n + y.n - len(list_intersect(x.t, y.t))) - 1e-9
), g AS (
  SELECT s.doc_id, s.line_no FROM s JOIN d ON d.t = s.t WHERE d.f <> (s.doc_id, s.line_no) OR d.id IN (SELECT id FROM m)
)
SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed, coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed_lines
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id
"""
