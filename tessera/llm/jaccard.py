"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Documents with equal sets of five-word n-grams are one class, and its first document stands for it. The
numbers of bands and rows are the cheapest that find a pair at the threshold with the target recall.
Representatives are shuffled on their band hashes, and those that share one are verified; nothing else is
compared. To send a text seldom, representatives that share bands directly or through others form a candidate
group: where it fits a task its texts meet there once, and the pairs that share a band are verified. A group too large
for a task falls apart into its buckets of one band hash: each pair is verified in the first band that it shares, and a
text goes only to buckets with such a pair of it. A bucket too large for a task is split by size class (sets
whose sizes differ by more than the threshold can't match, so only neighbouring classes meet) and by hash into tiles;
each pair of tiles is a task. Few pairs are verified one by one, many by products of 0/1 matrices over the n-grams that at
least two sets have. Results leave a task as one row a document and bucket, so nothing grows with the square of a group.

Cases: null and empty texts have no n-grams and link with nothing; a text of fewer than five words has one
n-gram, of all of them; repeated rows are copies of each other, and rows that share a doc_id but not the text
count as one document, linked where any of its texts is; a null doc_id is smaller than all others, so a class
whose first document has none has a null class_id; extra columns, whatever their names, are ignored here and
kept by one_of_each_group; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cleared, free_names, release, spread, stored
from tessera.llm.components import connected_components
from tessera.llm.shingles import WORDS, in_runs, mix, shingle_sets

#: A task compares so many n-grams and so many sets at most.
THRESHOLD, RECALL, TASK_GRAMS, TASK_SETS = 0.8, 0.999, 400_000, 2000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def bands_and_rows(threshold: float, recall: float, spurious: float = 0.1) -> tuple[int, int]:
    """The fewest hashes that find a pair at the threshold with this recall, and at half of it with at most `spurious`."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= spurious and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best or (bands, rows)


def band_hashes(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(non-empty texts) x bands: hashes of each band's minima."""
    begin = starts[:-1][np.diff(starts) > 0]
    own = (hashes >> np.uint64(32)).astype("u4")
    rng = np.random.default_rng(11)
    factors, shifts = rng.integers(0, 1 << 32, bands * rows, "u4") | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, "u4")
    out = np.zeros((len(begin), bands), "u8")
    if len(begin):
        for k in range(bands * rows):
            least = np.minimum.reduceat((own ^ shifts[k]) * factors[k], begin)
            out[:, k // rows] = mix(out[:, k // rows] + least.astype("u8") + np.uint64(k + 1))
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairs' intersections."""
    m = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=0)[column] > 1 if len(every) else new
    column, owner = column[shared], owner[shared]
    both = np.zeros((m, m), "f4")
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        width = max(256, min(4096, 4_000_000 // m))
        edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                part = np.zeros((m, width), "f4")
                part[owner[a:b], column[a:b] - k * width] = 1
                both += part @ part.T
    return both


def pair_overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The size of each pair's intersection: both sets' n-grams, sorted pair by pair, tell what is there twice."""
    size = np.array([len(s) for s in sets], "i8")
    out, work = np.zeros(len(left), "i8"), np.cumsum(size[left] + size[right])
    cuts = [0, *(np.searchsorted(work, np.arange(step, work[-1], step)) + 1).tolist(), len(left)] if len(left) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            grams = np.concatenate([g for i, j in zip(left[a:b].tolist(), right[a:b].tolist()) for g in (sets[i], sets[j])])
            pair = np.repeat(np.arange(b - a), size[left[a:b]] + size[right[a:b]])
            order = np.lexsort((grams, pair))
            grams, pair = grams[order], pair[order]
            out[a:b] = np.bincount(pair[1:][(grams[1:] == grams[:-1]) & (pair[1:] == pair[:-1])], minlength=b - a)
    return out


def mates(bands: np.ndarray, band: int | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The pairs to verify. Without a band: those that share any; else all of this bucket that share no earlier band. As
    (left, right) where they are few, else as a matrix."""
    m = len(bands)
    if band is None:
        groups = []
        for k in range(bands.shape[1]):
            order = np.argsort(bands[:, k], kind="stable")
            cuts = np.flatnonzero(np.diff(bands[order, k], prepend=bands[order[0], k] + np.uint64(1))) if m else np.zeros(0, "i8")
            groups += [order[a:b] for a, b in zip(cuts, [*cuts[1:], m]) if b - a > 1]
        if sum(len(g) ** 2 for g in groups) < m * m // 8:
            codes = [np.unique(np.minimum.outer(g, g)[t] * m + np.maximum.outer(g, g)[t]) for g in groups for t in [np.triu_indices(len(g), 1)]]
            codes = np.unique(np.concatenate([*codes, np.zeros(0, "i8")]))
            return codes // m, codes % m
    shared = np.zeros((m, m), bool)
    for k in range(bands.shape[1] if band is None else band):
        shared |= bands[:, k][:, None] == bands[:, k][None, :]
    found = shared if band is None else ~shared
    np.fill_diagonal(found, False)
    return found


def verified(sets: list[np.ndarray], bands: np.ndarray, threshold: float, band: int | None = None, tiles: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(left, right) of all pairs of band mates at or over the threshold, both ways round, and how many were compared;
    tiles: only pairs from different ones."""
    size = np.array([len(s) for s in sets], "i8")
    asked = mates(bands, band)
    if isinstance(asked, tuple):
        left, right = asked
        if tiles is not None:
            other = tiles[left] != tiles[right]
            left, right = left[other], right[other]
        both = pair_overlaps(sets, left, right)
        hit = both >= threshold * (size[left] + size[right] - both) - 1e-9
        return np.concatenate([left[hit], right[hit]]), np.concatenate([right[hit], left[hit]]), len(left)
    if tiles is not None:
        asked &= tiles[:, None] != tiles[None, :]
    both = overlaps(sets)
    found = asked & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)
    return *np.nonzero(found), int(asked.sum()) // 2


def roots(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches through links."""
    own = ids.copy()
    while len(left):
        then = own.copy()
        np.minimum.at(then, left, own[right])
        if (then == own).all():
            break
        own = then
    return own


@cleared
def near_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, task_grams: int = TASK_GRAMS) -> DataFrame:
    """For each document: doc_id, class_id (the smallest doc_id reached through links), copy_id (the smallest
    with an equal set), n_links (other documents at or over the threshold), n_grams, kept."""
    bands, rows = bands_and_rows(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_runs(texts):
                hashes, starts = shingle_sets(texts[a:b], words)
                size = np.diff(starts)
                keys = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(starts[:-1], starts[1:])]
                signed = iter(band_hashes(hashes, starts, bands, rows))
                packed = [next(signed).tobytes() if n else None for n in size]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(size), pa.array(packed, pa.binary()), batch.column(2).slice(a, b - a)], ["doc_id", "key", "n_grams", "bands", "version"])
        release()

    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    texts = docs.select(low.alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    signed = stored(texts.mapInArrow(sign, "doc_id long, key binary, n_grams long, bands binary, version long"), "signatures")
    classes = signed.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "version", "n_grams", "bands")).alias("_f"), F.count("*").alias("copies"))
    classes = stored(classes.select("key", F.col("_f.doc_id").alias("rep"), "_f.version", "_f.n_grams", "_f.bands", "copies"), "classes")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), "i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(mix(packed.view("u8") + np.tile(np.arange(bands, dtype="u8"), batch.num_rows)).view("i8"))], ["rep", "band"])

    banded = classes.select("rep", "bands").mapInArrow(unpack, "rep long, band long")
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = connected_components(banded.join(heads, "band").filter("rep <> head").select("rep", "head").distinct(), "rep", "head")
    linked = stored(_verified(texts, classes, stored(groups, "candidates"), bands, threshold, words, task_grams), "verified")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    alone = linked.filter("NOT split").select(F.col("rep").alias("node"), F.col("root").alias("component"))
    parts = alone.unionByName(connected_components(linked.filter("split").select("rep", "root").distinct(), "rep", "root"))
    about = classes.join(counts, "rep", "left").join(parts, classes.rep == parts.node, "left")
    about = about.select("key", F.col("rep").alias("_rep"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_class"))
    out = signed.select("doc_id", "key", "n_grams").join(about, "key", "left")
    own, known = F.coalesce("_class", "doc_id"), lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(known(F.col("doc_id")).alias("doc_id"), known(own).alias("class_id"), known(F.coalesce("_rep", "doc_id")).alias("copy_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), "n_grams", (F.col("doc_id") == own).alias("kept"))


def _tasks(members: DataFrame, task_grams: int, whole: DataFrame | None = None) -> DataFrame:
    """(rep, version, copies, bands, band, task, tile) of groups' members: one task for a group that fits, else one for each
    pair of tiles of the same or neighbouring size classes. whole: (grp, fits), where it is known."""
    if whole is None:
        whole = _sizes(members, task_grams)
    keep = ["rep", "version", "copies", "bands", "band"]
    small = members.join(whole.filter("fits"), "grp").select(*keep, F.concat(F.lit("g"), "grp").alias("task"), F.lit(0).alias("tile"))
    large = members.join(whole.filter("NOT fits").select("grp"), "grp")
    levels = large.groupBy("grp", "level").agg(F.ceil(F.greatest(F.sum("n_grams") / (task_grams / 2), F.count("*") / (TASK_SETS / 2))).cast("int").alias("tiles"))
    # One row for each group and size class: it finds its own tiles and those of the next larger class.
    above = levels.select("grp", (F.col("level") - 1).alias("level"), F.col("tiles").alias("tiles_above"))
    below = levels.select("grp", (F.col("level") + 1).alias("level"), F.col("tiles").alias("tiles_below"))
    placed = large.join(levels.join(above, ["grp", "level"], "left").join(below, ["grp", "level"], "left"), ["grp", "level"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    name = lambda low, i, j: F.concat_ws(".", "grp", low, i, j)
    inside = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: name(F.concat(F.lit("e"), "level"), F.least("own", o), F.greatest("own", o)))
    upward = F.when(F.col("tiles_above") > 0, F.transform(F.sequence(F.lit(0), F.coalesce("tiles_above", F.lit(1)) - 1), lambda o: name(F.concat(F.lit("u"), "level"), "own", o))).otherwise(F.array().cast("array<string>"))
    downward = F.when(F.col("tiles_below") > 0, F.transform(F.sequence(F.lit(0), F.coalesce("tiles_below", F.lit(1)) - 1), lambda o: name(F.concat(F.lit("u"), F.col("level") - 1), o, "own"))).otherwise(F.array().cast("array<string>"))
    tile = F.col("level") * 1_000_000 + F.col("own")
    big = placed.withColumn("task", F.explode(F.concat(inside, upward, downward))).select(*keep, "task", tile.alias("tile"))
    return small.unionByName(big)


def _sizes(members: DataFrame, task_grams: int) -> DataFrame:
    """(grp, fits): whether a group's sets fit one task."""
    return members.groupBy("grp").agg(((F.sum("n_grams") <= task_grams) & (F.count("*") <= TASK_SETS)).alias("fits"))


def _bucketed(members: DataFrame, bands: int) -> DataFrame:
    """The members of large groups once for each bucket in which they have a pair that no earlier band holds."""
    keep = ["rep", "version", "n_grams", "copies", "level", "bands"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "u8")
            at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            band, hashes = np.tile(np.arange(bands, dtype="i4"), batch.num_rows), mix(packed + np.tile(np.arange(bands, dtype="u8"), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(band), pa.array([f"b{h:x}" for h in hashes.tolist()])], [*keep, "band", "grp"])

    schema = "rep long, version long, n_grams long, copies long, level int, bands binary, band int, grp string"
    rows = members.select(*keep).mapInArrow(unpack, schema)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    rows = stored(rows.join(sizes, "grp"), "buckets")

    def needed(table: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(table.column("bands").to_pylist()), "u8").reshape(-1, bands)
        asked = mates(packed, table.column("band")[0].as_py())
        return table.filter(pa.array(asked.any(axis=1)))

    some = rows.filter(F.col("n") <= TASK_SETS)
    few = spread(some, "grp").groupBy("grp").applyInArrow(needed, some.schema)
    return few.unionByName(rows.filter(F.col("n") > TASK_SETS)).drop("n")


def _verified(texts: DataFrame, classes: DataFrame, groups: DataFrame, bands: int, threshold: float, words: int, task_grams: int) -> DataFrame:
    """(rep, root, links, split) of representatives with verified links, for each task."""
    members = groups.select(F.col("node").alias("rep"), F.col("component").cast("string").alias("grp")).join(classes.select("rep", "version", "n_grams", "copies", "bands"), "rep")
    members = members.withColumn("level", F.floor(F.log("n_grams") / math.log(1 / threshold)).cast("int")).withColumn("band", F.lit(-1))
    whole = stored(_sizes(members, task_grams), "candidate-sizes")
    tasks = _tasks(members.join(whole.filter("fits").select("grp"), "grp"), task_grams, whole.filter("fits"))
    if not whole.filter("NOT fits").isEmpty():
        large = stored(_bucketed(members.join(whole.filter("NOT fits").select("grp"), "grp"), bands), "bucket-members")
        tasks = tasks.unionByName(_tasks(large, task_grams))
    total = members.agg(F.coalesce(F.sum("n_grams"), F.lit(0))).first()[0]
    bins = max(1, math.ceil(total / (2 * task_grams)))
    sent = tasks.join(_texts_of(texts, tasks), ["rep", "version"]).drop("version")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        task = table.column("task").to_pylist()
        own: dict[str, list[int]] = {}
        for i, t in enumerate(task):
            own.setdefault(t, []).append(i)
        reps, copies, tiles, band = (table.column(c).to_numpy() for c in ("rep", "copies", "tile", "band"))
        packed = np.frombuffer(b"".join(table.column("bands").to_pylist()), "u8").reshape(-1, bands)
        out: list[tuple] = []
        for t, at in own.items():
            at = np.array(at)
            kinds = np.unique(tiles[at])
            if len(at) < 2 or (len(kinds) == 1 and t[0] != "g" and (".u" in t or t.split(".")[-1] != t.split(".")[-2])):
                continue  # only one tile of two is there
            hashes, starts = shingle_sets(table.column("text").take(pa.array(at)).to_pylist(), words)
            sets = [hashes[a:b] for a, b in zip(starts[:-1], starts[1:])]
            first = int(band[at[0]])
            left, right, _ = verified(sets, packed[at], threshold, None if first < 0 else first, tiles[at] if len(kinds) > 1 else None)
            root, links = roots(left, right, reps[at]), np.zeros(len(at), "i8")
            np.add.at(links, left, copies[at][right])
            any_ = links > 0
            out += zip(reps[at][any_].tolist(), root[any_].tolist(), links[any_].tolist(), [first >= 0] * int(any_.sum()))
        release()
        columns = [*zip(*out)] if out else [(), (), (), ()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("rep", "root", "links", "split"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))})

    return spread(sent.withColumn("bin", F.pmod(F.xxhash64("task"), F.lit(bins))), "bin").groupBy("bin").applyInArrow(verify, "rep long, root long, links long, split boolean")


def _texts_of(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One text for each representative; rows that share a doc_id are told apart by the text's hash."""
    wanted = tasks.select(F.col("rep").alias("doc_id"), "version").distinct()
    return texts.join(wanted, ["doc_id", "version"], "left_semi").groupBy(F.col("doc_id").alias("rep"), "version").agg(F.first("text").alias("text"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have a smaller doc_id in their class (a null id is the smallest, and rows
    with the class's own id stay); all columns stay."""
    (gone,) = free_names(docs, "gone")
    copies = near_documents(docs, **options).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
