"""Suffix-array dedup: removal of every byte that a 50-byte string from an earlier document covers.

Texts are taken as UTF-8 bytes and packed into blocks. (1) Every 50-byte window has a minimizer, its 20-byte
substring of the smallest hash, and equal windows have equal ones. Blocks send the sorted hashes of their
minimizers by shards of hash values, and learn which of them occur in more than one document. (2) Around
those that do, blocks cut the text into runs of windows with one minimizer, merge equal runs, and send them
by minimizer, so that all equal windows meet. (3) Each task builds the suffix array of its runs in two
stages: only suffixes smaller than their successors are sorted directly (on their first 50 bytes, eight at a
time, as long as they tie); the rest are induced by a scan of the buckets in ascending order. The lengths of the
common prefixes of neighbours in the array tell which windows are equal, and each group's smallest doc_id marks
the others. (4) Marks go back to the blocks, which drop the bytes covered. Of a run that a block has several
times only its smallest doc_id goes out, as its other documents are covered for certain: a run that occurs in a
third of all documents is sent once by each block, and nothing is dropped or capped. Runs of a minimizer that more
than HOT blocks have are merged by groups of blocks first (as many groups as the square root of the blocks), so the
task where they meet gets a run from each group.

Equal runs within a block are found by 64-bit hashes of their bytes and lengths under one minimizer.

Cases: null texts are empty; documents under 50 bytes stay whole; rows with one doc_id don't remove each
other's bytes; repeated rows under different ids do; extra columns, whatever their names, are kept by
dedup_passages; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, release, spread, stored, text_bytes
from tessera.llm.shingles import _R, _R_INV, _powers_of, mix

LENGTH, SEED, BLOCK, RUN = 50, 20, 8 << 20, 1 << 19
#: Runs of a minimizer in more blocks than this are merged by groups of blocks first.
HOT = 256
#: Stands for the task of marks that need no other block.
LOCAL = -1


# Suffix arrays ---------------------------------------------------------------------------------------


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last is taken to be larger than the empty one."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])  # last places of runs of one byte
    up = np.zeros(n, bool)
    if len(differs):
        next_ = np.searchsorted(differs, np.arange(n))
        inside = next_ < len(differs)
        at = differs[next_[inside]]
        up[inside] = text[at] < text[at + 1]
    return up


def words_of(text: np.ndarray, beyond: int = 0) -> np.ndarray:
    """The eight bytes at each place (and at `beyond` places after the end) as an integer; zeros follow the text."""
    n = len(text) + beyond
    padded = np.concatenate([text, np.zeros(beyond + 8, "u1")])
    words = np.zeros(n, "u8")
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : n + k]
    return words


def sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` in order of their suffixes' first `depth` bytes. Only these positions are sorted, by eight bytes
    at a time, and from the second time on only those that still tie."""
    if not len(at):
        return at
    words, at = words_of(text, depth), at.copy()
    todo, group = np.arange(len(at)), np.zeros(len(at), "i8")  # places in `at` that tie, and with whom
    for k in [*range(0, depth - 8, 8), depth - 8]:
        own = words[at[todo] + k]
        order = np.lexsort((own, group)) if k else np.argsort(own, kind="stable")
        at[todo], own = at[todo[order]], own[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (group[order][1:] != group[order][:-1])])
        ties = ~new
        ties[:-1] |= ~new[1:]
        todo, group = todo[ties], np.cumsum(new)[ties]
        if not len(todo):
            break
    return at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All positions in order of their suffixes' first `depth` bytes, by two-stage sorting.

    The suffixes smaller than their successors are sorted directly. Then the buckets of first bytes are
    scanned in ascending order: where suffix i has its place, suffix i - 1 follows as the next of its own
    bucket if it is larger than i. In a bucket these come before the directly sorted ones; those that
    start with a run of the bucket's byte come from the bucket itself, a wave for each byte of the run.
    """
    n = len(text)
    if not n:
        return np.zeros(0, "i8")
    up = smaller_than_next(text)
    direct = sorted_directly(text, np.flatnonzero(up), depth)
    direct = direct[np.argsort(text[direct], kind="stable")]
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([n - 1])]}
    out = []
    for c in range(256):
        arrivals = waiting.pop(c, None)
        if arrivals is None and ends[c] == ends[c + 1]:
            continue
        parts, wave = [], np.concatenate(arrivals) if arrivals else np.zeros(0, "i8")
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~up[before]]
        own = np.concatenate([*parts, direct[ends[c] : ends[c + 1]]])
        out.append(own)
        before = own[own > 0] - 1
        before = before[text[before] > c]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before, bytes_ = before[order], text[before[order]]
            cuts = np.flatnonzero(np.concatenate([[True], bytes_[1:] != bytes_[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                waiting.setdefault(int(bytes_[a]), []).append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each place in the array the bytes that its suffix shares with the one before it, `depth` at most."""
    words = words_of(text, depth)
    room = len(text) - order
    most = np.zeros(len(order), "i8")
    most[1:] = np.minimum(np.minimum(room[1:], room[:-1]), depth)
    length, at, k = most.copy(), np.flatnonzero(most), 0
    while len(at):
        differ = words[order[at] + k] ^ words[order[at - 1] + k]
        ends = differ != 0
        place, bits = at[ends], differ[ends]
        same = sum((bits < np.uint64(1 << (64 - 8 * n))).astype("i8") for n in range(1, 8))  # leading zero bytes
        length[place] = np.minimum(k + same, most[place])
        k += 8
        at = at[~ends & (most[at] > k)]
    return length


# Blocks ----------------------------------------------------------------------------------------------


def pack(parts: list[bytes], level: int = 3) -> bytes:
    import zstandard

    done = [zstandard.ZstdCompressor(level=level).compress(p) for p in parts]
    return struct.pack(f"<{len(done) + 1}q", len(done), *map(len, done)) + b"".join(done)


def unpack(packed: bytes) -> list[bytes]:
    import zstandard

    n = struct.unpack_from("<q", packed)[0]
    sizes, at, out = struct.unpack_from(f"<{n}q", packed, 8), 8 * (n + 1), []
    for s in sizes:
        out.append(zstandard.ZstdDecompressor().decompress(packed[at : at + s]))
        at += s
    return out


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind)


def windows(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one minimizer: (document, place in data, windows, hash of the minimizer,
    hash of the run's bytes)."""
    n, w = len(data), length - seed + 1
    none = np.zeros(0, "i8")
    if n < length:
        return none, none, none, none.astype("u8"), none.astype("u8")
    prefix = np.zeros(n + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _powers_of(_R, n), out=prefix[1:])
    back = _powers_of(_R_INV, n + 1)
    hashes = mix((prefix[seed:] - prefix[: n - seed + 1]) * back[: n - seed + 1])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype="u8")
    span = 1
    while span < w:  # least[i]: of i .. i + span - 1
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= ends[row]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none.astype("u8"), none.astype("u8")
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype("i8")
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([head, [len(start)]]))
    begin = start[head]
    whole = mix((prefix[begin + count + length - 1] - prefix[begin]) * back[begin] + count.astype("u8"))
    return row[begin], begin, count, hashes[place[head]], whole


def _runs_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, lengths) of stretches of about RUN bytes, whole documents."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN or i == len(texts) - 1:
            own = texts[first : i + 1]
            yield first, np.frombuffer(b"".join(own), "u1"), np.array([len(x) for x in own])
            first, size = i + 1, 0


def split_texts(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[e - n : e] for e, n in zip(ends, lengths.tolist())]


def shared_hashes(blobs: list[tuple[np.ndarray, np.ndarray]], hot: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block's (sorted hashes, whether in several of its documents), which of its hashes several documents have,
    and which of them more than `hot` blocks."""
    every = np.concatenate([h for h, _ in blobs])
    several = np.concatenate([s for _, s in blobs])
    order = np.argsort(every)
    own = every[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, "i8")
    sizes = np.diff(np.concatenate([heads, [len(own)]]))
    blocks = np.zeros(len(own), "i8")
    blocks[order] = np.repeat(sizes, sizes)
    cuts = np.cumsum([len(h) for h, _ in blobs])[:-1]
    return np.split((blocks > 1) | several, cuts), np.split(blocks > hot, cuts)


def merged_runs(blobs: list[tuple[int, bytes]], length: int = LENGTH) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """Several blocks' runs for one task, (block, packed) each, with equal runs merged: (what goes on, marks of what is
    covered for certain). Of equal runs the occurrences in the smallest doc_id go on, under their own blocks."""
    known: dict[bytes, int] = {}
    held = []
    for at, (_, packed) in enumerate(blobs):
        lane, count, times, doc, row, place, raw = unpack(packed)
        count, times = _array(count, "u1").astype("i8"), _array(times, "i4").astype("i8")
        own = np.array([known.setdefault(r, len(known)) for r in split_texts(raw, count + length - 1)], "i8")
        each = np.repeat(np.arange(len(own)), times)
        held.append((own[each], _array(doc, "i8"), np.full(len(each), at), _array(row, "i4"), _array(place, "i8"), count[each], _array(lane, "u1")[each]))
    run, doc, at, row, place, count, lane = (np.concatenate(x) for x in zip(*held))
    first = np.full(len(known), np.iinfo("i8").max)
    np.minimum.at(first, run, doc)
    stays, texts = doc == first[run], list(known)
    on, sure = [], []
    for k, (block, _) in enumerate(blobs):
        mine = np.flatnonzero((at == k) & stays)
        if len(mine):
            mine = mine[np.argsort(run[mine], kind="stable")]
            heads = np.flatnonzero(np.concatenate([[True], run[mine][1:] != run[mine][:-1]]))
            times = np.diff(np.concatenate([heads, [len(mine)]]))
            one = mine[heads]
            on.append((block, pack([lane[one].tobytes(), count[one].astype("u1").tobytes(), times.astype("i4").tobytes(), doc[mine].tobytes(), row[mine].tobytes(), place[mine].tobytes(), b"".join(texts[r] for r in run[one].tolist())], 1)))
        gone = np.flatnonzero((at == k) & ~stays)
        if len(gone):
            bits = (np.uint64(1) << count[gone].astype("u8")) - np.uint64(1)
            sure.append((block, pack([row[gone].tobytes(), place[gone].tobytes(), bits.tobytes()], 1)))
    return on, sure


def marks_of(data: np.ndarray, counts: np.ndarray, times: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each occurrence of each run, a bit for each of its windows that a smaller doc_id has too.

    data: the runs' bytes; counts: windows of each; times: occurrences of each; docs: their doc_ids, run by run."""
    sizes = counts + length - 1
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(data, length)
    same = common_prefixes(data, order, length) >= length
    # Only windows inside a run count; what starts later is there for its neighbours' order.
    number = np.repeat(np.arange(len(counts)), sizes)
    offset = np.arange(len(data)) - begins[number]
    window = (offset < counts[number])[order]
    own, group = order[window], np.cumsum(~same)[window]
    firsts = np.cumsum(times) - times
    least_doc = np.minimum.reduceat(docs, firsts)[number[own]]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    best = np.minimum.reduceat(least_doc, heads)
    first = np.zeros(len(data), "i8")
    first[own] = np.repeat(best, np.diff(np.concatenate([heads, [len(own)]])))
    run = np.repeat(np.arange(len(counts)), times)  # of each occurrence
    out = np.zeros(len(docs), "u8")
    for k in range(int(counts.max())):
        at = np.flatnonzero(counts[run] > k)
        hit = docs[at] > first[begins[run[at]] + k]
        out[at[hit]] |= np.uint64(1 << k)
    return out


# The operator ----------------------------------------------------------------------------------------


def _marked(docs: DataFrame, length: int, seed: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, marks): marks has (block, marks) with rows, places and bits."""
    total = text_bytes(docs)
    shards, hot = max(1, math.ceil(total / block_bytes)), HOT
    tasks = max(1, math.ceil(total / (3 << 20)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            packed = pack([np.asarray(ids, "i8").tobytes(), np.array([len(t) for t in texts], "i8").tobytes(), b"".join(texts)])
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([packed], pa.binary())], ["block", "packed"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block()
        release()

    # A null id is smaller than all others.
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    blocks = stored(docs.select(low.alias("doc_id"), "text").mapInArrow(gather, "block long, packed binary"), "suffix-blocks")

    def cut(texts: list[bytes]) -> list[tuple]:
        return [(first, data, lengths, windows(data, lengths, length, seed)) for first, data, lengths in _runs_of(texts)]

    def open_block(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
        ids, lengths, data = unpack(packed)
        return _array(ids, "i8"), split_texts(data, _array(lengths, "i8"))

    def minimizers(ids: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The block's sorted minimizer hashes, and whether several doc_ids have each."""
        held_h, held_d = [], []
        for first, _, _, (row, _, _, hashes, _) in found:
            held_h.append(hashes)
            held_d.append(ids[first + row])
        hashes, owner = np.concatenate(held_h or [np.zeros(0, "u8")]), np.concatenate(held_d or [np.zeros(0, "i8")])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        if not len(hashes):
            return hashes, np.zeros(0, bool)
        cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[cuts], np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, texts = open_block(packed)
                hashes, several = minimizers(ids, cut(texts))
                shard = np.floor(hashes.astype("f8") * (shards / 2.0**64)).astype("i8").clip(0, shards - 1)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                for k in range(shards):
                    a, b = cuts[k], cuts[k + 1]
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([block]), pa.array([pack([np.diff(hashes[a:b], prepend=np.uint64(0)).tobytes(), np.packbits(several[a:b]).tobytes()], 1)], pa.binary())], ["shard", "block", "packed"])

    def find_shared(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blobs = []
        for packed in table.column("packed").to_pylist():
            gaps, several = unpack(packed)
            hashes = np.cumsum(_array(gaps, "u8"))
            blobs.append((hashes, np.unpackbits(_array(several, "u1"), count=len(hashes)).astype(bool)))
        shared = [pack([np.packbits(s).tobytes(), np.packbits(h).tobytes()], 1) for s, h in zip(*shared_hashes(blobs, hot))]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "shared": pa.array(shared, pa.binary())})

    hashes = blocks.mapInArrow(send_hashes, "shard long, block long, packed binary")
    shared = stored(spread(hashes, "shard").groupBy("shard").applyInArrow(find_shared, "block long, shard long, shared binary"), "suffix-shared")

    groups = max(1, math.isqrt(blocks.count()))

    def send_runs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for block, packed in zip(left.column("block").to_pylist(), left.column("packed").to_pylist()):
            ids, texts = open_block(packed)
            all_windows = cut(texts)
            every, _ = minimizers(ids, all_windows)
            shard = np.floor(every.astype("f8") * (shards / 2.0**64)).astype("i8").clip(0, shards - 1)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            wanted, often = np.zeros(len(every), bool), np.zeros(len(every), bool)
            for k, bits in zip(right.column("shard").to_pylist(), right.column("shared").to_pylist()):
                for flags, packed_bits in zip((wanted, often), unpack(bits)):
                    flags[cuts[k] : cuts[k + 1]] = np.unpackbits(_array(packed_bits, "u1"), count=cuts[k + 1] - cuts[k]).astype(bool)
            every, often = every[wanted], often[wanted]
            if not len(every):
                continue
            held: list[list] = [[], [], [], [], [], []]
            pieces: list[bytes] = []
            for first, data, lengths, (row, begin, count, own, whole) in all_windows:
                found = every[np.searchsorted(every, own).clip(0, len(every) - 1)] == own
                row, begin, count, own, whole = row[found], begin[found], count[found], own[found], whole[found]
                raw = data.tobytes()
                starts = np.cumsum(lengths) - lengths
                pieces += [raw[b : b + c + length - 1] for b, c in zip(begin.tolist(), count.tolist())]
                for k, v in enumerate((ids[first + row], first + row, begin - starts[row], count, own, whole)):
                    held[k].append(v)
            doc, row, place, count, own, whole = map(np.concatenate, held)
            # Runs of very frequent minimizers go to the same task by way of a group of blocks.
            task = (mix(own) % np.uint64(tasks)).astype("i8") * 2 + often[np.searchsorted(every, own)]
            group = block % groups
            order = np.lexsort((whole, own, task))
            new = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
            heads = np.flatnonzero(new)
            # A run's documents after its first are covered, whatever other blocks have.
            number = np.cumsum(new) - 1
            first = np.minimum.reduceat(doc[order], heads)
            later = doc[order] > first[number]
            sure = order[later]
            if len(sure):
                bits = (np.uint64(1) << count[sure].astype("u8")) - np.uint64(1)
                out.append((LOCAL, -1, block, pack([row[sure].astype("i4").tobytes(), place[sure].astype("i8").tobytes(), bits.tobytes()], 1)))
            kept, order = order[heads], order[~later]
            times = np.bincount(number[~later], minlength=len(heads))
            cuts = np.searchsorted(task[kept], np.arange(2 * tasks + 1))
            ends = np.concatenate([[0], np.cumsum(times)])
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                a, b = cuts[k], cuts[k + 1]
                at = order[ends[a] : ends[b]]
                blob = pack([(own[kept[a:b]] >> np.uint64(24)).astype("u1").tobytes(), count[kept[a:b]].astype("u1").tobytes(), times[a:b].astype("i4").tobytes(), doc[at].tobytes(), row[at].astype("i4").tobytes(), place[at].astype("i8").tobytes(), b"".join([pieces[i] for i in kept[a:b].tolist()])], 1)
                out.append((k >> 1, group if k & 1 else -1, block, blob))
        release()
        columns = [*zip(*out)] if out else [(), (), (), ()]
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("task", "grp", "block", "packed"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

    runs = stored(spread(blocks, "block").groupBy("block").cogroup(spread(shared, "block").groupBy("block")).applyInArrow(send_runs, "task long, grp long, block long, packed binary"), "suffix-runs")

    def merge(table: pa.Table) -> pa.Table:
        table, task = table.sort_by("block"), table.column("task")[0].as_py()
        on, sure = merged_runs([*zip(table.column("block").to_pylist(), table.column("packed").to_pylist())], length)
        release()
        rows = [(task, *r) for r in on] + [(LOCAL, *r) for r in sure]
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("task", "block", "packed"), zip(*rows), (pa.int64(), pa.int64(), pa.binary()))})

    plain, frequent = runs.filter("grp < 0").drop("grp"), runs.filter("grp >= 0")
    if not frequent.isEmpty():
        plain = plain.unionByName(stored(spread(frequent, "task", "grp").groupBy("task", "grp").applyInArrow(merge, "task long, block long, packed binary"), "suffix-merged"))
    sure, sent = plain.filter(F.col("task") == LOCAL).select("block", F.col("packed").alias("marks")), plain.filter(F.col("task") != LOCAL)

    def mark(table: pa.Table) -> pa.Table:
        # Equal runs of several blocks become one; the others are split by their minimizers into small arrays.
        known: dict[bytes, int] = {}
        lanes, numbers, times, docs_, where = [], [], [], [], []
        for block, packed in zip(table.column("block").to_pylist(), table.column("packed").to_pylist()):
            lane, count, time, doc, row, place, raw = unpack(packed)
            count = _array(count, "u1").astype("i8")
            own = [known.setdefault(r, len(known)) for r in split_texts(raw, count + length - 1)]
            lanes.append(np.stack([np.array(own), _array(lane, "u1").astype("i8")]))
            times.append(_array(time, "i4").astype("i8"))
            numbers.append(np.repeat(np.array(own), times[-1]))
            docs_.append(_array(doc, "i8"))
            where.append((block, _array(row, "i4"), _array(place, "i8")))
        runs_ = list(known)
        lane_of = np.zeros(len(runs_), "i8")
        for own, lane in lanes:
            lane_of[own] = lane
        number, doc = np.concatenate(numbers), np.concatenate(docs_)
        order = np.argsort(number, kind="stable")
        at_run = np.searchsorted(number[order], np.arange(len(runs_) + 1))
        sizes = np.array([len(r) for r in runs_])
        found = np.zeros(len(doc), "u8")
        splits = max(1, int(sizes.sum() >> 19))
        part_of = lane_of * splits >> 8
        for part in np.unique(part_of):
            mine = np.flatnonzero(part_of == part)
            at = np.concatenate([order[at_run[i] : at_run[i + 1]] for i in mine.tolist()])
            data = np.frombuffer(b"".join([runs_[i] for i in mine.tolist()]), "u1")
            found[at] = marks_of(data, sizes[mine] - length + 1, at_run[mine + 1] - at_run[mine], doc[at], length)
        blocks_, packed_, at = [], [], 0
        for block, row, place in where:
            own = found[at : at + len(row)]
            at += len(row)
            hit = own != 0
            if hit.any():
                blocks_.append(block)
                packed_.append(pack([row[hit].tobytes(), place[hit].tobytes(), own[hit].tobytes()], 1))
        release()
        return pa.table({"block": pa.array(blocks_, pa.int64()), "marks": pa.array(packed_, pa.binary())})

    return blocks, stored(spread(sent, "task").groupBy("task").applyInArrow(mark, "block long, marks binary"), "suffix-marks").unionByName(sure)


def covered(sizes: np.ndarray, row: np.ndarray, place: np.ndarray, bits: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(mask over the documents' bytes, starts): the bytes that marked windows cover."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = []
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        own = (bits >> np.uint64(k)) & np.uint64(1) == 1
        held.append(starts[row[own]] + place[own] + k)
    at = np.concatenate(held or [np.zeros(0, "i8")])
    steps = np.bincount(at, minlength=starts[-1] + 1) - np.bincount(at + length, minlength=starts[-1] + 1)
    return np.cumsum(steps[:-1]) > 0, starts


def _per_document(docs: DataFrame, length: int, seed: int, block_bytes: int, with_text: bool) -> DataFrame:
    blocks, marks = _marked(docs, length, seed, block_bytes)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        parts = [unpack(p) for p in right.column("marks").to_pylist()]
        row, place, bits = (np.concatenate([_array(p[i], kind) for p in parts] or [np.zeros(0, kind)]) for i, kind in enumerate(("i4", "i8", "u8")))
        for packed in left.column("packed").to_pylist():
            ids, lengths, data = unpack(packed)
            lengths = _array(lengths, "i8")
            mask, starts = covered(lengths, row, place, bits, length)
            view = np.frombuffer(data, "u1")
            for k, (doc, a, b) in enumerate(zip(_array(ids, "i8").tolist(), starts[:-1].tolist(), starts[1:].tolist())):
                own = mask[a:b]
                n = int(own.sum())
                kept = view[a:b][~own].tobytes() if n else data[a:b]
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                doc = None if doc == -(1 << 63) else doc
                if not with_text:
                    out.append((doc, b - a, n, spans, hashlib.sha256(kept).hexdigest()))
                elif n:
                    out.append((doc, hashlib.sha256(data[a:b]).hexdigest(), kept.decode("utf-8", "ignore")))
        names = DIGEST if not with_text else CUT
        columns = [*zip(*out)] if out else [()] * len(names)
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(names, columns)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if not with_text else "_id long, _sha string, _kept string"
    return spread(blocks, "block").groupBy("block").cogroup(spread(marks, "block").groupBy("block")).applyInArrow(finish, schema)


DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
CUT = [("_id", pa.int64()), ("_sha", pa.string()), ("_kept", pa.string())]


def passage_report(docs: DataFrame, length: int = LENGTH, seed: int = SEED, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _per_document(docs, length, seed, block_bytes, False)


def dedup_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED, block_bytes: int = BLOCK) -> DataFrame:
    """The documents without the bytes that earlier ones hold (a character cut in two goes whole; n_chars, where
    there is one, counts anew); those left without any text go, if they lost some. All columns stay."""
    id_, sha, kept = free_names(docs, "id", "sha", "kept")
    cut = _per_document(docs, length, seed, block_bytes, True).dropDuplicates(["_id", "_sha"]).select(F.col("_id").alias(id_), F.col("_sha").alias(sha), F.col("_kept").alias(kept))
    found = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(sha)), "left")
    out = found.filter(F.col(kept).isNull() | (F.trim(kept) != ""))
    text = F.coalesce(kept, "text")
    return out.select(*[text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" and isinstance(docs.schema[c].dataType, T.IntegralType) else F.col(c) for c in docs.columns])
