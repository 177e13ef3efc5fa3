"""Word n-grams of blocks of documents, and messages between blocks and pages of hash space.

A block is some megabytes of whole documents, split into words once and kept in the shared folder. Each
n-gram of a block is a distinct number, found level by level (the n-gram's first n - 1 words and its last), and
has a 64-bit hash made of its words' hashes. Hash space is cut into pages whose number grows with the text, so a
page holds about as much at every size. A block sends each page one sorted, gap-coded list; the page answers
block by block in the same order. Nothing but these lists moves, and no page or block grows with the input.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from tessera.llm.common import release
from tessera.llm.shingles import mix
from tessera.llm.suffixes import pack, unpack

BLOCK = 8 << 20
#: Bytes of text for each page, which has some millions of entries then.
PAGE = 8 << 20
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
#: Counts from here on take eight bytes more.
LARGE = 255


class Block:
    """Documents as word numbers. about: what came with each text; counts: words of each; ids: all words in turn;
    joined: whether the next word follows in the same piece; words: the distinct words."""

    def __init__(self, about: list, counts: np.ndarray, ids: np.ndarray, joined: np.ndarray, words: list[bytes]):
        self.about, self.counts, self.ids, self.joined, self.words = about, counts, ids, joined, words

    def packed(self) -> bytes:
        lengths = np.array([len(w) for w in self.words], "<i4")
        return pack([json.dumps(self.about).encode(), self.counts.astype("<i8").tobytes(), self.ids.astype("<i4").tobytes(), np.packbits(self.joined).tobytes(), lengths.tobytes(), b"".join(self.words)])

    @staticmethod
    def unpacked(data: bytes) -> Block:
        about, counts, ids, joined, lengths, raw = unpack(data)
        ids, ends = np.frombuffer(ids, "<i4").astype("i8"), np.cumsum(np.frombuffer(lengths, "<i4"), dtype="i8").tolist()
        words = [raw[a:b] for a, b in zip([0, *ends], ends)]
        return Block(json.loads(about), np.frombuffer(counts, "<i8"), ids, np.unpackbits(np.frombuffer(joined, "u1"), count=len(ids)).astype(bool), words)


def split_words(about: list, texts: list[bytes], space: bytes, cut: bytes = b"") -> Block:
    """Texts in lower case (A to Z only), split at bytes of `cut` into pieces and at `space` into words."""
    glue = (cut or space)[:1]
    data = np.frombuffer(glue + glue.join(texts) + glue, "u1")
    kind = np.zeros(256, "u1")
    kind[[*space]], kind[[*cut]] = 1, 2
    of = kind[data]
    word = of == 0
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    sizes = np.array([len(t) + 1 for t in texts], "i8")
    text = np.searchsorted(np.cumsum(sizes) - sizes + 1, begins, "right") - 1
    piece = np.searchsorted(np.flatnonzero(of == 2), begins)
    joined = np.zeros(len(begins), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype("i8")
    raw = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[word]])])
    coded = raw.dictionary_encode()
    return Block(about, np.bincount(text, minlength=len(texts)), coded.indices.to_numpy().astype("i8"), joined, coded.dictionary.to_pylist())


def blocks_of(docs: DataFrame, about: list[Column], text: Column, space: bytes, cut: bytes = b"", block_bytes: int = BLOCK) -> DataFrame:
    """(block, packed) for all rows; a null text is empty. One document may be larger than a block."""
    width = len(about)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            packed = split_words(held, texts, space, cut).packed()
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([packed], pa.binary())], ["block", "packed"])

        for batch in batches:
            own = [*zip(*(batch.column(k).to_pylist() for k in range(width)))]
            for what, t in zip(own, batch.column(width).cast(pa.binary()).to_pylist()):
                held.append(what)
                texts.append(t or b"")
                size += len(texts[-1]) + 1
                if size >= block_bytes:
                    yield block()
                    number, held, texts, size = number + 1, [], [], 0
        if held:
            yield block()
        release()

    named = [c.alias(f"about{k}") for k, c in enumerate(about)]
    return docs.select(*named, text.alias("text")).mapInArrow(gather, "block long, packed binary")


class Level:
    """Distinct n-grams of one length: before (number of the first n - 1 words' n-gram), last (word), keys (both, in
    ascending order), of (n-gram that starts at each place, or -1) and after (number of the last n - 1 words')."""

    def __init__(self, keys: np.ndarray, size: int, of: np.ndarray):
        self.keys, self.size, self.of = keys, size, of
        self.before, self.last = keys // size, keys % size
        self.after: np.ndarray = np.zeros(0, "i8")

    def counts(self, where: np.ndarray | None = None) -> np.ndarray:
        own = self.of if where is None else self.of[where]
        return np.bincount(own[own >= 0], minlength=len(self.keys))


def levels_of(first: np.ndarray, ids: np.ndarray, joined: np.ndarray, size: int, order: int) -> list[Level]:
    """The n-grams of 1 to `order` words. first: what tells words apart beside their number, such as a language's."""
    keys, of = np.unique(first * size + ids, return_inverse=True)
    out, at = [Level(keys, size, of.astype("i4"))], np.arange(len(ids))
    for k in range(1, order):
        at = at[joined[at + k - 1]] if len(at) else at
        keys, inverse = np.unique(out[-1].of[at].astype("i8") * size + ids[at + k], return_inverse=True)
        level = Level(keys, size, np.full(len(ids), -1, "i4"))
        level.of[at] = inverse
        level.after = np.zeros(len(keys), "i8")
        level.after[inverse] = out[-1].of[at + 1]
        out.append(level)
    return out


def hashes_of(levels: list[Level], first: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """A 64-bit hash of each n-gram, from hashes of the words and of `first`."""
    out: list[np.ndarray] = []
    for k, level in enumerate(levels):
        before = (out[-1] if k else first)[level.before]
        out.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + words[level.last] + np.uint64(k + 1)))
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), "u8", len(words))


# Messages --------------------------------------------------------------------------------------------


def page_of(hashes: np.ndarray, pages: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(pages)) >> np.uint64(32)).astype("i8")


def page_start(page: int, pages: int) -> int:
    """The smallest hash of a page."""
    return -(-(page << 32) // pages) << 32


def put_values(values: np.ndarray, base: int) -> bytes:
    """Ascending numbers from base on as gaps of as few bytes as the widest takes."""
    gaps = np.diff(values, prepend=np.uint64(base))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view("u1").reshape(-1, 8)[:, :width].tobytes()


def get_values(data: bytes, base: int) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, "u1", offset=1).reshape(-1, width)
    gaps = np.zeros((len(raw), 8), "u1")
    gaps[:, :width] = raw
    return np.cumsum(gaps.view("<u8").ravel()) + np.uint64(base)


def put_counts(counts: np.ndarray) -> bytes:
    return np.minimum(counts, LARGE).astype("u1").tobytes() + counts[counts >= LARGE].astype("<i8").tobytes()


def get_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, "u1", n).astype("i8")
    out[out == LARGE] = np.frombuffer(data, "<i8", offset=n)
    return out


def message(values: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    listed = put_values(values, base)
    return struct.pack("<qq", len(values), len(listed)) + listed + put_counts(counts)


def opened(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<qq", data)
    return get_values(data[16 : 16 + size], base), get_counts(data[16 + size :], n)


def sending(lists: Callable[[Block], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Callable[[int], int]]]]):
    """A function for mapInArrow: blocks to (page, block, packed). lists(block) gives (number of the first page, page of
    each value, values in ascending order, counts, first value of a page)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, page, values, counts, base in lists(Block.unpacked(packed.as_buffer().to_pybytes())):
                    used, starts = np.unique(page, return_index=True)
                    ends = [*starts[1:].tolist(), len(page)]
                    blobs = [message(values[a:b], counts[a:b], base(k)) for k, a, b in zip(used.tolist(), starts.tolist(), ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(used + offset), pa.array(np.full(len(used), number)), pa.array(blobs, pa.binary())], ["page", "block", "packed"])
                release()

    return send


def replies_of(table: pa.Table) -> list[tuple[int, bytes]]:
    """What pages answered to a block, in the order of pages."""
    return sorted(zip(table.column("page").to_pylist(), table.column("packed").to_pylist()))
