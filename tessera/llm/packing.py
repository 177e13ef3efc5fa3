"""Bounded-space online packing of documents into fixed token windows.

Each input partition keeps a fixed number of open windows. A document goes to the window it fits best;
where it fits none, the fullest window is filled up with the document's head and emitted, and the rest
tries again. The windows that a partition leaves open are merged with those of up to 256 partitions: they
are strung together, fullest first, cut into full windows, and what is left of a group is cut at powers
of two, which need no padding.

Cases: a null or empty text is its end token alone; repeated rows are packed again; extra columns are
dropped; an empty table gives an empty result; a text longer than a window fills several.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_alphabet
from tessera.llm.common import release, stored, tokenizer_file

#: str.split() also splits at these control characters, which are no white space to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters beyond Latin, whose case or composition may depend on their neighbours, and numbers that are no digits.
_HARD = re.compile("[^\x00-\u024f]|[\u0130'\xb2\xb3\xb9\xbc-\xbe]|<\\|")
#: What the tokenizer splits a word of other characters into: letters, single digits, signs.
_PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")
CAPACITY, OPEN, MERGED, CACHE = 4096, 32, 256, 400_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
FIELDS = [(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in map(str.split, PIECES.split(", "))]
#: Finished pieces leave a task in batches of about so many bytes of ids.
FLUSH = 1 << 24


class WordIds(dict):
    """The ids of text between white space, as little-endian unsigned 32-bit bytes; that tokenizer drops
    white space, so these pieces are encoded alike wherever they stand. Emptied when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(tokenizer_file(path))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        marks = {b: c for c, b in byte_alphabet().items()}
        self.marks = {c: "".join(marks[b] for b in chr(c).encode()) for c in range(128, 0x250)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if len(word) > 64 or _HARD.search(word):
            ids = self.whole(word)
        elif (low := word.lower()) != word:  # case is dropped
            ids = self[low]
        elif word.isalpha():  # one run of letters is one input of the model
            ids = np.array([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.marks))], "<u4").tobytes()
        else:
            parts = _PARTS.findall(word)
            ids = b"".join([self[x] for x in parts]) if len(parts) > 1 else self.whole(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return np.asarray(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def document(self, text: str | None, end: int) -> bytes:
        text = text or ""
        words = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.__getitem__, words)) + np.uint32(end).tobytes()


class Packer:
    """Open windows of one partition; finished pieces are rows, open ones keep their ids."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, windows: int = OPEN):
        self.capacity, self.limit = capacity, windows
        self.next, self.open, self.rows, self.held = first_id, [], [], 0

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.next, at))
            self.held += len(ids)
            at += n
        self.next += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, start, cap = len(ids) // 4, 0, self.capacity
        while total - start >= cap:
            self.emit([(doc, start, ids[4 * start : 4 * (start + cap)], total)])
            start += cap
        while (left := total - start) > 0:
            best = min((w for w in self.open if w[0] >= left), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.limit:
                best = [cap, []]
                self.open.append(best)
            if best is None:
                best = min(self.open, key=lambda w: w[0])
            n = min(left, best[0])
            best[1].append((doc, start, ids[4 * start : 4 * (start + n)], total))
            best[0] -= n
            start += n
            if not best[0]:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def take(self) -> list[list]:
        rows, self.rows, self.held = self.rows, [], 0
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in FIELDS]


def merge_leftovers(pieces: list[tuple], first_id: int, capacity: int) -> Packer:
    """String pieces together and cut: full windows, then powers of two."""
    packer = Packer(first_id, capacity)
    todo, held = sum(len(p[2]) // 4 for p in pieces), []
    size = lambda left: capacity if left >= capacity else 1 << (left.bit_length() - 1)
    room = size(todo) if todo else 0
    for doc, start, ids, total in pieces:
        while ids:
            n = min(room, len(ids) // 4)
            held.append((doc, start, ids[: 4 * n], total))
            start, ids, room, todo = start + n, ids[4 * n :], room - n, todo - n
            if not room:
                packer.emit(held)
                held, room = [], size(todo) if todo else 0
    return packer


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, windows: int = OPEN, end: int = 2) -> DataFrame:
    """Pack every document's ids and its end token; returns one row for each piece (PIECES), with its ids as
    little-endian unsigned 32-bit numbers; path: see tokenizer_file. A window is the pieces of a sequence_id in order of offset."""
    names = [n for n, _ in FIELDS]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds(path), TaskContext.get().partitionId()
        packer = Packer(part << 32, capacity, windows)

        def batch_of(columns: list[list], group: int | None) -> pa.RecordBatch:
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)] + [pa.array([group] * len(columns[0]), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "merge_group"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, words.document(text, end))
                if packer.held >= FLUSH:
                    yield batch_of(packer.take(), None)
            yield batch_of(packer.take(), None)
        left = [(p, k) for k, w in enumerate(sorted(packer.open, key=lambda w: w[0])) for p in w[1]]
        columns = [[p[0] for p, _ in left], [p[1] for p, _ in left], [len(p[2]) // 4 for p, _ in left], [p[2] for p, _ in left], [p[3] for p, _ in left], [(part << 32) + k for _, k in left], [*range(len(left))]]
        words.clear()
        yield batch_of(columns, part // MERGED)
        release()

    def second(group: pa.Table) -> pa.Table:
        d = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pydict()
        base = (1 << 62) + ((d["merge_group"][0] if d["merge_group"] else 0) << 32)
        merged = merge_leftovers([*zip(d["doc_id"], d["start"], d["ids"], d["doc_tokens"])], base, capacity)
        return pa.table(merged.take(), schema=pa.schema(FIELDS))

    placed = stored(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(first, f"{PIECES}, merge_group long"), "packing")
    whole = placed.filter(F.col("merge_group").isNull()).select(*names)
    merged = placed.filter(F.col("merge_group").isNotNull()).groupBy("merge_group").applyInArrow(second, PIECES)
    return whole.unionByName(merged)


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """The pieces of packed_pieces with the checksum of their ids instead of the ids."""
    return packed_pieces(docs, path, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
