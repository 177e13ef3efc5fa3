"""BPE encoding and decoding by tree concatenation.

A text is cut where no pre-token can cross (before a lone space or around a lone newline), and each
unit is encoded on its own. A long pre-token is a tree: its leaves are encoded on their own, and two
neighbours are joined by re-encoding a window of tokens around the seam, doubled until its first token
equals the left side's and its last token the right side's (or it reaches the end of that side). A BPE
sequence is the encoding of its bytes exactly when each adjacent pair of tokens is, so sides that agree
on a shared token at both ends of the window splice to the exact encoding of the whole.

Cases: null text counts as empty (no tokens); an empty text has the empty id list; repeated rows give
repeated results; extra input columns are dropped; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tokenizer_file

LEAF = 512
CACHE = 300_000
_ODD = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBpe:
    """Byte-level BPE of a tokenizers file; exact on texts of any length."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        path = tokenizer_file(path)
        self.tok, self.leaf = Tokenizer.from_file(path), leaf
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.raw = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.marks = [""] * len(self.raw)
        for text, i in vocab.items():
            if text not in self.special:
                self.raw[i], self.marks[i] = bytes(back[c] for c in text), text
        for text, i in self.special.items():
            self.raw[i] = text.encode()
        self.first, self.later = _Cache(self, ""), _Cache(self, " ")
        self.newline = self.first["\n"]

    def _model(self, marks: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(marks)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes together."""
        if not left or not right:
            return left or right
        k = 2
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self._model("".join(self.marks[i] for i in left[-a:] + right[:b]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    def pretoken(self, marks: str) -> list[int]:
        """The encoding of one pre-token, written in stand-in characters."""
        parts = [self._model(marks[i : i + self.leaf]) for i in range(0, len(marks), self.leaf)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def unit(self, text: str) -> list[int]:
        """The encoding of text without special tokens in it."""
        if len(text) <= self.leaf:
            return self.tok.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for marks, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            ids += self.pretoken(marks)
        return ids

    def _entries(self, text: str) -> list[tuple[str, bytes]]:
        if _ODD.search(text):
            cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
            return [self.first[text[a:b]] for a, b in zip(cuts, cuts[1:]) if b > a]
        out: list[tuple[str, bytes]] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.newline)
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += map(self.later.__getitem__, rest)
        return out

    def entries(self, text: str) -> list[tuple[str, bytes]]:
        """(decimal ids joined by commas, bytes that they decode to) of consecutive units of text."""
        if not text:
            return []
        found = [s for s in self.special if s in text]
        if not found:
            return self._entries(text)
        out: list[tuple[str, bytes]] = []
        for part in re.split("(" + "|".join(map(re.escape, found)) + ")", text):
            if part in self.special:
                out.append((str(self.special[part]), self.raw[self.special[part]]))
            elif part:
                out += self._entries(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.entries(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


class _Cache(dict):
    """Entries of units by their text; emptied when full, as it only saves time."""

    def __init__(self, bpe: TreeBpe, before: str):
        super().__init__()
        self.bpe, self.before = bpe, before

    def __missing__(self, text: str) -> tuple[str, bytes]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.bpe.unit(self.before + text)
        entry = (",".join(map(str, ids)), b"".join(map(self.bpe.raw.__getitem__, ids)))
        if len(text) <= 64:
            self[text] = entry
        return entry


#: Encoded texts leave a task in batches of about so many characters.
FLUSH = 1 << 24


def _encoded(docs: DataFrame, path: str, leaf: int) -> DataFrame:
    """doc_id, the decimal ids joined by commas, and the text that they decode to."""
    names = ["doc_id", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(path, leaf)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows)] if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string()))], names)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = bpe.entries(text or "")
                rows.append((doc, ",".join([e[0] for e in entries]), b"".join([e[1] for e in entries]).decode("utf-8", "replace")))
                held += len(rows[-1][1]) + len(rows[-1][2])
                if held >= FLUSH:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids string, decoded string")


def encoded_texts(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids and the text that they decode to, with a tokenizer file (see tokenizer_file)."""
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return _encoded(docs, path, leaf).select("doc_id", ids.alias("ids"), "decoded")


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Encode and decode each text with a tokenizer file (see tokenizer_file).

    Returns doc_id, n_tokens, the digest of the decimal ids and that of the decoded text.
    """
    commas = F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit("")))
    n = F.when(F.col("ids") == "", F.lit(0)).otherwise(commas + 1).cast("long")
    return _encoded(docs, path, leaf).select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
