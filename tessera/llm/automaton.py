"""Language-model scores by a weighted backoff automaton.

The model interpolates orders: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), where h' is h without its first
word, c counts training documents' tokens and k is a constant of the order; below the first order stands the
base, which adds 0.1 to each count. Written with backoff: an n-gram that was seen is an arc with its probability,
every seen history is a state, and a failure arc of weight k / (c(h) + k) leads from h to h'. All continuations
of a history sum to one, a single unknown word included.

Counts are summed in pages of hash space (ngrams.py): each block of documents sends the distinct n-grams of all
its texts once, with their counts in its training documents, and gets the corpus's counts of them back.
With these it builds the part of the automaton that its texts can reach, and traverses it once from left to
right: each lane carries a state, takes the arc of the next word or else failure arcs, and adds up logarithms.
Long texts are cut into lanes; a lane starts `order - 1` tokens early to be in its state, as a state has no
longer memory.

Words' hashes have 64 bits. Those of longer n-grams have 24 bits more than the logarithm of the text's bytes (64
at most), so that at every size less than one lookup in 16 million meets a foreign n-gram.

Cases: null and empty texts are the end token alone; a null doc_id has no text, and crc32 of nothing is 0: it is
held out; repeated rows count and score each; without training documents the base is even; extra columns are
ignored; a very long text is one block of many lanes; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cleared, release, spread, stored, text_bytes
from tessera.llm.ngrams import PAGE, Block, Level, blocks_of, get_counts, hashes_of, levels_of, opened, page_of, page_start, put_counts, replies_of, sending, word_hashes

SPACE = b" \t\n\x0b\x0c\r"
#: Every document whose crc32(doc_id as text) is divisible by FOLDS is held out.
FOLDS = 10
ORDER, ADDED = 3, 0.1
#: The weight of the lower order in tokens, by the n-gram's length from 2 on.
LOWER_WEIGHT = (2000.0, 20.0)
#: Tokens of a lane.
LANE = 512
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def with_ends(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, whether the next is of the same text, tokens of each text); the end token follows the last word's number."""
    ends = np.cumsum(block.counts)
    ids = np.insert(block.ids, ends, len(block.words))
    sizes = block.counts + 1
    joined = np.ones(len(ids), bool)
    joined[np.cumsum(sizes) - 1] = False
    return ids, joined, sizes


class Automaton:
    """States are (length, n-gram) pairs, (0, 0) the start. counts: the corpus's, of each level's n-grams."""

    def __init__(self, levels: list[Level], counts: list[np.ndarray], end: int, tokens: int, types: int, weights: tuple[float, ...] = LOWER_WEIGHT):
        self.levels, self.end = levels, end
        p = (counts[0] + ADDED) / (tokens + ADDED * (types + 1))
        self.base, self.known = np.log10(p), counts[0] > 0
        self.keys, self.logp, self.next, self.fail = [np.zeros(0, "i8")], [self.base], [], [np.zeros(0)]
        for k in range(1, len(levels)):
            level, weight = levels[k], weights[k - 1]
            history = counts[k - 1][level.before]
            p = (counts[k] + weight * p[level.after]) / (history + weight)
            seen = counts[k] > 0
            self.keys.append(level.keys[seen])
            self.logp.append(np.log10(p[seen]))
            self.next.append(np.flatnonzero(seen) if k < len(levels) - 1 else level.after[seen])
            self.fail.append(np.log10(weight / (counts[k - 1] + weight)))

    def step(self, length: np.ndarray, gram: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Moves all lanes over their next words, in place; the logarithms of the arcs taken."""
        top, size = len(self.levels) - 1, self.levels[0].size
        out, todo = np.zeros(len(word)), np.ones(len(word), bool)
        for k in range(top, 0, -1):
            at = np.flatnonzero(todo & (length == k))
            if not len(at):
                continue
            keys = self.keys[k]
            key = gram[at] * size + word[at]
            place = np.searchsorted(keys, key)
            hit = np.zeros(len(at), bool)
            inside = place < len(keys)
            hit[inside] = keys[place[inside]] == key[inside]
            took, place = at[hit], place[hit]
            out[took] += self.logp[k][place]
            gram[took], length[took], todo[took] = self.next[k - 1][place], min(k + 1, top), False
            failed = at[~hit]
            out[failed] += self.fail[k][gram[failed]]
            gram[failed], length[failed] = (self.levels[k - 1].after[gram[failed]] if k > 1 else 0), k - 1
        at = np.flatnonzero(todo)
        out[at] += self.base[word[at]]
        state = self.known[word[at]] & (word[at] != self.end) & (top > 0)
        length[at], gram[at] = state, np.where(state, word[at], 0)
        return out

    def scores(self, ids: np.ndarray, sizes: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The logarithm of each text's probability."""
        before = len(self.levels) - 1
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // lane)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        scored = starts[text] + nth * lane
        ends = np.minimum(scored + lane, starts[text] + sizes[text])
        begin = np.maximum(scored - before, starts[text])
        order = np.argsort(begin - ends, kind="stable")  # longest first
        begin, scored, ends = begin[order], scored[order], ends[order]
        total, length, gram = np.zeros(len(text)), np.zeros(len(text), "i8"), np.zeros(len(text), "i8")
        lengths = ends - begin
        for t in range(int(lengths.max()) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, "left"))
            at = begin[:n] + t
            total[:n] += np.where(at >= scored[:n], self.step(length[:n], gram[:n], ids[at]), 0.0)
        own = np.zeros(len(text))
        own[order] = total
        return np.bincount(text, own, len(sizes))


def _levels(block: Block, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Level], list[np.ndarray]]:
    """(tokens, joined, sizes, n-grams, their hashes; those of several words with their first `bits` bits only)."""
    ids, joined, sizes = with_ends(block)
    levels = levels_of(np.zeros(1, "i8"), ids, joined, len(block.words) + 1, order)
    words = np.append(word_hashes(block.words), np.uint64(1))
    hashes = hashes_of(levels, np.zeros(1, "u8"), words)
    cut = np.uint64(64 - bits)
    return ids, joined, sizes, levels, [h if not k else (h >> cut) << cut for k, h in enumerate(hashes)]


@cleared
def score_documents(docs: DataFrame, order: int = ORDER, weights: tuple[float, ...] = LOWER_WEIGHT, page_bytes: int = PAGE, lane: int = LANE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; documents that aren't
    held out train the model."""
    total = text_bytes(docs)
    pages, bits = max(1, math.ceil(total / page_bytes)), min(64, math.ceil(math.log2(total + 2)) + 24)
    blocks = stored(blocks_of(docs, [F.col("doc_id").cast("long")], F.col("text"), SPACE), "automaton-blocks")

    def shift_of(k: int) -> np.uint64:
        """How far an order's values are shifted: only their first bits travel."""
        return np.uint64(64 - bits if k else 0)

    def ask(block: Block) -> Iterator[tuple]:
        ids, _, sizes, levels, hashes = _levels(block, order, bits)
        train = np.repeat(np.array([not held_out(a[0]) for a in block.about], bool), sizes)
        for k, (level, own) in enumerate(zip(levels, hashes)):
            sort = np.argsort(own, kind="stable")
            shift = shift_of(k)
            yield k * pages, page_of(own[sort], pages), own[sort] >> shift, level.counts(train)[sort], lambda page, s=shift: page_start(page, pages) >> int(s)

    def add(table: pa.Table) -> pa.Table:
        k, page = divmod(table.column("page")[0].as_py(), pages)
        lists = [opened(p, page_start(page, pages) >> int(shift_of(k))) for p in table.column("packed").to_pylist()]
        every, of = np.unique(np.concatenate([v for v, _ in lists]), return_inverse=True)
        sums = np.bincount(of, np.concatenate([n for _, n in lists]), len(every)).astype("i8")
        ends = np.cumsum([len(v) for v, _ in lists])
        answers = [put_counts(sums[of[e - len(v) : e]]) for e, (v, _) in zip(ends, lists)]
        once = np.zeros(len(lists), "i8")
        types, tokens = once.copy(), once
        types[0], tokens[0] = (sums > 0).sum(), sums.sum()
        out = pa.table({"block": table.column("block"), "page": table.column("page"), "n": pa.array([len(v) for v, _ in lists]), "packed": pa.array(answers, pa.binary()), "types": types, "tokens": tokens})
        del every, of, lists
        release()
        return out

    sent = blocks.mapInArrow(sending(ask), "page long, block long, packed binary")
    answers = stored(spread(sent, "page").groupBy("page").applyInArrow(add, "block long, page long, n long, packed binary, types long, tokens long"), "automaton-counts")
    sums = answers.filter(F.col("page") < pages).agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = int(sums[0]), int(sums[1])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        back = sorted(zip(right.column("page").to_pylist(), right.column("n").to_pylist(), right.column("packed").to_pylist()))
        for packed in left.column("packed").to_pylist():
            block = Block.unpacked(packed)
            ids, _, sizes, levels, hashes = _levels(block, order, bits)
            counts = []
            for k, own in enumerate(hashes):
                got = [get_counts(data, n) for page, n, data in back if page // pages == k]
                counts.append(np.zeros(len(own), "i8"))
                counts[-1][np.argsort(own, kind="stable")] = np.concatenate([*got, np.zeros(0, "i8")])
            machine = Automaton(levels, counts, len(block.words), tokens, types, weights)
            text = np.repeat(np.arange(len(sizes)), sizes)
            base, known = np.bincount(text, machine.base[ids], len(sizes)), np.bincount(text, machine.known[ids], len(sizes)).astype("i8")
            doc = [a[0] for a in block.about]
            parts.append(pa.table({"doc_id": pa.array(doc, pa.int64()), "held_out": pa.array([held_out(d) for d in doc], pa.bool_()), "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), tokens), "base_score": base, "score": machine.scores(ids, sizes, lane)}))
            del levels, hashes, counts, machine
        release()
        return pa.concat_tables(parts) if parts else _NONE

    return spread(blocks, "block").groupBy("block").cogroup(spread(answers.drop("types", "tokens"), "block").groupBy("block")).applyInArrow(score, SCHEMA)


_NONE = pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
