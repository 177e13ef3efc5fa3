"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's units are the bytes of UTF-8 text (each document framed by start marks), its order is 5, and
its counts come from every trusted document but the fifth that is held out for the thresholds. Count tables are sharded by n-gram; those below the highest
order hold continuation counts. Documents are packed into blocks; the distinct n-grams of all blocks are
joined with the counts, order by order, and each block gets the probabilities of its own n-grams back and
sums them over its documents. A document is rejected where its perplexity exceeds its language's
threshold: a quantile of the held-out trusted documents' perplexities in that language, times a margin.
Languages with too few of these (20) use the quantile over all, and an order
whose counts of counts of 1 to 4 aren't all there uses fixed discounts (0.5, 0.75 and 0.9). A short document's mean is drawn towards the
language's middle by a fixed number of bytes, as few bytes say little.

Rows travel through the blocks with their doc_id and language, so each has its own score whatever its id. The
threshold is compared with the drawn perplexity; the model's own is returned beside it.

Cases: a null or empty text has no perplexity and is rejected; without held-out trusted documents nothing else
is rejected; a null language is one of its own; a null doc_id is never trusted, and its row is scored like others;
a document labelled twice is trusted if any label says so; extra columns, whatever their names, are kept by
good_documents; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cleared, free_names, release, spread, stored

ORDER, BLOCK, RUN = 5, 16 << 20, 1 << 20
#: Trusted ids are broadcast up to so many (16 bytes each), and shuffled beyond.
BROADCAST_IDS = 1_000_000
QUANTILE, MARGIN, LEAST_TRUSTED, PRIOR_BYTES = 0.99, 1.2, 20, 100
#: One trusted document in so many is held out of the counts, and sets the thresholds.
HELD_OUT = 5


def grams_of(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte of the texts, as an integer of `order` bytes."""
    frame = bytes(order - 1)
    data = np.frombuffer(frame + frame.join(texts), "u1")
    own = np.ones(len(data), bool)
    at = 0
    for t in texts:
        own[at : at + order - 1] = False
        at += order - 1 + len(t)
    out = np.zeros(len(data), "i8")
    for k in range(order):
        out[k:] |= data[: len(data) - k].astype("i8") << (8 * k)
    return out[own]


class Counter:
    """Sorted distinct n-grams and their counts, from runs of text."""

    def __init__(self):
        self.grams, self.counts, self.held = np.zeros(0, "i8"), np.zeros(0, "i8"), []

    def add(self, grams: np.ndarray) -> None:
        grams = np.sort(grams)
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, "i8")
        self.held.append((grams[at], np.diff(np.concatenate([at, [len(grams)]]))))
        if sum(len(g) for g, _ in self.held) > max(500_000, len(self.grams)):
            self.merge()

    def merge(self) -> None:
        grams = np.concatenate([self.grams, *(g for g, _ in self.held)])
        counts = np.concatenate([self.counts, *(c for _, c in self.held)])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, "i8")
        self.grams, self.counts, self.held = grams[at], np.add.reduceat(counts, at) if len(at) else counts, []


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def _pack(about: list[tuple], texts: list[bytes], grams: np.ndarray) -> bytes:
    import zstandard

    gaps = np.diff(grams, prepend=0)
    parts = [json.dumps(about).encode(), np.array([len(t) for t in texts], "<i8").tobytes(), gaps.astype("<i8").tobytes(), b"".join(texts)]
    parts = [zstandard.ZstdCompressor(level=3).compress(p) for p in parts]
    return struct.pack("<4q", *map(len, parts)) + b"".join(parts)


def _unpack(packed: bytes, which: int) -> bytes:
    import zstandard

    sizes = struct.unpack("<4q", packed[:32])
    begin = 32 + sum(sizes[:which])
    return zstandard.ZstdDecompressor().decompress(packed[begin : begin + sizes[which]])


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def held_out(ids: DataFrame, yes: bool) -> DataFrame:
    own = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    return ids.filter(own if yes else ~own)


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all rows of a text column; tasks count first, then the counts are summed by n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for run in _runs([t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist() if t]):
                counter.add(grams_of(run, order))
        counter.merge()
        for i in range(0, len(counter.grams), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(counter.grams[i : i + (1 << 16)]), pa.array(counter.counts[i : i + (1 << 16)])], ["gram", "n"])
        del counter
        release()

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the counts of counts."""
    n = counts.agg(*(F.count_if(F.col("n") == k) for k in range(1, 5))).first()
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    own = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(own))


def probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) for each asked n-gram: at every order, counts and context sums are joined by n-gram shard."""
    tables, wanted = {order: counts}, {order: asked}
    for k in range(order - 1, 0, -1):
        mask = F.lit((1 << (8 * k)) - 1)
        tables[k] = stored(tables[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n")), "continuations")
        wanted[k] = wanted[k + 1].select(F.col("gram").bitwiseAND(mask).alias("gram")).distinct()
    below = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(tables[k])
        n, own = F.col("n"), F.shiftright("gram", 8)
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        sums = tables[k].groupBy(own.alias("context")).agg(F.sum("n").cast("double").alias("total"), (d1 * F.count_if(n == 1) + d2 * F.count_if(n == 2) + d3 * F.count_if(n > 2)).alias("held"))
        rows = wanted[k].join(tables[k], "gram", "left").withColumn("context", own).join(sums, "context", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(F.coalesce(F.greatest(n - cut, F.lit(0.0)), F.lit(0.0)) / F.col("total") + F.col("held") / F.col("total") * F.col("lower"))
        below = rows.select("gram", p.alias("p"))
        if k < order:
            below = stored(below, "probabilities")
    return below


def score_documents(docs: DataFrame, trusted: DataFrame, order: int = ORDER, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, lang, version, n_bytes, nll) of every row: the natural logarithm of its probability, negated;
    version is a hash of its text."""
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"), F.xxhash64("text").alias("version"))
    counts = stored(ngram_counts(texts.join(ids, "doc_id", "left_semi"), order), "ngrams")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs_, texts_, size, counter = [], [], 0, Counter()

        def block() -> pa.RecordBatch:
            counter.merge()
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + number]), pa.array([_pack(docs_, texts_, counter.grams)], pa.binary())], ["block", "packed"])

        for batch in batches:
            own = [*zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))]
            new = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            at = 0
            for run in _runs(new):
                docs_ += own[at : at + len(run)]
                texts_ += run
                at += len(run)
                size += sum(map(len, run))
                counter.add(grams_of(run, order))
                if size >= block_bytes:
                    yield block()
                    number += 1
                    docs_, texts_, size, counter = [], [], 0, Counter()
        if docs_:
            yield block()
        release()

    blocks = spread(texts.mapInArrow(pack, "block long, packed binary"), "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = np.cumsum(np.frombuffer(_unpack(packed, 2), "<i8"))
                for i in range(0, len(grams), 1 << 16):
                    own = grams[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["block", "gram"])

    asked = stored(blocks.mapInArrow(ask, "block long, gram long"), "asked")
    answers = probabilities(asked.select("gram").distinct(), counts, order)
    replies = asked.join(answers, "gram").select("block", "gram", F.log("p").cast("float").alias("logp"))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            index, logp = pd.Index(right.column("gram").to_numpy()), right.column("logp").to_numpy()
            for packed in left.column("packed").to_pylist():
                own = json.loads(_unpack(packed, 0))
                sizes = np.frombuffer(_unpack(packed, 1), "<i8")
                data, at, docs_at = _unpack(packed, 3), 0, 0
                texts_ = []
                for n in sizes.tolist():
                    texts_.append(data[at : at + n])
                    at += n
                for run in _runs(texts_):
                    lengths = np.array([len(t) for t in run])
                    got = np.concatenate([[0.0], np.cumsum(logp[index.get_indexer(grams_of(run, order))].astype("f8"))])
                    ends = np.cumsum(lengths)
                    out += [(*about, n, x) for about, n, x in zip(own[docs_at : docs_at + len(run)], lengths.tolist(), (got[ends - lengths] - got[ends]).tolist())]
                    docs_at += len(run)
            del index, logp
            release()
        columns = [*zip(*out)] if out else [()] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "lang", "version", "n_bytes", "nll"), columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))})

    return blocks.groupBy("block").cogroup(spread(replies, "block").groupBy("block")).applyInArrow(score, "doc_id long, lang string, version long, n_bytes long, nll double")


def _few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast where it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


@cleared
def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, least_trusted: int = LEAST_TRUSTED, prior: float = PRIOR_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (of a byte, the model's), drawn (the same drawn towards the language's
    middle), threshold (for drawn), kept, and version (a hash of the text) for every row."""
    trusted = trusted_ids(labels)
    scores = stored(score_documents(docs, held_out(trusted, False), order), "scores")
    about = scores.withColumn("lang", F.coalesce("lang", F.lit("")))
    mean = F.col("nll") / F.col("n_bytes")
    known = stored(about.filter("n_bytes > 0").join(_few(held_out(trusted, True)), "doc_id", "left_semi").select("lang", "nll", "n_bytes", mean.alias("mean")), "held-out")
    middle = lambda g: g.agg(F.percentile_approx("mean", 0.5, 10_000).alias("middle"), F.count("*").alias("n"))
    each, all_ = middle(known.groupBy("lang")).filter(F.col("n") >= least_trusted), middle(known).first()
    drawn = lambda m: (F.col("nll") + prior * m) / (F.col("n_bytes") + prior)
    top = known.join(each.select("lang", "middle"), "lang").withColumn("drawn", drawn(F.col("middle"))).groupBy("lang").agg(F.percentile_approx("drawn", quantile, 10_000).alias("top"))
    overall = known.agg(F.percentile_approx(drawn(F.lit(all_["middle"]).cast("double")), quantile, 10_000)).first()[0]
    limits = stored(each.select("lang", "middle").join(top, "lang"), "limits")
    own = about.join(_few(limits), "lang", "left")
    own = own.withColumn("middle", F.coalesce("middle", F.lit(all_["middle"]).cast("double"))).withColumn("top", F.coalesce("top", F.lit(overall).cast("double")))
    limit = F.exp(F.col("top")) * margin
    value = F.when(F.col("n_bytes") > 0, F.exp(drawn(F.coalesce("middle", mean))))
    raw = F.when(F.col("n_bytes") > 0, F.exp(mean))
    kept = F.when(F.col("n_bytes") > 0, F.coalesce(value <= limit, F.lit(True))).otherwise(F.lit(False))
    return own.select("doc_id", "lang", "n_bytes", raw.alias("perplexity"), value.alias("drawn"), limit.alias("threshold"), kept.alias("kept"), "version")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected; all columns stay."""
    gone, version = free_names(docs, "gone", "version")
    bad = classify(docs, labels, **options).filter("NOT kept").select(F.col("doc_id").alias(gone), F.col("version").alias(version)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.xxhash64("text") == F.col(version)), "left_anti")


__all__ = ["classify", "good_documents"]
