"""Vector code compression: product codes in whole numbers, nearest entries by annular norm pruning.

Each component x becomes floor(scale * x), and vectors are cut into equal consecutive parts. The codebook of each
part starts as that part of the vectors of smallest ids; each round assigns every part to its nearest entry and
replaces each entry by its parts' mean, rounded down (an unused one stays). Tasks sum parts and counts of each
entry first; only these sums, parts x entries rows a task, are shuffled, and the codebooks travel to the tasks (a
few thousand numbers, whatever the table's size).

Nearest entries: the entries are sorted by norm. The one nearest in norm gives a first distance d; by the
triangle inequality only entries whose norm lies within d of the part's own can be as near. A binary search
finds this annulus, both ends included (widened by more than the rounding error of the norms), and all of its
entries are evaluated in whole numbers; ties go to the lower index. So results are exact.

Cases: rows whose vector is null or holds a null or non-finite component are dropped; a width that `parts` doesn't
divide, or vectors of several widths, are filled up with zeros at the end, to the widest; fewer kept ids than
entries make a smaller codebook; of rows with one id the smallest vector starts the codebook, and all are encoded;
a null id starts one only after all others; components so large that sums of squares could leave 64 bits count as
the largest that can't (2^29 for parts of 4); extra columns, whatever their names, are kept by encode; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cleared, free_names, spread, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances that one step evaluates at most.
STEP = 1 << 18


def usable(vector: Column) -> Column:
    """Whether there is a vector of finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))


def limit_of(width: int) -> int:
    """The largest component for which width * (2 * component)^2 stays below 2^62."""
    return 1 << ((60 - max(0, (width - 1).bit_length())) // 2)


def whole_numbers(vectors: list | np.ndarray, parts: int, width: int, scale: int) -> np.ndarray:
    """(vectors, parts, width) whole numbers."""
    out = np.zeros((len(vectors), parts * width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    limit = limit_of(width)
    return np.clip(np.floor(out * scale), -limit, limit).astype("i8").reshape(len(vectors), parts, width)


def column_numbers(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """The same of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == parts * width).all():
        limit = limit_of(width)
        return np.clip(np.floor(flat * scale), -limit, limit).astype("i8").reshape(len(column), parts, width)
    return whole_numbers(np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else [], parts, width, scale)


def nearest(points: np.ndarray, entries: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry; of equally near ones the first."""
    norms = np.sqrt((entries.astype("f8") ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    norms, entries_ = norms[order], entries[order]
    index, distance = np.zeros(len(points), "i8"), np.zeros(len(points), "i8")
    rows = max(1, step // len(entries))
    for a in range(0, len(points), rows):
        own = points[a : a + rows]
        norm = np.sqrt((own.astype("f8") ** 2).sum(1))
        right = np.searchsorted(norms, norm).clip(0, len(norms) - 1)
        left = np.maximum(right - 1, 0)
        close = np.where(np.abs(norms[left] - norm) <= np.abs(norms[right] - norm), left, right)
        reach = np.sqrt(((own - entries_[close]) ** 2).sum(1).astype("f8"))
        slack = 1e-9 * (norm + reach) + 1e-9
        low, high = np.searchsorted(norms, norm - reach - slack, "left"), np.searchsorted(norms, norm + reach + slack, "right")
        count = high - low  # at least one: the entry that gave the distance
        firsts = np.cumsum(count) - count
        point = np.repeat(np.arange(len(own)), count)
        entry = np.arange(len(point)) - np.repeat(firsts - low, count)
        away = ((own[point] - entries_[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(away, firsts)
        place = np.where(away == least[point], order[entry], len(entries))
        index[a : a + rows], distance[a : a + rows] = np.minimum.reduceat(place, firsts), least
    return index, distance


class Codebooks:
    """entries: (parts, entries, width) whole numbers."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of vectors, part by part."""
        own = [nearest(numbers[:, p], e) for p, e in enumerate(self.entries)]
        return np.stack([i for i, _ in own], 1), np.stack([d for _, d in own], 1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for (the middle of each component's step)."""
        return ((np.stack([e[codes[:, p]] for p, e in enumerate(self.entries)], 1) + 0.5) / self.scale).reshape(len(codes), -1)


def fit_codebooks(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of all usable vectors of df."""
    spark = df.sparkSession
    kept = df.filter(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    longest = kept.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    width = -(-int(longest) // parts)
    ids = [r.key for r in kept.select("key").distinct().orderBy(F.asc_nulls_last("key")).limit(entries).collect()]
    first = F.col("key").isin([i for i in ids if i is not None]) | (F.col("key").isNull() if None in ids else F.lit(False))
    seeds = kept.filter(first).groupBy("key").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("key")).collect()
    book = Codebooks(whole_numbers([r.vector for r in seeds], parts, width, scale).transpose(1, 0, 2), scale)
    if not seeds or not width:
        return book
    names = [f"x{k}" for k in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = book.entries.shape[1]
        counts, total = np.zeros(parts * n, "i8"), np.zeros((parts * n, width), "i8")
        for batch in batches:
            numbers = column_numbers(batch.column(0), parts, width, scale)
            codes, _ = book.assigned(numbers)
            at = (codes + np.arange(parts) * n).ravel()
            counts += np.bincount(at, minlength=parts * n)
            order = np.argsort(at, kind="stable")
            used, starts = np.unique(at[order], return_index=True)
            if len(used):
                total[used] += np.add.reduceat(numbers.reshape(-1, width)[order], starts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(total[used, k]) for k in range(width))], ["entry", "n", *names])

    for _ in range(rounds):
        rows = spread(kept.select("vector")).mapInArrow(sums, ", ".join(f"{n} long" for n in ("entry", "n", *names))).groupBy("entry").agg(*(F.sum(n).alias(n) for n in ("n", *names)))
        new = book.entries.reshape(-1, width).copy()
        for r in rows.collect():  # parts x entries rows
            new[r.entry] = np.array([r[n] for n in names], "i8") // r.n
        book = Codebooks(new.reshape(book.entries.shape), scale)
    return book


def encode(df: DataFrame, book: Codebooks, vector: str = "embedding") -> DataFrame:
    """The usable rows of df with their codes (array of int) and error (squared distance over all parts); all columns stay."""
    codes_, error_ = free_names(df, "codes", "error")
    kept = df.filter(usable(F.col(vector)))
    parts, _, width = book.entries.shape
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, away = book.assigned(column_numbers(batch.column(at), parts, width, book.scale))
            most = np.iinfo("i8").max
            error = [min(most, e) for e in away.astype(object).sum(1).tolist()] if away.max(initial=0) > most // parts else away.sum(1).tolist()
            listed = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype="i4"), pa.array(codes.ravel().astype("i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(error, pa.int64())], [*batch.schema.names, codes_, error_])

    schema = T.StructType([*df.schema.fields, T.StructField(codes_, T.ArrayType(T.IntegerType())), T.StructField(error_, T.LongType())])
    return spread(kept).mapInArrow(run, schema)


@cleared
def compress_vectors(df: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels) and codebooks_sha256."""
    book = fit_codebooks(df, **options)
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int")
    own = stored(encode(df.select("vec_id", "embedding", label.alias("label")), book).select("vec_id", "label", F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))).alias("code"), "error"), "codes")
    totals = own.groupBy(F.col("label").alias("own_label")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit((1 << 63) - 1).cast("decimal(29,0)")).cast("long").alias("label_error"))
    return own.join(totals, F.col("label").eqNullSafe(F.col("own_label"))).select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


SQL = """WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS v FROM kept, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
$rounds
n AS (SELECT vec_id, p, min((d, e)) AS best FROM (SELECT part.vec_id, part.p, b2.e, list_sum(list_transform(list_zip(part.v, b2.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN b2 USING (p)) GROUP BY ALL),
code AS (SELECT vec_id, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM n GROUP BY ALL),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), sha"""
_ROUND = """a$to AS (SELECT vec_id, p, min((d, e))[2] AS e FROM (SELECT part.vec_id, part.p, b.e, list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN b$from b USING (p)) GROUP BY ALL),
m$to AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT a.p, a.e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM part JOIN a$to a USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL),
b$to AS (SELECT p, e, coalesce(m.v, b.v) AS v FROM b$from b LEFT JOIN m$to m USING (p, e)),"""
SQL = SQL.replace("$rounds", "\n".join(_ROUND.replace("$to", str(k + 1)).replace("$from", str(k)) for k in range(ROUNDS)))
