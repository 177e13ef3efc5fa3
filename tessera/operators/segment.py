"""Words of Han text by a dictionary: the best path through the graph of all words.

A dictionary is a table of words and frequencies. Where it is small it goes to every task as a prefix trie; a larger one
stays a table, and each task gets the words that occur in its texts by a join on substrings. Either way a run of
Han characters is cut where the product of its words' probabilities is largest; of equally good cuts the one with
the longer first word counts. A character that starts no word is a word of its own, of frequency one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and characters of a dictionary that goes to every task.
SMALL_WORDS, SMALL_CHARS = 500_000, 4_000_000
_PARTS = re.compile(r"[\u4e00-\u9fff]+|[a-z0-9]+(?:\.[0-9]+)?%?|[^\W_a-z0-9\u4e00-\u9fff]+")
END = ""


def trie_of(words: dict[str, int]) -> dict:
    """Nested dictionaries by character; a word's end holds its frequency under END."""
    root: dict = {}
    for word, n in words.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[END] = n
    return root


def best_path(run: str, found: Callable[[int], list[tuple[int, int]]], total: float) -> list[str]:
    """A run's words. found(i): (length, frequency) of the words that start at i."""
    n, log_total = len(run), math.log(max(total, 1.0))
    score, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        ways = found(i)
        if not any(length == 1 for length, _ in ways):
            ways = [*ways, (1, 1)]
        score[i], step[i] = max((math.log(max(f, 1)) - log_total + score[i + length], length) for length, f in ways)
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def in_trie(run: str, trie: dict) -> Callable[[int], list[tuple[int, int]]]:
    def found(i: int) -> list[tuple[int, int]]:
        node, out = trie, []
        for j in range(i, len(run)):
            node = node.get(run[j])
            if node is None:
                break
            if END in node:
                out.append((j + 1 - i, node[END]))
        return out

    return found


def words_of(text: str | None, trie: dict, total: float) -> list[str]:
    """The words of a text in lower case: Han runs by the dictionary, numbers and runs of other letters whole."""
    out: list[str] = []
    for part in _PARTS.findall((text or "").lower()):
        out += best_path(part, in_trie(part, trie), total) if "\u4e00" <= part[0] <= "\u9fff" else [part]
    return out


def segmented(df: DataFrame, text: str, dictionary: DataFrame, word: str = "word", freq: str = "freq", out: str = "words") -> DataFrame:
    """df with its texts' words. Of a word's several rows the frequencies add up; empty words are ignored. A null text
    has no words."""
    known = dictionary.filter(F.col(word) != "").groupBy(F.lower(word).alias("word")).agg(F.sum(freq).cast("long").alias("freq"))
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.sum("freq"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
    total, longest = float(size[2]), int(size[3])
    fields, at = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), df.columns.index(text)
    if size[0] <= SMALL_WORDS and size[1] <= SMALL_CHARS:
        held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trie_of({r.word: r.freq for r in known.collect()})))  # of checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = cloudpickle.loads(held.value)
            for batch in batches:
                found = [words_of(t, trie, total) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, out])

        return df.mapInArrow(run, f"{fields}, `{out}` array<string>")
    return _segmented_by_join(df, text, known, total, longest, out, fields)


def _segmented_by_join(df: DataFrame, text: str, known: DataFrame, total: float, longest: int, out: str, fields: str) -> DataFrame:
    """The same for a dictionary of any size: the distinct substrings of Han runs are joined with it, text by text."""
    texts = df.select(F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    starts = texts.select("t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\u4e00-\u9fff]+"), F.lit(0)))).alias("run"))
    places = starts.select("t", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    subs = places.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1)), lambda n: F.substring(F.col("run"), F.col("i"), n))).alias("word")).distinct()
    own = subs.join(known, "word").groupBy("t").agg(F.collect_list(F.struct("word", "freq")).alias("known_"))  # a text's own words
    joined = df.join(own, F.col(text) == F.col("t"), "left").drop("t")
    at, last = df.columns.index(text), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t, trie_of({w["word"]: w["freq"] for w in k or []}), total) for t, k in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:last], out])

    return joined.mapInArrow(run, f"{fields}, `{out}` array<string>")
