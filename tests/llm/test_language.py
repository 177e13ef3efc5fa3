"""Codes, phrases and the automaton against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import automaton, codes, ngrams, phrases


# Codes


def brute_codes(rows, entries=64, rounds=2, parts=16):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in whole:
        first[i] = min(first.get(i, v), v)
    ids = sorted(i for i in first if i is not None)[:entries]
    ids += [None] if None in first and len(ids) < entries else []
    book = [[cut(first[i], p) for i in ids] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        held = [[[] for _ in ids] for _ in range(parts)]
        for _, v, _ in whole:
            for p in range(parts):
                held[p][near(v, p)[1]].append(cut(v, p))
        book = [[[sum(x) // len(own) for x in zip(*own)] if own else book[p][k] for k, own in enumerate(held[p])] for p in range(parts)]
    out = []
    for i, v, label in whole:
        own = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in own), sum(d for d, _ in own), label))
    totals = Counter()
    for _, _, e, label in out:
        totals[label] += e
    sha = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, totals[label], sha) for i, c, e, label in out)


@pytest.mark.parametrize("n", [3, 300])
def test_codes(spark, n):
    rnd = random.Random(n)
    vec = lambda w=32: [rnd.choice([rnd.uniform(-1, 1), 0.5, -0.25]) for _ in range(w)]
    rows = [(i, vec(), rnd.choice([1, 2, None])) for i in range(n)]
    rows += [(2, vec(), 1), (2, rows[2][1], 1), (-5, [0.0] * 32, 2), (7000, None, 1), (7001, [None] + vec(31), 1), (7002, [math.nan] + vec(31), 1), (7003, [math.inf] + vec(31), 2), (None, vec(), 2), (7004, vec(5), None), (7005, [], 1), (7006, vec(30), 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, error int").repartition(3)
    got = codes.compress_vectors(df).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert codes.compress_vectors(df).collect() == [] and codes.compress_vectors(df.limit(0)).collect() == []


def test_nearest_is_exact_and_prunes(monkeypatch):
    rng = np.random.default_rng(2)
    for width, high in ((1, 3), (4, 5), (4, 300), (8, 1 << 27)):
        points, entries = rng.integers(-high, high, (500, width)), rng.integers(-high, high, (40, width))
        index, distance = codes.nearest(points, entries, 1000)
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (index == every.argmin(1)).all()
    points = rng.integers(-1000, 1000, (1000, 4)) * rng.integers(1, 50, (1000, 1))
    seen, real = [], np.repeat
    monkeypatch.setattr(codes.np, "repeat", lambda a, n: seen.append(int(np.sum(n))) or real(a, n))
    codes.nearest(points, points[:64])
    assert sum(seen) < 2 * 64 * 1000 * 0.75  # each evaluation is told twice


def test_very_large_components(spark):
    df = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1), (3, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert [(r.code, r.error) for r in codes.compress_vectors(df).orderBy("vec_id").collect()] == [("00" * 16, 0), ("01" * 16, 0), ("02" * 16, 0)]


# Phrases


def brute_phrases(docs, least=10, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= 50 * a for h, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_docs():
    rnd = random.Random(8)
    words = ["New", "york", "city", "hall", "é", "Éa", "日本", "of", "the", "a-b", "x"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b"]) for _ in range(rnd.randint(0, 80)))
    docs = [(rnd.choice(["en", "fr", None, "und", ""]), text() + "new york city " * rnd.randint(0, 3)) for _ in range(120)]
    return docs + [("en", None), ("de", ""), ("de", " .\t"), docs[0], docs[0], (None, "a a a a a a a a a a a a a a"), ("zz", "one two " * 20_000)]


@pytest.mark.parametrize("bits, page_bytes", [(22, 1 << 23), (2, 4000)])
def test_phrases(spark, monkeypatch, bits, page_bytes):
    """Also with a sketch so small that its cells are all full: nothing frequent is lost, nothing rare comes in."""
    docs = phrase_docs()
    monkeypatch.setattr(phrases, "phrase_counts", lambda d, m, c, real=phrases.phrase_counts: real(d, m, c, page_bytes, bits))
    df = spark.createDataFrame([(i if i % 7 else None, t, lang, "x", 1) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    got = phrases.collocations(df).collect()
    want = brute_phrases(docs)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want and len(want) > 30
    assert phrases.collocations(df, top=3).filter("lang = 'en'").count() == 3


def test_phrases_without_documents_or_languages(spark):
    df = spark.createDataFrame([("a b " * 12,)], "text string")
    assert phrases.collocations(df.limit(0)).collect() == []
    assert [(r.lang, r.phrase, r.a) for r in phrases.collocations(df).collect()] == [(r[0], r[2], r[3]) for r in brute_phrases([(None, "a b " * 12)])]


def test_the_sketch_prunes():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 200_000).astype("u8")
    counts = np.where(np.arange(200_000) % 50 == 0, 12, 1)
    full = np.ones(200_000, bool)
    for row in range(phrases.ROWS):
        every = phrases.cells_of(hashes, row, 2)
        cells, n = phrases._summed(every, counts)
        full &= (n >= 10)[np.searchsorted(cells, every)]
    assert full[::50].all() and full.sum() < 4100


# The automaton


def brute_scores(docs, order, weights):
    tokens = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))] + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = [Counter() for _ in range(order + 1)]
    for i, t in docs:
        if not held(i):
            own = tokens(t)
            for k in range(1, order + 1):
                counts[k].update(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])

    def p(words):
        if len(words) == 1:
            return (counts[1][words] + 0.1) / (n + 0.1 * (v + 1))
        weight = weights[len(words) - 2]
        return (counts[len(words)][words] + weight * p(words[1:])) / (counts[len(words) - 1][words[:-1]] + weight)

    out = []
    for i, t in docs:
        own = tokens(t)
        base = sum(math.log10(p((w,))) for w in own)
        score = sum(math.log10(p(tuple(own[max(0, j - order + 1) : j + 1]))) for j in range(len(own)))
        out.append((str(i), held(i), len(own), sum(counts[1][(w,)] > 0 for w in own), n, base, score))
    return out, counts, p


def language_docs():
    rnd = random.Random(6)
    words = [*"the of A b c".split(), *(f"w{i}" for i in range(40)), "É", "日本"]
    text = lambda n: "".join(rnd.choice(words[: rnd.randint(5, len(words))]) + rnd.choice([" ", "\n", "\t "]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(150)]
    return docs + [(None, "the of"), (None, None), (500, None), (501, ""), (502, " \n"), (3, docs[3][1]), (503, "only here"), (504, text(3000)), (30, "never seen before " * 3)]


@pytest.mark.parametrize("order, weights, lane", [(3, (20.0, 3.0), 512), (3, (2000.0, 20.0), 4), (2, (5.0,), 3), (1, (), 7), (4, (9.0, 2.0, 1.0), 5)])
def test_scores(spark, order, weights, lane):
    docs = language_docs()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, block int").repartition(4)
    got = automaton.score_documents(df, order, weights, page_bytes=3000, lane=lane).collect()
    key = lambda r: (r[0], r[2], round(r[5], 6), round(r[6], 6))
    want, counts, p = brute_scores(docs, order, weights)
    have = sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(have, sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)
    assert len(have) == len(docs)
    if order == 3:  # all continuations of a history sum to one, an unknown word included
        for history in ((), ("the",), ("the", "of"), ("zzz",)):
            assert sum(p((*history, w)) for (w,) in counts[1]) + p((*history, "unknown")) == pytest.approx(1)


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert automaton.score_documents(df.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = automaton.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_the_state_is_what_is_left_of_the_history():
    """One traversal of a small automaton: arcs where an n-gram was seen, else failure arcs."""
    block = ngrams.split_words([[1]], [b"a b c a b"], b" ")
    ids, joined, sizes = automaton.with_ends(block)
    levels = ngrams.levels_of(np.zeros(1, "i8"), ids, joined, len(block.words) + 1, 3)
    counts = [x.counts() for x in levels]
    counts[2][:] = 0
    machine = automaton.Automaton(levels, counts, len(block.words), 6, 4)
    length, gram = np.zeros(1, "i8"), np.zeros(1, "i8")
    seen = []
    for w in ids.tolist():
        machine.step(length, gram, np.array([w]))
        seen.append(int(length[0]))
    assert seen == [1, 2, 2, 2, 2, 2]


def test_messages_keep_values_and_counts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        values = np.sort(rng.integers(1 << 40, 1 << 60, n).astype("u8"))
        counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], n)
        got = ngrams.opened(ngrams.message(values, counts, 1 << 40), 1 << 40)
        assert (got[0] == values).all() and (got[1] == counts).all()
    for pages in (1, 7, 1000):
        starts = np.array([ngrams.page_start(k, pages) for k in range(pages)], "u8")
        assert ngrams.page_of(starts, pages).tolist() == list(range(pages))
        assert pages == 1 or ngrams.page_of(starts[1:] - np.uint64(1), pages).tolist() == list(range(pages - 1))
