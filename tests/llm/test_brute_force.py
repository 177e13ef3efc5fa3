"""The operators against brute force on small tables with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, embeddings, fingerprint, html, jaccard, lines, quality, sharding, suffixes

random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omikron", "pi"]
sentence = lambda n: " ".join(random.choice(WORDS) for _ in range(n))


def corpus():
    base = [sentence(random.randint(5, 120)) + "\n" + sentence(12) for _ in range(25)]
    near = [" ".join(w if random.random() > 0.02 else "changed" for w in base[0].split(" ")) for _ in range(15)]
    return [None, "", " ", "\n", "one", "one two", *base, *near, base[3], base[3], "long " * 5000, base[4] + "\n" + base[5], "Ünï çødé ä " * 20]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(corpus()))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("hot", [256, 1])
def test_passages(docs_of, texts, monkeypatch, hot):
    """Also with every minimizer of two blocks merged by groups of blocks first."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = by_id(suffixes.passage_report(docs_of([*texts.items()]), block_bytes=3000))
    seen, total = set(), 0
    for i, text in sorted(texts.items()):
        data = (text or "").encode()
        mask, new = np.zeros(len(data), bool), set()
        for j in range(len(data) - 49):
            w = data[j : j + 50]
            if w in seen:
                mask[j : j + 50] = True
            new.add(w)
        seen |= new
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = sum(1 for j in range(len(mask)) if mask[j] and (not j or not mask[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
        total += int(mask.sum())
    assert total and len(got) == len(texts)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array(letters):
    for n in (1, 2, 50, 400):
        text = np.random.default_rng(n).integers(97, 97 + letters, n).astype("u1")
        raw = text.tobytes()
        assert suffixes.suffix_array(text, n + 8).tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_only_smaller_suffixes_are_sorted(monkeypatch):
    text = np.random.default_rng(1).integers(97, 100, 3000).astype("u1")
    sizes, sort, lexsort = [], np.argsort, np.lexsort
    up = suffixes.smaller_than_next(text)
    monkeypatch.setattr(suffixes.np, "argsort", lambda a, **k: sizes.append(len(a)) or sort(a, **k))
    monkeypatch.setattr(suffixes.np, "lexsort", lambda a, **k: sizes.append(len(a[0])) or lexsort(a, **k))
    direct = suffixes.sorted_directly(text, np.flatnonzero(up), 50)
    raw = text.tobytes()
    assert direct.tolist() == sorted(np.flatnonzero(up).tolist(), key=lambda i: raw[i : i + 50])
    assert max(sizes) == up.sum() < 0.6 * len(text) and all(n < up.sum() for n in sizes[1:])


@pytest.mark.parametrize("letters", [1, 3])
def test_common_prefixes(letters):
    text = np.concatenate([np.random.default_rng(2).integers(97, 97 + letters, 200), [97] * 70]).astype("u1")
    order, raw = suffixes.suffix_array(text, 50), text.tobytes()
    shared = lambda a, b: next((k for k in range(50) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= len(raw)), 50)
    assert suffixes.common_prefixes(text, order, 50)[1:].tolist() == [shared(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("task_grams", [400_000, 200])
def test_jaccard(docs_of, texts, task_grams):
    got = by_id(jaccard.near_documents(docs_of([*texts.items()]), task_grams=task_grams))
    sets = {i: grams(t) for i, t in texts.items()}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min([group[i], *(group[j] for j in linked[i])]) for i in sets}
    for i in sets:
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (len(linked[i]), group[i], group[i] == i)
    kept = jaccard.one_of_each_group(docs_of([*texts.items()]))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in sorted(sets) if group[i] == i] and "class_id" in kept.columns


def test_bands():
    bands, rows = jaccard.bands_and_rows(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90
    assert components.connected_components(links.limit(0)).count() == 0


def dropped(texts):
    sets, order, first = {}, [], {}
    for i, text in sorted(texts.items()):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x)
            sets[i, k] = s
            if s and s not in first:
                first[s] = (i, k)
                order.append(s)
    gone = {s for n, s in enumerate(order) if any(len(s & o) >= 0.8 * len(s | o) for o in order[:n])}
    return {p for p, s in sets.items() if s and (s in gone or first[s] != p)}


@pytest.mark.parametrize("leaders, few", [(4, 1 << 22), (1, 1 << 22), (4, 0)])
def test_lines(docs_of, texts, leaders, few, monkeypatch):
    """few: the pairs up to which a bitmap tells what to read again."""
    monkeypatch.setattr(lines, "FEW_PAIRS", few)
    lost = dropped(texts)
    got = by_id(lines.line_report(docs_of([*texts.items()]), leaders=leaders, slots=1 << 12))
    for i, text in texts.items():
        assert got[i].removed_lines == ",".join(str(k) for j, k in sorted(lost) if j == i) and got[i].n_lines == (text or "").count("\n") + 1
    kept = by_id(lines.dedup_lines(docs_of([*texts.items()])))
    for i, text in texts.items():
        want = "\n".join(x for k, x in enumerate((text or "").split("\n")) if (i, k) not in lost)
        if (i, 0) in lost and not want.strip(" "):
            assert i not in kept
        else:
            assert (kept[i].text or "") == want


def test_lines_with_repeated_ids(docs_of):
    got = lines.line_report(docs_of([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "x"), (2, "one token\nx")])).collect()
    assert sorted((str(r.doc_id), r.removed_lines) for r in got) == [("1", "0"), ("1", "0"), ("2", ""), ("2", "0"), ("None", "")]


def test_lines_far_ids_and_clashing_names(spark):
    rows = [(-(1 << 62), "a b\nc d", 0, "k"), (1 << 62, "b a\ne f", 0, "l"), (None, "c d", 0, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, Doc string").withColumn("_cut", F.lit(1)).withColumn("hash", F.lit(2))
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and sorted((r.Doc, r.text) for r in kept.collect()) == [("k", "a b"), ("l", "e f"), ("m", "c d")]
    assert lines.dedup_lines(docs.limit(0)).count() == lines.line_report(docs.limit(0)).count() == 0


def chain(n, step=10, size=100):
    """Sets of which each is like its neighbours only, and their bands."""
    value = np.random.default_rng(1).integers(0, 1 << 63, n * step + size).astype("u8")
    sets = [np.sort(value[i * step : i * step + size]) for i in range(n)]
    bands, rows = jaccard.bands_and_rows(0.8, 0.999)
    starts = np.cumsum([0] + [size] * n)
    return sets, jaccard.band_hashes(np.concatenate(sets), starts, bands, rows)


def test_only_band_mates_are_compared():
    sets, bands = chain(2000)
    share = {(i, j) for i in range(2000) for j in range(i + 1, min(i + 12, 2000)) if (bands[i] == bands[j]).any()}
    left, right, compared = jaccard.verified(sets, bands, 0.8)
    assert share <= {(i, j) for i in range(2000) for j in range(i + 1, 2000) if j - i < 12} and compared == len(share) < 2000 * 6
    links = {(i, i + 1) for i in range(1999)}
    assert {(int(a), int(b)) for a, b in zip(left, right) if a < b} == links & share and len(links & share) >= 1990
    # The same by buckets: each pair in the first band that it shares, and in no other.
    seen, total = [], 0
    for k in range(bands.shape[1]):
        for h in np.unique(bands[:, k]):
            own = np.flatnonzero(bands[:, k] == h)
            if len(own) > 1:
                a, b, n = jaccard.verified([sets[i] for i in own], bands[own], 0.8, k)
                seen += [(int(own[x]), int(own[y])) for x, y in zip(a, b) if x < y]
                total += n
    assert sorted(seen) == sorted(links & share) and total == compared


def test_many_near_copies_of_a_line(docs_of):
    words = [f"w{i}" for i in range(30)]
    texts = {i: "\n".join([" ".join([*words[:28], f"x{i}", f"y{i % 7}"]), f"own {i} line"]) for i in range(300)}
    assert {r.doc_id: r.removed_lines for r in lines.line_report(docs_of([*texts.items()])).collect()} == {i: "0" if i else "" for i in texts}


def test_fingerprints(docs_of, texts):
    got = by_id(fingerprint.fingerprint_documents(docs_of([*texts.items()])))
    ids = sorted(texts)
    for n, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and (got[i].fingerprint == got[i].edited_fingerprint) == (text == edited)
    def likeness(a, b):
        cut = lambda f: {f.split(":")[2][k : k + 8] for k in range(0, len(f.split(":")[2]), 8)}
        return 1.0 if a == b else len(cut(a) & cut(b)) / max(1, len(cut(a) | cut(b)))

    for n, i in enumerate(ids):
        assert got[i].near_edited == pytest.approx(likeness(got[i].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_next == pytest.approx(likeness(got[i].fingerprint, got[ids[(n + 1) % len(ids)]].fingerprint))
    same = {}
    for i, text in texts.items():
        same.setdefault(text or "", set()).add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values()) and len({x for s in same.values() for x in s}) == len(same)
    nulls = [(None, "first one"), (None, "second one"), (1, "third text"), (1, "other third"), (7, "last text."), (-(1 << 63), "smallest id")]
    order = sorted(nulls, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {(i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 6][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order)}
    assert {(r.doc_id, r.edited_sha256) for r in fingerprint.fingerprint_documents(docs_of(nulls)).collect()} == want
    numbers = docs_of([(i, "") for i in (None, -5, 0, 3, 4, 19, 20, 99)])
    for bounds in ([], [3], [0, 3, 4, 5, 20], list(range(20))):
        for r in numbers.select("doc_id", fingerprint.bounds_below(bounds, F.coalesce("doc_id", F.lit(-9))).alias("n")).collect():
            assert r.n == sum(b < (-9 if r.doc_id is None else r.doc_id) for b in bounds)
    alone = fingerprint.fingerprint_documents(docs_of([(5, "abcd")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprint_documents(docs_of([(1, "x")]).limit(0)).count() == 0


def test_shards(docs_of, texts):
    got = by_id(sharding.shard_documents(docs_of([*texts.items()]), 8))
    counts = [sorted(r.slot for r in got.values() if r.shard == k) for k in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    for i, text in texts.items():
        data = (text or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.shard_documents(docs_of([(1, "x")]).limit(0)).count() == 0


def brute_shards(rows, shards, bits=4):
    """The rules of the docstring over a list of (doc_id, text, lang, source), in plain Python."""
    from collections import Counter

    def cells(values):
        top = sorted(v for v, _ in sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[: 2**bits - 1])
        return {v: top.index(v) if v in top else 2**bits - 1 for v in values}

    langs, sources = cells([r[2] for r in rows]), cells([r[3] for r in rows])
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256((r[1] if r[1] is not None else "\0null").encode()).hexdigest(), []).append(r)
    every = []
    for name, own in groups.items():
        first = min((r[0], langs[r[2]], sources[r[3]], min(15, int(np.log2(len((r[1] or "").encode()) + 1)))) for r in own)
        index = sharding.hilbert_value(first[1:], bits)
        every += [(index, first[0], name, r[0]) for r in own]
    every.sort()
    sizes = [len(every) // shards + (k < len(every) % shards) for k in range(shards)]
    at_shard = lambda at, runs: next((k for k in range(shards) if at < sum(runs[: k + 1])), shards - 1)
    held, free = [[] for _ in range(shards)], [x for x in every if len(groups[x[2]]) == 1]
    for name, own in groups.items():
        if len(own) > 1:
            start = next(k for k, x in enumerate(every) if x[2] == name)
            held[at_shard(start + len(own) // 2, sizes)] += [x for x in every if x[2] == name]
    for k, own in enumerate(held):
        own.sort(key=lambda x: (len(groups[x[2]]), x))
        free += own[sizes[k] :]
        held[k] = own[: sizes[k]]
    room = [n - len(h) for n, h in zip(sizes, held)]
    for k, x in enumerate(sorted(free)):
        held[at_shard(k, room)].append(x)
    return {x[3]: (k, slot, x[0]) for k, own in enumerate(held) for slot, x in enumerate(sorted(own))}


@pytest.mark.parametrize("hot", [0, 70])
def test_shards_against_plain_rules(spark, hot):
    rng = random.Random(hot)
    texts = [sentence(rng.randint(1, 30)) for _ in range(90)]
    rows = [(i, rng.choice(texts) if i % 3 else f"{i} own", rng.choice(["en", "de", "fr"]), f"src{rng.randint(0, 19)}") for i in range(200)]
    rows += [(300 + i, "hot", "en", "src1") for i in range(hot)] + [(500, None, "en", "src2"), (501, "", "en", "src2")]
    want = brute_shards(rows, 8)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), 8).collect()
    assert {r.doc_id: (r.shard, r.slot, r.curve_index) for r in got} == want
    where = {}
    for i, text, *_ in rows:
        where.setdefault(text, set()).add(want[i][0])
    split = [t for t, s in where.items() if len(s) > 1]
    assert split == (["hot"] if hot else [])


def test_hilbert_is_a_curve():
    bits = 3
    cells = sorted(((a, b, c) for a in range(8) for b in range(8) for c in range(8)), key=lambda p: sharding.hilbert_value(p, bits))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    near = base[:60] + 0.15 * rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate([*base, *near, *near[:5], *([base[0]] * 9)])]
    rows += [(900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [1.0, None] * 8, 0, "x"), (904, [], 0, "x"), (905, [1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, leaf=40, tile=16).collect()}
    points = np.array([r[1] for r in rows[:-6]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    want = points @ points.T >= 0.9
    assert len(got) == len(rows)
    found, real = sum(got[i].n_links for i in range(len(points))), int(want.sum()) - len(points)
    assert 0.9 * real <= found <= real
    for i in range(900, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


PAGE = """<html><body><nav><a href=1>menu</a></nav><header>Site</header><div class="cookie-notice">we use cookies</div><aside>side</aside>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>\n text.<p>Second &eacute;&#33;<script>x("</p>")</script><form><p>mail</p></form><ul><li>a<li>b</ul></article>
<section id="comments"><p>A reader says something that is rather long, longer than the article itself, so it seems.</p></section><footer>end</footer></body>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>only<br>one"), (5, "u", "<!-- open"), (6, None, "a < b &lt; c"), (1, "u", PAGE)]
    got = spark.createDataFrame(rows, "page_id long, url string, html string").transform(html.extract_pages).collect()
    text = {r.page_id: r.text for r in got}
    assert text == {1: "Title & more\nFirst bold text.\nSecond é!\na\nb", 2: "", 3: "", 4: "only one", 5: "", 6: "a < b < c"}
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 7


@pytest.mark.parametrize("page, text", [
    ('<body><nav><a href=1>m</a></nav><article class="sponsored-post">{p}{p}</article><footer>f</footer></body>', "P\nP"),
    ('<body><div id="main-widget"><nav><a href=1>m</a></nav><div><h1>T</h1>{p}{p}</div></div></body>', "T\nP\nP"),
    ('<body><article><h1 class="entry-header">T</h1>{p}<p class="notice-period">Short.</p>{p}<div class="ad">Buy it.</div></article></body>', "T\nP\nShort.\nP"),
    ("<body><header><h1>Site</h1></header><article><header><h1>T</h1></header>{p}{p}</article></body>", "T\nP\nP"),
    ("<body><div class=sidebar><p>{p}{p}</div><ul><li><a href=1>x</a><li><a href=2>y</a></ul></body>", "P\nP"),
    ('<body><form action="/"><input value="x"><div>{p}{p}</div></form><div class="cookies">We use cookies.</div></body>', "P\nP"),
    ("<body><div>{p}<section>{p}{p}</section><section>{p}{p}{p}</section></div><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></body>", "P\nP\nP\nP\nP\nP"),
])
def test_density_decides_whatever_names_say(page, text):
    para = "A paragraph with a good deal of text in it, and then some more of it."
    assert html.extract(page.replace("{p}", f"<p>{para}</p>")) == text.replace("P", para)


def test_container_is_the_node_of_the_largest_sum():
    """Against a plain recursion over random trees without names or links: a node's density is its characters a tag."""
    rng = random.Random(4)

    def grow(depth):
        inside = "".join(grow(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        return f"<div>{'x' * rng.randint(0, 60)}{inside}</div>"

    def chars_and_tags(node):
        parts = [chars_and_tags(c) for c in node.children if not isinstance(c, str)]
        return sum(len(c) for c in node.children if isinstance(c, str)) + sum(c for c, _ in parts), sum(t + 1 for _, t in parts)

    def density(node):
        c, t = chars_and_tags(node)
        return c / max(t, 1)

    for _ in range(60):
        root = html.parse(f"<body>{grow(4)}</body>")
        body = html.measure(root)
        nodes = html._walk(body)
        sums = {id(n): sum(density(c) for c in n.children if not isinstance(c, str)) for n in nodes}
        ratio = {round(n.density / density(n), 9) for n in nodes if density(n)}
        assert len(ratio) <= 1 and sums[id(html.container(body)[0])] >= max(sums.values()) - 1e-9


def test_very_long_and_deep_pages():
    long = "word " * 400_000
    assert len(html.extract(f"<body><article><p>{long}</p></article></body>")) == len(long) - 1
    assert html.extract("<div>" * 20_000 + "deep") == "deep" and html.extract("<p>a" * 20_000).count("\n") == 19_999


def test_pages_without_article():
    para = "<p>A paragraph with a good deal of text in it, and then some more of it.</p>"
    links = "".join(f"<li><a href={i}>Related story {i}</a></li>" for i in range(6))
    assert html.extract(f"<body><div><a href=1>x</a> <a href=2>y</a></div><h1>Head</h1><div>{para * 3}</div><div><ul>{links}</ul></div></body>").split("\n")[0] == "Head"


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, with dictionaries."""
    from collections import Counter

    tables = {order: Counter()}
    for t in texts:
        data = bytes(order - 1) + t
        tables[order].update(data[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    models = {}
    for k, table in tables.items():
        n = [sum(1 for c in table.values() if c == j) for j in range(1, 5)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(j + 1 - (j + 2) * y * n[j + 1] / n[j], 0.05), j + 0.95) for j in range(3)]
        else:
            d = [0.5, 0.75, 0.9]
        total, held = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        models[k] = table, total, held, d

    def p(g):
        if not g:
            return 1 / 256
        table, total, held, d = models[len(g)]
        lower = p(g[1:])
        if g[:-1] not in total:
            return lower
        c = table.get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower

    return p


def test_language_model(spark, docs_of):
    import math

    texts = {i: sentence(8) for i in range(40)} | {40: "QQQ ### 123", 41: None, 42: "é日"}
    trusted = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    got = by_id(quality.score_documents(docs_of([*texts.items()]), trusted, 3, block_bytes=500))
    p = brute_model([texts[i].encode() for i in range(25)], 3)
    for i, text in texts.items():
        data = (text or "").encode()
        framed = bytes(2) + data
        want = -sum(math.log(p(framed[j : j + 3])) for j in range(len(data)))
        assert got[i].n_bytes == len(data) and abs(got[i].nll - want) < 1e-3 * max(1, want)


def test_classifier(spark, docs_of):
    texts = {i: sentence(30) for i in range(300)} | {300 + i: "".join(random.choice("#$%&QXZ!|~") for _ in range(150)) for i in range(20)} | {400: None, 401: ""}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(0, 1, 0)] + [(310, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify(docs_of([*texts.items()]), labels))
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in [*range(300, 320), 400, 401])
    none = by_id(quality.classify(docs_of([*texts.items()]), labels.limit(0)))
    assert none[5].kept and not none[400].kept
    kept = quality.good_documents(docs_of([*texts.items()]), labels)
    assert kept.count() == 300 and "class_id" in kept.columns


def odd_rows(spark, rows):
    """Rows (id, text) with columns named like those that the operators add, in any case."""
    names = ("gone", "Version", "id", "sha", "kept", "hash", "cut", "doc", "_gone", "_kept", "n", "class_id", "rep", "key", "grams")
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    return df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names)))


def test_stages_with_null_ids_and_clashing_names(spark):
    long, other = sentence(60), sentence(60)
    rows = [(None, long), (None, long), (1, long), (2, long), (3, other), (3, other), (4, None), (5, ""), (6, long[:200] + " " + other)]
    docs = odd_rows(spark, rows)
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == len(rows) and all((r.perplexity is None) == (not r.n_bytes) for r in scored)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "6", "None", "None"]
    one = jaccard.one_of_each_group(docs)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["3", "3", "4", "5", "6", "None", "None"]
    near = {(r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.near_documents(docs).collect()}
    assert {(None, None, 3, True), (1, None, 3, False), (2, None, 3, False), (3, 3, 1, True), (4, 4, 0, True)} <= near
    cut = suffixes.dedup_passages(docs)
    assert cut.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in cut.filter("text <> ''").collect())[0] == ("3", other)
    for f in (lambda d: quality.classify(d, labels), lambda d: quality.good_documents(d, labels), jaccard.near_documents, jaccard.one_of_each_group, suffixes.passage_report, suffixes.dedup_passages):
        assert f(docs.limit(0)).count() == 0


def test_scores_of_repeated_ids_are_their_own(spark):
    rows = [(i, sentence(30)) for i in range(60)] + [(1, "#" * 31), (1, "x" * 400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_rows(spark, rows), labels).filter("doc_id = 1").collect()
    assert sorted(r.n_bytes for r in got) == sorted([31, 400, len(rows[1][1])])
    assert {r.n_bytes: r.kept for r in got} == {31: False, 400: False, len(rows[1][1]): True}
