"""Whole results: links in dense groups of vectors, packed ids, short lines, pages in wrappers, ids and shard files."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import bpe, common, embeddings, html, lines, packing, sharding


def unit(a):
    return a / np.linalg.norm(a, axis=-1, keepdims=True)


def test_vectors_in_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    points = unit(rng.standard_normal((3000, 64)))
    points[:1000] = unit(0.85**0.5 * unit(rng.standard_normal(64)) + 0.15**0.5 * unit(rng.standard_normal((1000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, leaf=60).collect()}
    want = (points @ points.T >= 0.9).sum(1) - 1
    assert want.sum() > 1000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()


def brute_vectors(ids, points, threshold=0.9):
    """(links, smallest id reached) of each vector, pair by pair."""
    near = points @ points.T >= threshold
    group = np.array(ids)
    while True:
        then = np.where(near, group[None, :], group.max()).min(1)
        if (then == group).all():
            return dict(zip(ids, near.sum(1) - 1)), dict(zip(ids, group))
        group = then


def test_full_leaves_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "FULL", 2)
    monkeypatch.setattr(embeddings, "CHUNK", 500)
    rng = np.random.default_rng(3)
    points = unit(rng.standard_normal((4000, 24)))
    points[2000:3500] = unit(points[:1500] + 0.05 * rng.standard_normal((1500, 24)))
    points[3900:] = points[5]
    ids = list(range(10, 4010))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, points)], "vec_id long, embedding array<double>").repartition(6)
    links, group = brute_vectors(ids, unit(points))
    got = {r.vec_id: r for r in embeddings.near_vectors(df, leaf=15, sample=300, tile=64).collect()}
    assert len(got) == len(ids) and all(got[i].n_links <= links[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values()) and sum(got[i].component_id == group[i] for i in ids) >= 0.97 * len(ids)
    classes = spark.createDataFrame([(bytes([i >> 8, i & 255]), i, 1, 24, v.tobytes()) for i, v in enumerate(unit(points[:3900]))], "key binary, rep long, copies long, dim int, unit binary")
    placed = embeddings._placed(classes, 0.9, 15, 0.15, 0.99, 300, 7)
    split = embeddings._split_full(placed, classes, 0.9, 15, 0.15, 7)
    most = lambda df: max(r["count"] for r in df.groupBy("leaf").count().collect())
    assert most(split) <= 2 * 15 < most(placed)


def test_vectors_of_several_lengths_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 3.0, 0.1]), (4, [0.0, 1.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 1, "None", False), ("2", 0, "2", True), ("2", 1, "2", True), ("3", 1, "2", False), ("4", 0, "4", True), ("None", 1, "None", True)]


def test_packed_ids_are_the_texts(spark, docs_of):
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = {i: "lorem ipsum dolor " * (i * 7 % 40) for i in range(60)} | {60: None, 61: "word " * 1000}
    rows = packing.packed_pieces(docs_of([*texts.items()]), path, capacity=64, windows=3).collect()
    for i, text in texts.items():
        own = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(own, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids + [2]
    assert all(len(r.ids) == 4 * r.length for r in rows)
    last = corpus_pipeline.packing(spark, docs_of([(1, "a b")]), "").collect()
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist()[-1] for r in sorted(last, key=lambda r: r.start)][-1] == 2


def test_short_lines_are_compared(spark, docs_of):
    texts = {1: "All rights reserved.\na b c d\nab\n\nx y", 2: "all rights RESERVED.\na b c d e\nab ab ab ab ab\n\nx z", 3: "y  x\na b c\n \nnew", 4: "日本語\n日本語"}
    seen, want = [], {}
    for i, text in texts.items():
        for k, line in enumerate(text.split("\n")):
            s = set(line.lower().split())
            want.setdefault(i, [])
            if s and any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                want[i].append(k)
            seen += [s] if s else []
    report = lines.line_report(docs_of([*texts.items()]), min_tokens=1).collect()
    assert {r.doc_id: r.removed_lines for r in report} == {i: ",".join(map(str, gone)) for i, gone in want.items()}
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs_of([*texts.items()]), "").collect()}
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in texts.items()}
    assert got == kept and want[2] == [0, 1, 2]


TEXT = "<p>A paragraph with a good deal of text in it, and then some more of it.</p>" * 3


@pytest.mark.parametrize("wrapper", ['div class="layout-with-sidebar"', 'article class="post has-sidebar"', 'main id="no-header"', 'div id="sidebar-layout"', "div class='page wrap header-fixed'", 'main class="header-fixed"'])
def test_wrappers_named_after_noise(wrapper):
    tag, noise = wrapper.split()[0], '<div class="sidebar">Other things</div><div class="cookie-notice">We use cookies</div><div class="site-footer">End</div>'
    text = html.extract(f"<html><body><nav><a href=1>menu</a></nav><{wrapper}>{TEXT}{noise}</{tag}><footer>end</footer></body></html>")
    assert text == "\n".join(["A paragraph with a good deal of text in it, and then some more of it."] * 3)


def test_large_noise_beside_an_article_stays_out():
    assert html.extract(f'<body><article><p>Short text.</p></article><div class="comments-area">{TEXT * 3}</div></body>') == "Short text."
    assert html.extract(f'<body><main><p>Short text.</p></main><section class="sidebar">{TEXT * 3}</section></body>') == "Short text."


LONG = "<p>A paragraph with a good deal of text in it, and then some more of it.</p>"


@pytest.mark.parametrize("inside, words", [
    ('<p>It is <b class="related">closely related</b> to it.</p>', "It is closely related to it."),
    ('<p>We do a <span class="search">binary search</span> on it.</p>', "We do a binary search on it."),
    ('<p>So <a class="share" href="/x">share it</a> now.</p>', "So share it now."),
    ('<pre class="header">Accept: text/html</pre>', "Accept: text/html"),
    ('<p class="notice">Short notice.</p>', "Short notice."),
    ('<code class="login">login(name)</code>', "login(name)"),
    ('<div class="share-holders"><p>Shareholders met.</p></div>', "Shareholders met."),
    ('<div class="cookie-recipe">Take some flour.</div>', "Take some flour."),
    ('<section id="header-files"><p>Use them.</p></section>', "Use them."),
    ('<div class="footer-ad-like">Words.</div>', "Words."),
    ('<ul><li>One</li><li><div class="menu">Two words</div></li></ul>', "Two words"),
    ('<blockquote><div class="notice">He said so.</div></blockquote>', "He said so."),
    ('<div class="press-notice"><p>In the middle of it.</p></div>', "In the middle of it."),
])
def test_no_name_deletes_text(inside, words):
    for around in ("<article>{}</article>", "<div>{}</div>", "<main><section>{}</section></main>"):
        got = html.extract("<html><body><nav><a href=1>menu</a></nav>" + around.format(LONG * 3 + inside + LONG * 2) + "<footer>end</footer></body></html>")
        assert words in got.split("\n") and got.count("paragraph") == 5, got


@pytest.mark.parametrize("noise", ['<div class="ad">Buy it.</div>', '<div id="comments"><p>I like it.</p><p>So do I.</p></div>', '<aside>Side.</aside>', '<div class="related-posts"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>', '<form>Name <input></form>', '<div><div class="newsletter">Get our letter.</div></div>', '<div style="display:none">Not seen.</div>'])
def test_named_noise_in_the_middle_goes(noise):
    got = html.extract("<html><body><nav><a href=1>menu</a></nav><article>" + LONG * 3 + noise + LONG * 2 + "</article><footer>end</footer></body></html>")
    assert got == "\n".join(["A paragraph with a good deal of text in it, and then some more of it."] * 5)


def brute_blocks(page):
    """Block choice by plain recursion: text density with links, names as a twentieth, no parent pointers or sums kept."""
    import math

    root = html.parse(page)
    body = next(n for n in html._walk(root) if n.tag == "body")

    def counts(node):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
            else:
                own = counts(c)
                chars, tags, link_chars, link_tags = chars + own[0], tags + own[1] + (c.tag not in html.INLINE), link_chars + own[2], link_tags + own[3] + (c.tag == "a")
        return chars, tags, chars if node.tag == "a" else link_chars, link_tags

    whole = counts(body)

    def density(node):
        c, t, lc, lt = counts(node)
        t = max(t, 1)
        return 0.0 if not c else c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)) if lc or whole[2] else c / t

    def weight(node):
        return 1.0 if node is None or node.tag == "#root" else weight(node.parent) / (20 if node.noise else 1)

    best = max(html._walk(body), key=lambda n: sum(density(c) * weight(c) for c in n.children if not isinstance(c, str) and c.tag not in html.INLINE))
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    limit, out = min(map(density, path)), []

    def walk(node, base):
        if node not in path:
            named = node.noise and weight(node) < base
            d = density(node) * (weight(node) / base if named else 1)
            if node.parent in path and node.parent is not best and d < limit:
                return
            if named and not (node.parent in path and node.parent is not best) and d < max(limit, density(best)):
                return  # all random names are whole ones on divs beside blocks
        base = weight(node) if node in path else base
        for c in node.children:
            out.append(c.strip()) if isinstance(c, str) else walk(c, base)

    walk(body, 1.0)
    return [x for x in out if x]


def test_blocks_are_chosen_by_density():
    import random

    rng = random.Random(9)

    def grow(depth):
        inside = "".join(grow(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        link = f"<div><a href=1>{'y' * rng.randint(5, 30)}</a></div>" if rng.random() < 0.3 else ""
        name = rng.choice([' class="ad"', ' id="comments"']) if rng.random() < 0.15 else ""
        return f"<div{name}>{'x' * rng.randint(0, 60)}{inside}{link}</div>"

    for _ in range(80):
        page = f"<body>{grow(4)}{grow(3)}</body>"
        assert html.blocks(html.container(html.measure(html.parse(page)))) == brute_blocks(page), page


def test_encoded_ids_and_texts(docs_of):
    from tokenizers import Tokenizer

    path = common.tokenizer_file("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), {1: None, 2: "", 3: "a b\nc", 4: "ab" * 900, 5: "日本 é"}
    got = {r.doc_id: r for r in bpe.encoded_texts(docs_of([*texts.items()]), path).collect()}
    for i, text in texts.items():
        assert (got[i].ids, got[i].decoded) == (tok.encode(text or "", add_special_tokens=False).ids, text or "")


def test_shard_files_hold_the_documents(spark, docs_of, tmp_path):
    texts = [(i, None if i == 7 else "text " * (i % 9)) for i in range(50)] + [(3, "a copy"), (None, "no id")]
    docs = docs_of(texts)
    about = {r.shard: r for r in sharding.write_shards(docs, f"{tmp_path}/shards", 4).collect()}
    written = spark.read.parquet(f"{tmp_path}/shards").collect()
    whole = lambda rows: sorted(str([r[c] for c in docs.columns]) for r in rows)
    assert whole(written) == whole(docs.collect()) and len(list(tmp_path.glob("shards/shard=*/*.parquet"))) == 4
    for k in range(4):
        own = [r for r in written if r.shard == k]
        assert [r.slot for r in own] == list(range(13)) and [r.curve_index for r in own] == sorted(r.curve_index for r in own)
        sizes = [len(r.text or "") + 1 for r in own]
        assert (about[k].n_docs, about[k].min_size, about[k].max_size, about[k].max_curve_index) == (13, min(sizes), max(sizes), own[-1].curve_index)
