"""The pipeline's stages on a small folder: their columns, their effect, and its clean documents."""

import math
import random

from test_brute_force import brute_model, dropped, grams

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.packing import WordIds


def test_pipeline(spark, tmp_path):
    random.seed(1)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = [text(60) + ".\n" + text(40) for _ in range(120)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    docs += [(200, base[0], "en", "s", len(base[0])), (201, "#$%&" * 60, "en", "s", 240), (202, text(30) + " " + base[5][:300] + " " + text(30), "en", "s", 700), (203, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        seen.append({r.doc_id: r.text for r in now.collect()})
    assert set(seen[0]) == {*range(120), 200, 202}  # rejected: symbols, and no text
    assert set(seen[1]) == {*range(120), 202}  # all lines of the copy were there before
    assert set(seen[2]) == set(seen[1])
    assert base[5][10:290] in seen[2][202] and base[5][10:290] not in seen[3][202]
    assert all(seen[3][i] == base[i] for i in range(120))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen[3])


def brute_quality(spark, docs, labels, order=5):
    """The documents that stay, by a model in dictionaries over those trusted and not held out."""
    ids = quality.trusted_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = {r.doc_id for r in quality.held_out(ids, True).collect()}
    train = {r.doc_id for r in ids.collect()} - held
    p = brute_model([docs[i].encode() for i in train if docs.get(i)], order)
    nll = {}
    for i, text in docs.items():
        framed = bytes(order - 1) + (text or "").encode()
        nll[i] = -sum(math.log(p(framed[j : j + order])) for j in range(len(framed) - order + 1)), len(framed) - order + 1
    known = sorted(n / size for n, size in (nll[i] for i in held if i in nll) if size)
    middle = known[math.ceil(0.5 * len(known)) - 1]
    drawn = lambda n, size: (n + quality.PRIOR_BYTES * middle) / (size + quality.PRIOR_BYTES)
    top = sorted(drawn(*nll[i]) for i in held if i in nll and nll[i][1])
    limit = math.exp(top[math.ceil(quality.QUANTILE * len(top)) - 1]) * quality.MARGIN
    return {i: docs[i] for i, (n, size) in nll.items() if size and math.exp(drawn(n, size)) <= limit}


def brute_lines(docs):
    lost, out = dropped(docs), {}
    for i, text in docs.items():
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in lost)
        if kept.strip(" ") or not any(j == i for j, _ in lost):
            out[i] = kept
    return out


def brute_copies(docs):
    sets = {i: grams(t) for i, t in docs.items()}
    group = {i: i for i in sets}
    linked = {i: [j for j in sets if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    for _ in sets:
        group = {i: min([group[i], *(group[j] for j in linked[i])]) for i in sets}
    return {i: t for i, t in docs.items() if group[i] == i}


def brute_passages(docs):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = text.encode()
        windows = [data[j : j + 50] for j in range(len(data) - 49)]
        gone = {k for j, w in enumerate(windows) if w in seen for k in range(j, j + 50)}
        seen |= set(windows)
        kept = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")
        if not gone or kept.strip(" "):
            out[i] = kept
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, lines_ = line(25), [line(rng.randint(1, 14)) for _ in range(12)]
    docs = {}
    for i in range(110):
        parts = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            parts.insert(1, lines_[rng.randrange(12)])
        if i % 9 == 0:
            parts[0] += " " + shared
        docs[i] = "\n".join(parts)
    for i in range(110, 125):
        own = docs[i - 110].split(" ")
        docs[i] = " ".join(own[: len(own) // 2] + [rng.choice(words)] + own[len(own) // 2 :])
    docs |= {125: docs[3], 126: None, 127: "", 128: "#$%&*!~" * 40, 129: "QXZ|" * 60, 130: " \n ", 131: docs[4].replace(" ", "\n", 3)}
    for i in range(140, 146, 2):  # near copies whose lines are no copies
        own = [rng.choice(words) for _ in range(40)]
        docs |= {i: " ".join(own), i + 1: " ".join(own[:20]) + "\n" + " ".join(own[20:])}
    labels = [(i, 1, 0) for i in range(100)] + [(128, 0, 0), (99, 1, 1)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute_quality(spark, docs, labels)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    brute = {"quality": lambda d: d, "lines": brute_lines, "near_copies": brute_copies, "passages": brute_passages}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, want = len(want), brute[name](want)
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id: r.text for r in now.collect()} == want, name
        assert name == "quality" or len(want) < before or name == "passages"
    ids = WordIds("word_bpe_49k.json")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, text in want.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids.document(text, 2)
    assert {p.doc_id for p in pieces} == set(want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
