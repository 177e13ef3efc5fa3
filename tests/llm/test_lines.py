"""Line dedup: what it reads, and pairs at the bounds of its filters."""

import re

from tessera.llm import lines


def test_the_report_reads_no_text_again(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nf"), (2, "a b c d e"), (3, None)], "doc_id long, text string").repartition(1)
    path = lines.stored(docs, "documents")._stored_path
    out = lines.line_report(spark.read.parquet(path))
    scans = re.findall(r"ReadSchema: (.*)", out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert scans and not [s for s in scans if "text" in s]
    assert {(r.doc_id, r.n_lines, r.removed_lines) for r in out.collect()} == {(1, 2, ""), (2, 1, "0"), (3, 1, "")}


def test_either_set_may_be_the_larger_and_the_later_one(spark):
    """All pairs of two sizes at the threshold, where the larger set's rare tokens are its own, so that the first common one lies behind its front."""
    texts = {}
    for n in range(4, 40):
        common = [f"c{n}x{i}" for i in range(n)]
        for own in (n // 4, n // 4 + 1):
            for order in (0, 1):
                pair = [" ".join(f"{w}o{own}y{order}" for w in common), " ".join([f"{w}o{own}y{order}" for w in common] + [f"r{n}x{own}y{order}z{i}" for i in range(own)])]
                for text in pair[::1 - 2 * order]:
                    texts[len(texts)] = (text, n / (n + own) >= 0.8 and len(texts) % 2 == 1)
    # The common tokens are made frequent by lines that match nothing.
    frequent = [(10**6 + i, " ".join([w, f"u{i}", f"v{i}"])) for i, w in enumerate(sorted({w for t, _ in texts.values() for w in t.split() if w[0] == "c"}))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()] + frequent, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.line_report(docs, leaders=0).collect()}
    assert {i: got[i] for i in texts} == {i: int(gone) for i, (_, gone) in texts.items()}
    assert not any(n for i, n in got.items() if i >= 10**6)


def test_letters_beyond_ascii_are_lower_cased_as_in_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "ΟΔΟΣ Straße É\tx\ry z"), (2, "οδος straße é X Y Z"), (3, "İ a"), (4, "i̇ A")], "doc_id long, text string")
    assert [r.n_removed for r in lines.line_report(docs).orderBy("doc_id").collect()] == [0, 1, 0, 1]


def test_only_large_groups_have_leaders(docs_of, spark, monkeypatch):
    """Pairs of neighbours of few sets aren't shuffled with these, and tokens aren't written as a table or kept afterwards."""
    rows = {}

    def stored(df, tag, *more, real=lines.stored):
        out = real(df, tag, *more)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "stored", stored)
    large = {i: " ".join([*(f"w{k}" for k in range(28)), f"x{i}", f"y{i}"]) for i in range(40)}
    small = {100 + i: " ".join([*(f"v{k}" for k in range(28)), f"z{i}"]) for i in range(4)}
    alone = {200 + i: " ".join(f"own{i}x{k}" for k in range(12)) for i in range(60)}
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    want = {i: int(i in large and i > 0 or i in small and i > 100) for i in {**large, **small, **alone}}
    for leaders in (0, 5):
        rows.clear()
        assert {r.doc_id: r.n_removed for r in lines.line_report(docs_of([*large.items(), *small.items(), *alone.items()]), leaders=leaders).collect()} == want
        assert "line-words" not in rows and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert 0 < rows["line-neighbours"] <= lines.KEYS * len(large)
