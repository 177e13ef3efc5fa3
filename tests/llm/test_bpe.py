import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import TreeBpe, encode_documents
from tessera.llm.common import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
TREE = TreeBpe(PATH, leaf=8)
ODD = ["", " ", "a", "  a  b ", "a\n\nb \n", "\ta b", "é" * 40, "ab" * 5000, "a" * 3001, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't we'll 's", "日本語テキスト" * 30, "a\x1cb \x1f c", "x" * 50 + "1" * 50 + "!?" * 40, "\U0001f600" * 50, "é a", "🙂 a\n b"]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ODD)
def test_equals_library(text):
    ref = reference()
    ids = ref.encode(text, add_special_tokens=False).ids
    assert TREE.encode(text) == ids
    assert TREE.decode(ids) == ref.decode(ids, skip_special_tokens=False)


REF = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdeé 日\n1!'tsreth"), max_size=400))
def test_any_text(text):
    assert TREE.encode(text) == REF.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("thereinangoisdla"), min_size=20, max_size=900))
def test_long_unsplit(text):
    assert TREE.encode(text) == REF.encode(text, add_special_tokens=False).ids


def test_query(spark, docs_of):
    texts = [None, *ODD, "same", "same"]
    got = {r.doc_id: r for r in encode_documents(docs_of([*enumerate(texts)]), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = REF.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(REF.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(docs_of([(1, "x")]).limit(0), PATH).count() == 0
