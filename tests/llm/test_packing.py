import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.common import tokenizer_file
from tessera.llm.packing import WordIds, merge_leftovers, pack_documents

PATH = tokenizer_file("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
WORDS = WordIds("word_bpe_49k.json")


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", [None, "", " a  B\n c's ", "Été É don't <|endoftext|>x", "a\x1cb \x1f c　d", "é A b", "x" * 900, "İ ΑΣ ς", " \x1c a, a. A! b1; b1 #, Zé-z ß"])
def test_words_equal_library(text):
    assert np.frombuffer(WordIds(PATH).document(text, 2), "<u4").tolist() == ids_of(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdEÉéßñŉǆ²½ªº_'.,-#$1٣ \t日İ\u0301<|>st"), max_size=60))
def test_any_words_equal_library(text):
    assert np.frombuffer(WORDS.document(text, 2), "<u4").tolist() == ids_of(text)


def verify(rows, texts, capacity):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pack(spark, docs_of):
    texts = {i: "lorem ipsum " * (i * 7 % 90) for i in range(200)} | {200: None, 201: "", 202: "word " * 1000, 203: "same", 204: "same"}
    rows = pack_documents(docs_of([*texts.items()]), PATH, capacity=64, windows=3).collect()
    assert verify(rows, texts, 64) == 0
    assert pack_documents(docs_of([(1, "x")]).limit(0), PATH).count() == 0


def test_merge_cuts_at_powers_of_two():
    packer = merge_leftovers([(1, 0, b"abcd" * 21, 21)], 0, 16)
    assert [r[2] for r in packer.rows] == [16, 4, 1]
