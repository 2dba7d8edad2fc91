import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockframe.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    "", "a", "it's I'LL we'll", "<|endoftext|> is text", "  two  spaces\n\n\tand  ", "a\x1cb \x85 c\x0b\x0cd", "ﬁ ½ ²x ١٢ naïve", "全角　空白。", "ไม่มีช่องว่าง", "a" * 5000, " " * 300 + "x", "!?" * 3000, "\r\n\r\n",
    "é ​﻿ 👩‍👩‍👧", "\\frac{a_1}{b^{2}} % note", "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_equals_library_and_round_trips(library, text):
    b = bpe.load()
    assert list(b.encode(text)) == library(text)
    assert b.decode(b.encode(text)) == text
    assert b.count(text) == len(b.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    b = bpe.load()
    assert list(b.encode(text)) == library(text)
    assert b.decode(b.encode(text)) == text


def test_full_cache_changes_nothing(monkeypatch):
    want = [list(bpe.load().encode(t)) for t in TEXTS]
    monkeypatch.setattr(bpe, "CACHE", 0)
    b = bpe.Bpe(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
    assert [list(b.encode(t)) for t in TEXTS] == want and not b.pieces


def test_frames(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_IDS", 50)
    rows = [(i, t, "x", 1) for i, t in enumerate([*TEXTS, None, "same", "same"])] + [(None, "no id", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: library(t) if t else [] for i, t, _, _ in rows}
    plain = df.select("doc_id", "text")
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(plain).collect()} == {i: len(v) for i, v in got.items()}
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()} == {i: t or "" for i, t, _, _ in rows}
    assert bpe.encode(plain.limit(0)).count() == 0
