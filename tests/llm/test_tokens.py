import random

import pytest

from strandflow.llm import tokens as K

pytestmark = pytest.mark.skipif(not K.available(), reason="no vocabulary files here")

TEXTS = [
    "", None, " ", "\n\n  x", "Hello world", "don't we'll I'M", "a" * 5000, " " * 300 + "x", "\t\r\n\x0b\x0c", "﻿def f(x):\r\n    return x",
    "漢字かな אב \U0001d518\U0001f600‍", "<|endoftext|>", "1234567890" * 9, "ª²½٣́e", "\x1c\x85\xa0 ", "=" * 200, "ab" * 400, "café",
]


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = K.Encoder(K.vocabulary_path()).ranks
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_against_public_library(public):
    rng = random.Random(5)
    alphabet = "abcXYZ 0189_-.,;'\"\n\t\r  éßñ漢\U0001f600‍\x1c\x85\xa0"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(500)]
    enc = K.Encoder(K.vocabulary_path())
    want = [public.encode_ordinary(t) if t else [] for t in texts]
    assert enc.encode_batch(texts) == want
    assert enc.count_batch(texts) == [len(w) for w in want]


def test_short_and_long_words_merge_alike():
    enc = K.Encoder(K.vocabulary_path())
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcdefghij_= \xc3\xa9") for _ in range(rng.randrange(1, K.SHORT + 1))) for _ in range(300)]
    assert enc.merge_short(words) == [enc.merge_long(w) for w in words]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "MEMO_WORDS", 3)
    enc = K.Encoder(K.vocabulary_path())
    for i in range(20):
        enc.encode_batch([f"word{i} other{i} third{i}"])
    assert len(enc.memo) < 20


def test_words_spell_the_text():
    for t in TEXTS:
        assert "".join(K.split_words(t or "")) == (t or "")


def test_rows(spark, public, monkeypatch):
    monkeypatch.setattr(K, "CHARS_AT_ONCE", 100)
    rows = [(i if i % 5 else None, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in K.encode(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i, public.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert got == want
    assert K.encode(df.limit(0), "doc_id", "text").count() == 0
