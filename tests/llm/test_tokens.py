"""Remembered pieces give the ids that the library gives, markers, odd spaces and accents included."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coppice.llm import quality, tokens, toxicity

BITS = ["a", "The", "wörd", "ÉTÉ", "straße", "İ", "ŉ", "ǅ", "Ⱥ", "naïve,", "día.", "don't", "we'll", "42", "x1", "1.5", "", " ", "  ", "\n", "\t", " ", " ",
        "é", "Å", "ﬁ", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ",", ".", "..", "-", "﻿", "ß.", "Ωmega", "ſ", "K"]


def library(path, texts):
    return [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_are_the_library_s(name, kind, monkeypatch):
    path, r = public_tokenizers.path(name), np.random.default_rng(0)
    texts = ["a <|endoftext|> b", "", *[str(r.choice(["", " ", "\n"])).join(r.choice(BITS, int(r.integers(1, 9)))) for _ in range(6000)]]
    enc = tokens.Encoder(open(path).read(), kind)
    assert enc.encode(texts) == library(path, texts)
    assert enc.encode([None]) == [b""]
    letters = ["".join(chr(c) for c in r.integers(0x20, 0x250, 5)) for _ in range(5000)]
    monkeypatch.setattr(tokens, "REMEMBER", 20_000)  # generations change all the time
    small = tokens.Encoder(open(path).read(), kind)
    assert [i for k in range(0, 5000, 250) for i in small.encode(letters[k : k + 250])] == library(path, letters)
    assert small.first.size < 20_000 + 250 * 5 * 400


def test_clauses_do_without_the_whole_tokenizer():
    """Words with marks and line ends are put together from their parts, as the library gives them."""
    path, r = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(1)
    words = ["The", "wörd", "ÉTÉ", "don't", "s", "x1", "²", "日本", "ª", "a_b", "snake_", "t"]
    marks = [".", ",", "", "!!", "$$$", ".***", "'", "'s", "...", "_", "!!!!!", "…", "\t", "\r"]
    ends = ["", "\n", "\n\n", "\r\n", "\n'"]
    pieces = ["".join(str(r.choice(x)) for x in (words, marks, ends, words, marks)) for _ in range(4000)]
    texts = [" ".join(r.choice(pieces, 6)) for _ in range(2000)]
    enc = tokens.Encoder(open(path).read(), "byte")
    assert enc.encode(texts) == library(path, texts)
    asked, raw = [], enc._raw
    enc._raw = lambda t: asked.extend(t) or raw(t)
    plain = ["he said xyzzy.\nNext$$$ plugh,!! end..."]
    assert enc.encode(plain) == library(path, plain)
    assert all(not any(c.isalpha() for c in t) for t in asked)
    held = sum(tokens.ENTRY + len(p) + len(ids or b"") for p, ids in enc.next.young.items())
    assert held == enc.next.size


def test_classifiers_take_a_bounded_number_of_rows(spark, monkeypatch):
    """Most rows share one id: few of them are sent."""
    rows = [(1, f"one id and many texts {i}") for i in range(3000)] + [(i, f"text number {i} is here") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 60)] * 2, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_nnpu", lambda p, u: seen.append((len(p), len(u))))
    quality.fit(docs, labels, sample=10)
    assert seen == [(10, 10)]
    got = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda texts, y, parts: got.append((len(texts), y.shape)))
    toxicity.fit(docs, labels, ["quality", "toxic"], sample=10)
    toxicity.fit(docs, labels, ["quality", "toxic"])
    assert got == [(10, (10, 2)), (59, (59, 2))]


def test_small_memory_gives_the_same_pieces(spark):
    """A worker that may keep few words forgets in time, handles small slices and gives equal rows."""
    import random

    import public_tokenizers

    from coppice.llm import packing, tokens

    r = random.Random(5)
    rows = [(i, " ".join(f"word{r.randrange(4000)}" for _ in range(300))) for i in range(120)]
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = packing.token_pieces(docs, path).collect()
    assert sorted(packing.token_pieces(docs, path, remember=20_000, at_once=5_000).collect()) == sorted(want)
    enc = tokens.Encoder(open(path, encoding="utf-8").read(), "word", 20_000)
    for _, text in rows:
        enc.encode([text])
        held = sum(tokens.ENTRY + len(p) + len(ids) for p, ids in enc.first.young.items())
        assert held == enc.first.size < 20_000 + 300 * 220 and len(enc.first.old) < 600
