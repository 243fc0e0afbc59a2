"""Token ids against encoding whole texts at once."""

import random

import pytest

from quartzfold.llm.encode import blocks, concatenate, encode_corpus, join, tokenizer

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PARTS = ["abcdefghij", " ", "'", "s", "t", "re", "ll", "\n", "\t", "1", "23", "é", "中文字", "!?", "😀", "  ", "ing", "<|endoftext|>"]


def test_joins_give_the_ids_of_the_whole():
    t, draw = tokenizer(RANKS), random.Random(1)
    for _ in range(1500):
        some = draw.sample(PARTS, draw.choice([1, 3, 8, len(PARTS)]))
        text = "".join(draw.choice(draw.choice(some)) if draw.random() < 0.7 else draw.choice(some) for _ in range(draw.randint(1, 400)))
        wanted = t.encode_ordinary(text)
        found = blocks(text, draw.choice([3, 7, 20, 50]))
        assert "".join(b for b, _ in found) == text
        assert concatenate([(t.encode_ordinary(b), j) for b, j in found], t) == wanted
        cut = sorted(draw.sample(range(len(text) + 1), min(5, len(text))))
        parts = [text[i:j] for i, j in zip([0, *cut], [*cut, len(text)], strict=True)]
        assert concatenate([(t.encode_ordinary(p), True) for p in parts], t) == wanted


def test_join_of_ids_that_are_no_text():
    t = tokenizer(RANKS)
    assert join([], [5], t) == [5]
    half = t.encode_ordinary("😀")
    with pytest.raises(ValueError):
        join(half[:1], half[:1], t)


def test_corpus(spark):
    t, draw = tokenizer(RANKS), random.Random(2)
    stretch = "".join(draw.choice("abcdefghijklmnop") for _ in range(9000))
    texts = [None, "", " ", "Hello world", "<|endoftext|>", stretch, "word " * 3000, "中" * 2500, stretch + " \n" * 900 + "x", "same", "same", "!" * 5000 + "'s"]
    df = spark.createDataFrame([(i if i < 10 else 9, x, [1]) for i, x in enumerate(texts)], "doc_id long, text string, ids array<int>").repartition(3)
    wanted = sorted((min(i, 9), t.encode_ordinary(x or "")) for i, x in enumerate(texts))
    assert sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df, "doc_id", "text", RANKS, block=1000).collect()) == wanted
    assert sorted((r["doc_id"], r["n_tokens"]) for r in encode_corpus(df, "doc_id", "text", RANKS, block=1000, count_only=True).collect()) == sorted((d, len(i)) for d, i in wanted)
    assert encode_corpus(df.where("false"), "doc_id", "text", RANKS).count() == 0
