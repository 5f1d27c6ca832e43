"""Trie-shared scores against a plain dynamic programme over every pre-token."""

import random

import public_tokenizers

from valuemesh.llm import token_counts
from valuemesh.llm.token_counts import MARK, Unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(model, text):
    import re

    pre = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    got = [model.one(MARK + w) for w in pre]
    return len(pre), sum(n for _, n in got), round(sum(s for s, _ in got), 3)


def test_counts_equal_brute_force(spark):
    model, rng = Unigram.from_sentencepiece(PATH), random.Random(1)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "  \n", "a", "é😀 漢字", "x" * 5000, "the " * 3000, "\x00 \x00a"]
    texts += ["".join(rng.choice("ab tié漢 ") for _ in range(rng.randrange(80))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_tokens int")
    got = token_counts.op10_token_counts(docs, PATH).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, toks, score = brute(model, [*texts, texts[0]][r.doc_id])
        assert (r.n_pretokens, r.n_tokens) == (n, toks)
        assert abs(r.log_prob - score) <= 0.01
    assert token_counts.op10_token_counts(docs.limit(0), PATH).count() == 0


def test_single_word_is_the_best_cut():
    model = Unigram({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"abab": -4.0})
    assert model.one(b"abab") == (-3.0, 2)
    assert model.one(b"c") == (token_counts.UNKNOWN, 1)
