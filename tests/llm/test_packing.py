"""Packing: every id once, gapless sequences, ids equal to the tokenizer file's own."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from valuemesh.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "<|endoftext|>", "x<|endoftext|> y  <|endoftext|>", "  \n\t x y  ", "don't WE'LL 'RE", "é😀́ 123 ½ Ⅷ", "a" * 3000, "\x00\x01", "ÀÉ العربية 漢字かな", "  lead", "trail  ", "\r\n\r\n"]


def test_encoder_equals_tokenizer_file(spark):
    own, given = packing.load_encoder(PATH), Tokenizer.from_file(PATH)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*(t for t in ODD if t is not None), *docs]:
        assert own(t).tolist() == given.encode(t, add_special_tokens=False).ids, t[:80]


def check(rows, texts, capacity=1024):
    given = Tokenizer.from_file(PATH)
    ids = {i: np.array([*given.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    seen, seqs = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(x)
    pad = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_packing_is_exact_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema)
    every = docs.union(odd)
    texts = {r.doc_id: r.text for r in every.collect()}
    assert check(packing.op2_packing(every, PATH).collect(), texts) == 0
    assert packing.op2_packing(every.limit(0), PATH).count() == 0


def test_balance_prefers_the_cheapest_bin():
    got = packing.balance(np.array([600, 500, 400, 300, 248]), 1024)
    # 600 | 500, then 400 to the cheaper second, 300 to the first; 248 fits nowhere whole and is cut
    bins = {}
    for i, _, n, b in got:
        bins.setdefault(b, []).append((i, n))
    assert sorted(sorted(b) for b in bins.values()) == [[(0, 600), (3, 300), (4, 124)], [(1, 500), (2, 400), (4, 124)]]


def test_long_white_space():
    import tokenizers

    own = tokenizers.Tokenizer.from_file(PATH)
    encode = packing.load_encoder(PATH)
    for text in (" " * 2_000_000, "a" + "\n" * 1_500_000 + "b", "x " + " \t\n" * 400_000 + "y  z"):
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
