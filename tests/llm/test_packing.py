"""Packing: every document comes back id by id, sequences fit, and few places stay empty."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evalspark.llm import packing

WHOLE = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
WHOLE.encode_special_tokens = True
ODD = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a  b", "a\tb", "a\t", "\ta c", "a \nb", "a\n b", "x y z", "é́ ñ", "日本 語\n漢字", "don't 'll 's", "a\x1cb c", "\x85a b", "a\r\nb", "👍🏽 ok", "1,234.5 €", "foo\nbar baz\n", "foo\nbar baz ", "<|endoftext|> a", " a b　c"]


def ids_of(text):
    return np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_cached_words_equal_the_tokenizer():
    rnd = random.Random(2)
    encoder = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    alphabet = ["a", "Bc", "é", "語", " ", " ", "\n", "'s", "12", ".", "\t", " ", "<|endoftext|>"]
    for text in ODD + ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(3000)]:
        assert encoder.ids(text).tolist() == ids_of(text).tolist(), repr(text)


def test_cut_fills_classes():
    for tokens in range(1, 9000):
        pieces = packing.cut(tokens)
        assert sum(size for size, _ in pieces) == tokens
        for size, k in pieces:
            assert size * k <= 2048 and (not k or k == packing.CLASSES or size * k >= 0.94 * 2048)
            assert k or size <= 2048 // (packing.CLASSES + 1)


def test_round_trip(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta\n"], k=rnd.choice([1, 5, 60, 300, 900, 4000]))) for _ in range(150)] + [None, *ODD]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(docs).toPandas()
    for doc, pieces in got.groupby("doc_id"):
        ids, at = ids_of(texts[doc]), 0
        for p in pieces.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert got["doc_id"].nunique() == len(rows)
    used = 0
    for _, sequence in got.groupby("sequence_id"):
        at = 0
        for p in sequence.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= 2048
        used += at
    assert used / (2048 * got["sequence_id"].nunique()) > 0.9


def test_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "same"), (3, "same"), (1 << 60, None)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 3, 3, 1 << 60]
    assert packing.pack(docs.limit(0)).count() == 0
