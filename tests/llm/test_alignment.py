"""Alignment of two tokenizers: every document against intervals compared byte by byte with the files the contract names."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalspark.llm import alignment

A = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
ODD = [
    "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a  b", "a\tb", "a\t", "\ta c", "a \nb", "a\n b", "x y z", "é́ ñ", "日本 語\n漢字",
    "don't 'll 's", "a\x1cb c", "\x85a b", "a\r\nb", "a;\rb", "👍🏽 ok", "1,234.5 €", "foo\nbar baz\n", "<|endoftext|> a", "<s> </s> <unk> <0x41>",
    " a b　c", "▁", "a▁b", "a ▁b", "aaaa aaa aaaaaaa", "\x00 \x01", "a﻿b", "ﬁ ½ ①", "x" * 5000, "ab " * 3000 + "c",
]
BYTE_OF = {}


def _byte_table():
    """The printable characters that stand for bytes in the first vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def bytes_a(i):
    BYTE_OF.update(BYTE_OF or _byte_table())
    return bytes(BYTE_OF[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def tokens(text):
    if not text:
        return [], []
    a = [(i, bytes_a(i)) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes_b(i)) for i in B.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(ids):
    at, out = 0, []
    for i, x in ids:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        owner = {}
        for n, (_, s, e) in enumerate(b):
            owner.update(dict.fromkeys(range(s, e), n))
        links = [(i, b[n][0]) for i, s, e in a for n in sorted({owner[x] for x in range(s, e)})]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= cut) for side in (a, b)) if len(cuts) < 2000 else "")
            before = cut
        counts.update(links)
        per.append((len(a), len(b), len(groups), links, groups))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for n_a, n_b, n_groups, links, groups in per:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest if len(groups) < 2000 else None))
    return out, counts, best


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = ["a", "Bc", "é", "語", " ", " ", " ", "\n", "'s", "12", ".", "\t", "\r", " ", "tion", "the", "▁", "ﬁ", "<s>", "ing", "\x00", "🏽"]
    weights = [6] * len(alphabet)
    weights[alphabet.index("▁")] = 1
    return ["".join(rnd.choices(alphabet, weights, k=rnd.randrange(30))) for _ in range(n)]


def test_words_equal_whole_texts():
    texts = alignment.lookup(*alignment._paths(None, None))
    for text in ODD + random_texts(4000, 1):
        a, b = tokens(text)
        got = texts.align(text)
        assert (got.n_a, got.n_b) == (len(a), len(b)), repr(text)
        if a:
            groups = got.groups.split(";")
            assert len(groups) == got.n_groups
            assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == [i for i, _ in a], repr(text)
            assert [int(i) for g in groups for i in g.split("|")[1].split(",")] == [i for i, _ in b], repr(text)


def test_identity_map_holds_equal_bytes():
    v = alignment.lookup(*alignment._paths(None, None)).vocabularies
    assert all(bytes_a(i) == v.bytes_a[i] for i in range(len(v.bytes_a)))
    assert all(bytes_b(i) == v.bytes_b[i] for i in range(3, len(v.bytes_b)))
    assert all(j < 0 or v.bytes_b[j] == v.bytes_a[i] for i, j in enumerate(v.identity))
    assert sum(v.identity >= 0) > 10_000
    pieces = set(v.bytes_b[3:])
    assert not any(j < 0 and x in pieces for j, x in zip(v.identity, v.bytes_a))


@pytest.mark.parametrize("block_links", [1 << 20, 200])
def test_every_link_counted(spark, monkeypatch, block_links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block_links)
    texts = [None, *ODD, *random_texts(400, 2), "the same text again"] + ["the same text again"] * 150
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_best int").repartition(5)
    got = {r.doc_id: r for r in alignment.align(docs).collect()}
    want, counts, best = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], repr(texts[i])
        assert w[6] is None or r.groups_sha256 == w[6], repr(texts[i])
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs).collect()}
    assert pairs == {x: (n, n == best[x[1]]) for x, n in counts.items()}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b"), (3, "same"), (3, "same"), (1 << 60, None), (5, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted([tuple(r) for r in alignment.align(docs).collect()], key=repr)
    want, _, _ = brute([t for _, t in rows])
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=repr)
    assert alignment.align(docs.limit(0)).count() == 0
    assert alignment.align(docs.filter("doc_id = 5")).collect()[0].n_a == 0
