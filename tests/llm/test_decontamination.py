"""Hit words of documents against a search for every window."""

import random
import re

import pytest

from evalspark.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        if w and item is not None:
            windows += [(str(item), w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(12)] + ["Ünder", "x9", "日本"]
    items = [(i, " ".join(rnd.choices(v, k=rnd.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, " ,; "), (None, "w1 w2 w3"), (100, "again w1, w2!")]
    docs = []
    for i in range(60):
        text = rnd.choices(v, k=rnd.randrange(0, 40))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text) + 1)
            text[at:at] = words(rnd.choice(items)[1])[: rnd.choice([5, 30])]
        docs.append((i, rnd.choice([" ", "-", ", "]).join(text).upper() if i % 3 else " ".join(text)))
    return docs + [(None, None), (1, ""), (2, docs[3][1]), (2, docs[3][1])], items


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 300)])
def test_against_search(spark, monkeypatch, seed, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    docs, items = corpus(seed)
    got = d.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()], key=str) == brute(docs, items)


def test_clean_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "q r", None), (None, None, "z")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sorted(map(tuple, d.clean(docs, items).collect()), key=str) == [(2, "q r", None), (None, None, "z")]
    assert d.clean(docs, items.limit(0)).count() == 3 and d.clean(docs.limit(0), items).count() == 0
