"""Quality metrics against loops over words and lines."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "the cat and the dog " * 30, "# $ % & | < > *" * 3, "x\nx\n\nx\ny\n y",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z", "à é ü " * 20, "x " * 3000, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 z", "- a\n- b\n* c\nmore...",
]


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def measured(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.judge(docs).orderBy("doc_id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows], rows


def test_metrics(spark):
    got, rows = measured(spark, TEXTS)
    assert got == [brute(t) for t in TEXTS]
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.failed_rules) and not (r.kept and r.base_failed)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\r|é\u0085 ", max_size=60), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    assert measured(spark, texts)[0] == [brute(t) for t in texts]


def test_keep_returns_own_columns_of_all_rows(spark):
    clean = "the quick brown fox and the lazy dog went to the river in the morning"
    rows = [(1, clean, 7), (1, clean, 7), (None, clean, None), (2, "short", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert sorted(map(tuple, quality.keep(docs).collect()), key=str) == sorted(rows[:3], key=str)
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(docs.limit(0)).count() == 0


def test_filter_stays_above_the_windows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality.judge(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("xxhash64")[0]
    assert plan.count("xxhash64(") == 1 and "Filter" in top


def test_own_table_of_rules(spark):
    docs = spark.createDataFrame([(1, "word " * 5 + " ".join(f"x{i}" for i in range(20)))], "doc_id long, text string")
    row = quality.judge(docs, [quality.Rule("long", "n_words", lower=100)]).select(F.array_join("failed_rules", ",").alias("f"), "kept").first()
    assert (row.f, row.kept) == ("long", False)
