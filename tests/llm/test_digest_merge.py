"""Exact duplicates: every row against groups made by a dictionary."""

import hashlib
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.llm import digest_merge


def expected(rows, largest=True, change=lambda t: t):
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(change(text or ""), []).append((key, i))
    out = []
    for text, members in groups.items():
        ids = [k for k, _ in members if k is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keep, len(members), digest) for k, _ in members]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("largest, run_rows, least", [(True, 40, 1), (False, 1 << 18, 1)])
def test_groups_equal_a_dictionary(spark, largest, run_rows, least):
    rnd = random.Random(run_rows)
    texts = ["", " ", "a", "A", "a ", "é", "é", "x" * 70_000] + [f"text {i}" for i in range(40)]
    rows = [(i, "one text of a third of the rows" if rnd.random() < 0.35 else rnd.choice([*texts, None])) for i in rnd.sample(range(10**12), 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = digest_merge.groups(docs, largest=largest, run_rows=run_rows, least_rounds=least).cache()
    assert rows_of(got) == expected(rows, largest)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got.collect()}) and all(r.doc_id == r.keep_id for r in kept)
    got.unpersist()


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "a"), (4, "a"), (4, "a"), (3, None), (9, ""), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = digest_merge.groups(docs, least_rounds=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted([(None, 4, 4), (None, 4, 4), (4, 4, 4), (4, 4, 4), (3, 9, 2), (9, 9, 2), (None, None, 2), (None, None, 2)], key=repr)
    assert sorted(((r.doc_id, r.kept) for r in got if r.kept), key=repr) == [(4, True), (9, True), (None, True)]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "t", 5, 6, "n"), (2, "t", 7, 8, "m")], "doc_id long, text string, place int, digest int, keep_id string")
    assert rows_of(digest_merge.groups(docs, least_rounds=1)) == expected([(1, "t"), (2, "t")])
    assert digest_merge.groups(docs.limit(0), least_rounds=1).count() == 0
    odd = docs.toDF("the id", "a.b", "row", "whole", "n")
    assert digest_merge.groups(odd, key="the id", text="a.b", least_rounds=1).columns[0] == "the id"


def test_normalised_texts(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "abd")]
    got = digest_merge.groups(spark.createDataFrame(rows, "doc_id long, text string"), normalise=F.lower, least_rounds=1)
    assert rows_of(got) == expected(rows, change=str.lower)


def test_texts_equal_only_after_unicode_normalisation_differ(spark):
    rows = [(1, "é"), (2, unicodedata.normalize("NFD", "é"))]
    got = digest_merge.groups(spark.createDataFrame(rows, "doc_id long, text string"), least_rounds=1)
    assert {r.group_size for r in got.collect()} == {1}


def test_entries_move_one_digit_a_round(spark):
    df = spark.createDataFrame([(p, bytes([0, 0, 0, 0, 0, 0, d])) for p in range(64) for d in (0, 9, 37, 255)], "place long, digest binary")
    moved = df.withColumn("one", digest_merge._next_place(0)).withColumn("two", digest_merge._next_place(1)).collect()
    for r in moved:
        d = r.digest[-1] & 63
        assert r.one == (r.place & 56) | (d & 7) and r.two == (r.place & 7) | (d & 56)


def test_neighbours_fold_over_batches():
    fields = [pa.field(n, pa.binary() if n == "digest" else pa.int64(), nullable=n != "n") for n in ("place", "digest", "bytes", "check", "keep_id", "keep_row", "n")]
    rows = [(0, b"a", 1, 1, 9, 0, 2), (0, b"a", 1, 1, 7, 1, 1), (0, b"a", 1, 2, 7, 1, 1), (0, b"b", 1, 2, None, 4, 1), (1, b"b", 1, 2, 5, 5, 3), (1, b"b", 1, 2, 4, 6, 1)]
    for size in (1, 2, 3, 6):
        parts = [rows[i : i + size] for i in range(0, 6, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*p), fields)], schema=pa.schema(fields)) for p in [*parts, []] if p]
        got = [tuple(r.values()) for b in digest_merge._merge(iter(batches)) for r in b.to_pylist()]
        assert got == [(0, b"a", 1, 1, 9, 0, 3), (0, b"a", 1, 2, 7, 1, 1), (0, b"b", 1, 2, None, 4, 1), (1, b"b", 1, 2, 5, 5, 4)]
