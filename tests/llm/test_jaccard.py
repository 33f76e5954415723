"""Components of similar documents against a comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from evalspark.llm import jaccard, shingles
from evalspark.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_sets(texts):
    sets = []
    for text in texts:
        words = (text or "").encode().translate(shingles._LOWER).split()
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    return sets


def brute_components(rows):
    sets = brute_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(members) if members else None))
    return sorted(out, key=str)


def corpus(seed, groups=6, size=14):
    """Near copies at all distances, texts that share a passage, short texts, copies, and unrelated ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    texts = []
    for g in range(groups):
        length = rnd.choice([5, 7, 9, 12, 20, 60, 150, 400])
        words = rnd.choices(vocabulary, k=length)
        for _ in range(size):
            copy = list(words)
            for _ in range(rnd.randrange(0, max(2, length // 25) + 1)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.4:
                copy = copy[: len(copy) - rnd.randrange(0, max(1, length // 5))]
            texts.append(" ".join(copy).capitalize())
        chain = list(words)
        for _ in range(size // 2):
            chain = chain + rnd.choices(vocabulary, k=max(1, len(chain) // 6))
            texts.append(" ".join(chain))
    for _ in range(40):
        own = rnd.choices(vocabulary, k=rnd.randrange(1, 30))
        at = rnd.randrange(len(own) + 1)
        texts.append(" ".join([*own[:at], passage, *own[at:]]))
    texts += texts[:10] + ["", None, "  \n ", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted([(r.row_id, r.n, r.component_id) for r in jaccard.similar(docs).collect()], key=str)


@pytest.mark.parametrize("seed, longest", [(1, 16), (2, 3), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, longest):
    monkeypatch.setattr(jaccard, "LIST", longest)
    rows = corpus(seed)
    assert found(spark, rows) == brute_components(rows)


def test_nulls_ties_and_repeated_rows(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(None, text), (None, text), (3, text), (3, text), (None, "alone here in the text"), (5, None), (None, ""), (9, text + " again")]
    assert found(spark, rows) == brute_components(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_keep_first_keeps_one_row_and_all_columns(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(2, text, "a"), (1, text + " ", "b"), (1, text + " ", "b"), (7, "other words entirely stand here", "c"), (8, None, "d"), (8, None, "d"), (None, text, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = sorted(tuple(r) for r in jaccard.keep_first(docs).collect())
    assert [(r[0], r[2]) for r in kept] == [(1, "b"), (7, "c"), (8, "d"), (8, "d")]
    assert jaccard.keep_first(docs).columns == docs.columns


def test_pigeonhole_bound_of_every_band():
    for size in [*range(1, 400), 1000, 12345]:
        for band in jaccard.bands_of(size):
            largest = int(jaccard.LIMITS[band + 1]) - 1
            assert jaccard.segments(band, False) > (size + min(4 * size // 3, largest)) // 7
        assert 4 * size // 3 < jaccard.LIMITS[jaccard.bands_of(size)[-1] + 1]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def near_copies(seed, count=80, length=200, changes=3):
    """Copies of one text with some words changed, and as many unrelated texts."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(count):
        copy = list(base)
        for _ in range(changes if i else 0):
            copy[rnd.randrange(length)] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
        rows.append((1000 + i, " ".join(f"u{rnd.randrange(10**9)}" for _ in range(length))))
    return rows


def test_jobs_of_a_large_group(spark):
    """A group of near copies with lists longer than any other takes few jobs, as each of them costs the driver memory."""
    rows = near_copies(5)
    spark.sparkContext.setJobGroup("jaccard", "jobs of one run")
    try:
        assert found(spark, rows) == brute_components(rows)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("jaccard")) < 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_take_few_jobs(spark, tmp_path):
    """Each job of a round leaves its plan in the driver: a chain of 60 took 77 jobs by joins."""
    path = str(tmp_path / "links")
    spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").write.parquet(path)
    spark.sparkContext.setJobGroup("components", "jobs of one run")
    try:
        got = {r.node: r.component for r in components(spark.read.parquet(path)).collect()}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(61), 0)


def test_components_of_repeated_and_null_links(spark):
    links = spark.createDataFrame([(2, 1), (1, 2), (2, 1), (None, 2), (7, None), (4, 4), (-3, 9), (9, 2)], "a long, b long")
    assert sorted(tuple(r) for r in components(links).collect()) == [(-3, -3), (1, -3), (2, -3), (9, -3)]
    assert components(links.limit(0)).collect() == []


def test_no_table_of_the_corpus_is_broadcast(spark, tmp_path):
    """Tables of sets look small to Spark, which takes an array for one element: broadcast, they fill the driver."""

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    sets = table("sets", [(i, 2, bytes(32), [1, 2]) for i in range(3)], "node long, n long, sketch binary, elements array<long>")
    pairs = table("pairs", [(0, 1), (1, 2)], "a long, b long")
    lists = table("lists", [(64, 0), (64, 1)], "sig long, node long")
    labels = table("labels", [(0, 0), (1, 0)], "node long, component long")
    mixed = table("mixed", [(64, 0, 0), (64, 1, 1)], "sig long, node long, label long")
    docs = table("docs", [(1, "a b"), (2, "c d")], SCHEMA)
    measured = jaccard._measured(docs, "doc_id", "text")
    measured.write.parquet(str(tmp_path / "measured"))
    found = [
        jaccard._candidates(spark.read.parquet(str(tmp_path / "measured"))),
        jaccard._possible(pairs, sets),
        jaccard._linked(pairs, sets),
        jaccard._mixed(lists, labels),
        jaccard._across(mixed, sets),
        components(pairs),
        jaccard.keep_first(docs),
    ]
    for df in found:
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_sets_without_partners_are_not_indexed(spark):
    rows = near_copies(6, count=20)
    measured = jaccard._measured(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").localCheckpoint()
    chosen = {r.node for r in jaccard._candidates(measured).collect()}
    assert chosen == {r.node for r in measured.filter("row_id < 1000").collect()}


def test_allotted_lists_keep_a_meeting_of_linked_sets(spark):
    """In the one order of signatures each set may leave out its longest lists, and still meets every partner."""
    sets = [np.sort(np.unique(np.array([shingles.mix(np.uint64([hash(s) & (2**64 - 1)]))[0] for s in x], dtype=np.uint64))) for x in brute_sets([t for _, t in corpus(4)]) if x]
    held, own = {}, []
    for values in sets:
        for band in jaccard.bands_of(len(values)):
            signatures, spare = jaccard._signed(values, band)
            own.append((band, signatures, spare))
            for s in signatures.tolist():
                held[s] = held.get(s, 0) + 1
    places = iter(own)
    kept = []
    for values in sets:
        lists = set()
        for _ in jaccard.bands_of(len(values)):
            _, signatures, spare = next(places)
            lists |= set(sorted(signatures.tolist(), key=lambda s: (-held[s], -s))[spare:])
        kept.append(lists)
    for (x, lx), (y, ly) in combinations(list(zip(sets, kept)), 2):
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            assert lx & ly


def test_folded_sketches_never_differ_more_than_sets():
    rnd = np.random.default_rng(1)
    for n, m in [(10, 13), (250, 300), (500, 520), (2000, 2600)]:
        values = rnd.integers(0, 2**63, m).astype(np.uint64)
        one, other = values[:n], values[m - n :]
        for scale in (1, 8):
            a, b = (jaccard.parity_sketch(x, scale).view(np.uint64) for x in (one, other))
            width = min(len(a), len(b))
            a, b = (jaccard._folded(x.reshape(1, -1), width) for x in (a, b))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(one, other))


def test_pairs_of_a_long_list_are_tried_in_parts():
    """All near pairs of different labels, though a list spans batches and parts."""
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.concatenate((base[: 2990 + i % 7], rnd.integers(0, 2**63, 4).astype(np.uint64))) if i % 50 == 0 else rnd.integers(0, 2**63, 3000).astype(np.uint64) for i in range(400)]
    columns = [
        pa.array([64] * 400 + [128]),
        pa.array(range(401)),
        pa.array(range(401)),
        pa.array([len(s) for s in sets] + [5]),
        pa.array([jaccard.parity_sketch(s, 8).tobytes() for s in sets] + [b"\0" * 32]),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=["sig", "label", "node", "n", "sketch"])
    parts = [batch.slice(0, 150), batch.slice(150, 200), batch.slice(350)]
    pairs = [p for b in jaccard._pairs_in_lists(iter(parts)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(pairs) == list(combinations(range(0, 400, 50), 2))
