import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.functions import overlap
from evalspark.operators import graphs, validation
from evalspark.operators.joins import lookup_join
from evalspark.operators.placed import beside, place
from evalspark.session import scratch_root


def random_texts(rng, groups, alphabet=None):
    alphabet = alphabet or rng.choice(["ab", "abcd", "abcdefghij "])
    texts = set()
    for _ in range(groups):
        size = rng.choice([1, 3, 5, 8, 20, 60, 200, 900])
        base = "".join(rng.choice(alphabet) for _ in range(size))
        if rng.random() < 0.2:
            base = (base[:3] or "a") * (size // 3 + 1)
        texts.add(base)
        for _ in range(3):
            left, right = rng.randint(0, max(1, size // 6)), rng.randint(0, max(1, size // 12))
            texts.add("".join(rng.choice(alphabet) for _ in range(left)) + base + "".join(rng.choice(alphabet) for _ in range(right)))
    return sorted(t for t in texts if t.strip() == t and t)


def contained_pairs(texts):
    return {
        (i, j) for i, s in enumerate(texts) for j, t in enumerate(texts)
        if len(s) < len(t) and s in t and len(s) / len(t) > 0.8
    }


def close(a, b):
    short, long = sorted((a, b), key=len)
    return a == b or (short in long and len(short) / len(long) > 0.8)


def greedy(items):
    kept = []
    for ord_value, text in items:
        near = any(close(text, k) for _, k in kept)
        if not near:
            kept.append((ord_value, text))
    return {o for o, _ in kept}


@pytest.mark.parametrize("seed", range(60))
def test_block_keys_miss_no_pair(seed):
    rng = random.Random(seed)
    texts = random_texts(rng, 10)
    position = {t: i for i, t in enumerate(texts)}
    shapes, found, tried = {}, set(), 0
    anchors = [overlap.text_keys(t) for t in texts]
    for text, own in zip(texts, anchors):
        a = own[0]
        assert a.contained and not any(x.contained for x in own[1:])
        shapes.setdefault((*a[1:3], a.left_first, a.lefts[0], a.right_first, a.rights[0]), set()).add((a.pos, len(text)))
    for j, own in enumerate(anchors):
        for a in own[1:]:
            for i, left in enumerate(a.lefts):
                for k, right in enumerate(a.rights):
                    for q, length in shapes.get((*a[1:3], a.left_first + i, left, a.right_first + k, right), ()):
                        start = a.pos - q
                        if start >= 0 and start + length <= len(texts[j]) and length < len(texts[j]) and 5 * length > 4 * len(texts[j]):
                            tried += 1
                            piece = texts[j][start : start + length]
                            if piece in position:
                                found.add((position[piece], j))
    assert found == contained_pairs(texts)
    # About ten keys per text; only texts repeating a short period need one per possible offset.
    assert all(len(own) <= 30 + len(t) // 2 for own, t in zip(anchors, texts))


def test_sides_of_a_block_are_roots_of_its_length():
    rng = random.Random(3)
    for size in (10, 100, 1000, 10_000):
        text = "".join(rng.choice("abcdefgh ") for _ in range(size))
        for a in overlap.text_keys(text)[1:]:
            assert len(a.lefts) <= 2 + size**0.5 and len(a.rights) <= 2 + size**0.5


def _near_copies(count, body, seed):
    """One body with heads and tails of any length, so that nearly every text has a length of its own."""
    rng = random.Random(seed)

    def word(most):
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, most)))

    return sorted({word(len(body) // 12) + body + word(len(body) // 12) for _ in range(count)})


def test_candidates_grow_with_the_texts(spark):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000)).strip()
    tried = {}
    for count in (400, 800):
        texts = [*_near_copies(count, body, 1), body]
        df = spark.createDataFrame(list(enumerate(texts)), "ord long, norm string").repartition(4)
        tried[count] = validation.candidate_spans(df).count()
        if count == 400:
            pairs = {(r["short_ord"], r["long_ord"]) for r in validation.near_duplicate_pairs(df).collect()}
            assert pairs == contained_pairs(texts)
            assert len(pairs) >= 350
    assert tried[800] <= 2.2 * tried[400] and tried[800] < 4 * 800


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_pairs_and_resolution(spark, seed):
    texts = random_texts(random.Random(seed), 25, "abc ")
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, norm string").repartition(5)
    pairs = validation.near_duplicate_pairs(df)
    got = {(r["short_ord"], r["long_ord"]) for r in pairs.collect()}
    assert got == contained_pairs(texts)
    dropped = {r["ord"] for r in validation.resolve_keep_first(pairs).collect()}
    assert set(range(len(texts))) - dropped == greedy(list(enumerate(texts)))


@pytest.mark.parametrize("most", [0, 2])
def test_near_pairs_by_sides(spark, monkeypatch, most):
    monkeypatch.setattr(validation, "MOST_SHAPES", most)
    body = "".join(random.Random(5).choice("abcdefgh") for _ in range(600))
    texts = sorted({*random_texts(random.Random(4), 25, "abc "), *_near_copies(60, body, 6), body})
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, norm string").repartition(5)
    assert {(r["short_ord"], r["long_ord"]) for r in validation.near_duplicate_pairs(df).collect()} == contained_pairs(texts)


def test_facts_come_to_the_texts(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "ord long, norm string").repartition(7)
    placed = place(texts, "norms")
    chosen = placed.filter("ord % 3 = 0").selectExpr("row", "ord * 10 AS v")
    facts = chosen.unionAll(chosen.selectExpr("row", "v + 1")).repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        schema = pa.schema([("ord", pa.int64()), ("norm", pa.string()), ("vs", pa.list_(pa.int64()))])
        found = beside(placed, facts, lambda row, order, text, known: [(order, text, sorted(k["v"] for k in known))], schema)
        assert sorted(map(tuple, found.collect())) == [(i, f"text {i}", [i * 10, i * 10 + 1]) for i in range(0, 200, 3)]
        assert beside(placed, facts.limit(0), lambda *_: [], schema).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def _folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file:")) for f in names)


def test_kept_items_take_little_scratch(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)).strip() for _ in range(300)]
    rows = [*enumerate(texts), *((300 + i, f"src {t} copy") for i, t in enumerate(texts))]
    df = spark.createDataFrame(rows, "ord long, prompt string").repartition(4)
    before = _folder_bytes(scratch_root(spark))
    assert sorted(r["ord"] for r in validation.deduplicate(df).select("ord").collect()) == list(range(300))
    # Letters of nine kinds take four tenths of a byte at least; neither the items nor the sides of blocks are written.
    assert _folder_bytes(scratch_root(spark)) - before < 0.75 * sum(len(t) for _, t in rows)


def test_texts_are_not_shuffled_for_their_spans(spark):
    texts = ["a b c d e f g h i j k l", "x a b c d e f g h i j k l", "other"]
    spans = validation.candidate_spans(spark.createDataFrame(list(enumerate(texts)), "ord long, norm string"))
    assert [tuple(r)[:3] for r in spans.collect()] == [(1, 2, 23)]
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_deduplicate_with_repeated_and_missing_numbers(spark):
    long = "tell me about the first of all things"
    rows = [(1, long), (1, "another"), (1, "Another!"), (2, f"{long} now"), (2, "a third"), (None, "a third"), (None, f"{long} then"), (4, "last")]
    df = spark.createDataFrame(rows, "ord long, prompt string").repartition(3)
    kept = sorted((r["ord"] or 0, r["prompt"].lower().strip("!")) for r in validation.deduplicate(df).collect())
    # Both rows with the number of a dropped one go; rows without a number are dropped only as copies.
    assert kept == [(0, "a third"), (0, f"{long} then"), (1, "another"), (1, long), (4, "last")]


def test_group_of_near_copies_is_not_paired(spark):
    # A third of all texts share all but a serial number: blocks are full, yet only real pairs come out.
    shared = "the quick brown fox jumps over the lazy dog and runs far away from the house " * 3
    texts = [f"{shared}{i:05d}" for i in range(400)] + [shared.strip()] + [f"other text number {i} {'x' * i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, norm string")
    pairs = {(r["short_ord"], r["long_ord"]) for r in validation.near_duplicate_pairs(df).collect()}
    assert pairs == contained_pairs(texts)


def test_deduplicate_keeps_first(spark):
    prompts = ["What is A?", "what is a", "Tell me about B", "Tell me about B!", "tell me about bb", "Unrelated question here"]
    df = spark.createDataFrame(list(enumerate(prompts)), "ord long, prompt string").repartition(3)
    norms = ["what is a", "what is a", "tell me about b", "tell me about b", "tell me about bb", "unrelated question here"]
    assert {r["ord"] for r in validation.deduplicate(df).collect()} == greedy(list(enumerate(norms))) == {0, 2, 5}


@pytest.mark.parametrize("seed", range(3))
def test_resolution_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(rng.randint(5, 60))}
    kept, neighbours = [], {}
    for a, b in edges:
        neighbours.setdefault(b, set()).add(a)
    for node in range(40):
        if not neighbours.get(node, set()) & set(kept):
            kept.append(node)
    pairs = spark.createDataFrame(list(edges), "short_ord long, long_ord long")
    dropped = {r["ord"] for r in validation.resolve_keep_first(pairs).collect()}
    assert dropped == set(range(40)) - set(kept)


def _jobs(spark, fn):
    """How many jobs ``fn`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        fn()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_long_chain_takes_few_jobs(spark):
    def run(length):
        chain = spark.range(length).select(F.col("id").alias("short_ord"), (F.col("id") + 1).alias("long_ord"))
        assert {r["ord"] for r in validation.resolve_keep_first(chain).collect()} == set(range(1, length + 1, 2))

    short, long = _jobs(spark, lambda: run(300)), _jobs(spark, lambda: run(5000))
    assert long <= short + 60


def test_components_in_shuffled_order(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**9), 900)
    links = [(names[i], names[i + 1]) for i in range(600)] + [(names[700], names[i]) for i in range(701, 800)] + [(names[i], names[i + 1]) for i in range(850, 890, 2)]
    links = [tuple(sorted(x)) for x in links]
    df = spark.createDataFrame(links, "earlier long, later long").repartition(7)
    found = {(r["earlier"], r["later"]): r["component"] for r in graphs.with_component(df).collect()}
    line, star = min(names[:601]), min(names[700:800])
    assert found == {x: line if x[0] in names[:601] else star if x[0] in names[700:800] else x[0] for x in links}


def test_large_components_by_rounds(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    df = spark.createDataFrame(list(edges), "earlier long, later long")
    by_pass = {r["ord"] for r in graphs.drop_linked_to_kept(df).collect()}
    assert {r["ord"] for r in graphs.drop_linked_to_kept(df, pass_links=3).collect()} == by_pass
    assert graphs.drop_linked_to_kept(df.limit(0)).count() == 0


ITEM = "ord long, prompt string, source_location string, category string, grounding_confidence string, assertions array<string>"


def items(spark, rows):
    return spark.createDataFrame([(i, *r, []) for i, r in enumerate(rows)], ITEM)


def test_validation_result(spark):
    rows = [(f"Question number {'abcdefgh'[i] * 9}?", f"f:row {i}", "single_record_lookup", "high") for i in range(3)]
    rows.append((rows[0][0], "f:row 9", "single_record_lookup", "high"))
    found = validation.validate_items(items(spark, rows), 100)
    result = found.result.first()
    assert (result["total_items"], result["duplicates_removed"], result["passed"]) == (3, 1, False)
    issues = [r["issue"] for r in found.issues.orderBy("pos").collect()]
    assert issues[0] == "Removed 1 duplicate question(s)"
    assert 'Category "single_record_lookup" is over-represented (100% vs 30% target)' in issues
    balance = {r["category"]: r["items"] for r in validation.category_balance(found.items).collect()}
    assert balance["single_record_lookup"] == 3 and balance["filtered_find"] == 0 and len(balance) == 6


def test_low_coverage_and_confidence(spark):
    rows = [(f"Completely different {'pqrstuvwxy'[i] * 12}", "f:row 1", "temporal", "low") for i in range(10)]
    result = validation.summarize(items(spark, rows), F.lit(10), F.lit(1000)).first()
    assert result["coverage_score"] == 0.05
    assert "Low source coverage (5%) — questions reference too few records" in result["issues"]
    assert "10 question(s) have low grounding confidence" in result["issues"]


def test_empty_item_set(spark):
    result = validation.summarize(items(spark, []), F.lit(0), F.lit(0)).first()
    assert result["coverage_score"] == 0 and result["total_items"] == 0


def test_lookup_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else ("k%d" % i if i % 2 else None)) for i in range(60)], "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, v int")
    for how in ("left", "inner"):
        want = rows.join(lookup, "key", how).select("id", "key", "v")
        got = lookup_join(rows, lookup, "key", how)
        assert got.columns == ["id", "key", "v"]
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
