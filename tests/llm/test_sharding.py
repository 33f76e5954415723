"""Shard placement: growth, confinement, slots, checksums."""

import zlib
from collections import Counter

from evalspark.llm import sharding

TREE = sharding.even_tree(40)


def placed(spark, ids, tree, prefix=""):
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: (r[1], r[2], r[3]) for r in sharding.place(docs, tree, prefix=prefix).collect()}


def test_tree_shape():
    assert [(x.region, x.rack) for x in TREE][::5] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)]


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = range(20_000)
    before, after = placed(spark, ids, TREE), placed(spark, ids, sharding.grown(TREE))
    moved = {i for i in ids if before[i] != after[i]}
    assert {after[i][2] for i in moved} == {40} and 300 < len(moved) < 700
    sizes = Counter(v[2] for v in before.values())
    assert set(sizes) == set(range(40)) and 350 < min(sizes.values()) and max(sizes.values()) < 650


def test_changed_weights_move_rows_only_between_changed_subtrees(spark):
    ids = range(5_000)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 7 else 1.0) for x in TREE]
    before, after = placed(spark, ids, TREE), placed(spark, ids, heavier)
    for i in ids:
        if before[i] != after[i]:
            assert after[i][0] == 0  # only into the region that grew
            if before[i][0] == 0:
                assert after[i][1] == 1
                if before[i][1] == 1:
                    assert after[i][2] == 7


def test_slots_are_gapless_and_rows_complete(spark):
    rows = [(i if i % 7 else None, "text é %d" % (i % 50) if i % 11 else None) for i in range(3_000)] + [(5, "same")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.with_slots(sharding.place(sharding.with_size(docs), TREE)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, shard int")
    assert sharding.with_slots(sharding.place(sharding.with_size(docs), TREE)).count() == 0
