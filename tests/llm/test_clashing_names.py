"""Columns of the caller whose names are those that operators use themselves, in any case."""

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from evalspark.llm import decontamination, digest_merge, quality, sharding, warc

TEXT = "one two three four five six seven eight nine ten eleven twelve"
NAMES = ["_words", "_length", "_scan", "_rank", "_part", "_pos", "_offset", "_row", "row", "scan", "shard_", "part", "pos", "rank", "n", "offset"]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (None, "")], "doc_id long, text string")
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def own(rows):
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)


def test_quality(spark, docs):
    rows = quality.judge(docs.withColumn("N_WORDS", F.lit("own"))).collect()
    own(rows)
    assert sorted(r.n_words for r in rows) == [0, 0, 12] and len(quality.keep(docs, rules=()).columns) == len(docs.columns)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("i", TEXT)], "item_id string, text string")
    rows = decontamination.decontaminate(docs.withColumn("N_HIT", F.lit("own")), items).collect()
    own(rows)
    assert sorted((r.n_hit, r.contaminated) for r in rows) == [(0, False), (0, False), (12, True)]
    assert sorted(map(str, (r.doc_id for r in decontamination.clean(docs, items).collect()))) == ["2", "None"]


def test_slots(spark, docs):
    rows = sharding.with_slots(docs.withColumn("shard", F.lit(3))).collect()
    own(rows)
    assert sorted(r.slot for r in rows) == [0, 1, 2] and {r.shard for r in rows} == {3}


def test_exact_groups(spark, docs):
    assert sorted(r.group_size for r in digest_merge.groups(docs, least_rounds=1).collect()) == [1, 2, 2]


def test_a_repeated_task_publishes_again(tmp_path):
    fs = pyarrow.fs.LocalFileSystem()
    for attempt in "ab":
        (tmp_path / f"x.{attempt}").write_text("same")
        warc._publish(fs, str(tmp_path / f"x.{attempt}"), str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "same"
