"""Text files read in splits: chunks as a loop over the whole text makes them, whatever the splits and groups are."""

import random
import re

import pytest

from evalspark.operators import chunking
from evalspark.sources import files, textscan
from test_sources import loop_chunks

BREAK = re.compile(r"\n{2,}|(?=^#{1,3}\s)", flags=re.M)


def sections(text):
    return [s for s in BREAK.split(text) if s.strip()]


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def random_text(rng):
    lines = [rng.choice(["w", "é ü", "# Title", "## Part\tx", "#### four", "#none", "#", "##", " ", "", "", "x" * 120, "y" * 499, "z" * 501, "v" * 900]) for _ in range(rng.randint(1, 60))]
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n", "\n\n\n"])


def test_files_against_loop(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(textscan, "GROUP", 3)
    monkeypatch.setattr(textscan, "FAN", 2)
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(25)]
    texts += ["", "\n", "\n\n", "\nabc", "\n\nabc", "\n# a", "a\n#", "a\n#\n", "a\n\n#", "#", "# a", "a\r\n\r\nb\r\n", "\n".join("s" * (i % 7 + 1) + "\n" for i in range(400))]
    for i, text in enumerate(texts):
        (tmp_path / f"t{i}.txt").write_bytes(text.encode())
    found = textscan.chunk_text_files(spark, [str(tmp_path)])
    got = {}
    for r in found.orderBy("path", "chunk_number").collect():
        own = got.setdefault(int(re.search(r"/t(\d+)\.txt", r["path"])[1]), [])
        own.append(r["content"])
        assert r["chunk_number"] == len(own) and r["word_count"] == len(r["content"].split())
    for i, text in enumerate(texts):
        assert got.get(i, []) == loop_chunks(sections(text), "\n\n"), repr(text[:300])
    # The rule for whole texts is the same.
    whole = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by_text = {(r["id"], r["chunk_number"]): r["content"] for r in chunking.chunk_sections(whole, ["id"]).collect()}
    assert by_text == {(i, k + 1): c for i, own in got.items() for k, c in enumerate(own)}


def test_one_file_is_read_in_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.md").write_text("\n\n".join(f"paragraph {i}" for i in range(400)))
    lines = textscan._lines(spark.read, [str(tmp_path)])
    assert lines.rdd.getNumPartitions() > 3
    rows = files.read_dataset(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(len(rows))) and {r["_source_file"] for r in rows} == {"a.md"}
    assert [r["content"] for r in rows] == loop_chunks([f"paragraph {i}" for i in range(400)], "\n\n")


def test_packing_against_loop():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.choice([1, 2, 10, 19, 20, 21, 40]) for _ in range(rng.randint(1, 12))]
        packing = textscan.Packing(np.array(lengths), 20)
        fills, opened = packing.function()
        for fill in range(22):
            size, count, each = fill, 0, []
            for at, n in enumerate(lengths):
                if size == 0 or size + n > 20:
                    size, count = 0, count + 1
                size += n + textscan.GAP
                each.append(count)
            assert (fills[fill], opened[fill], packing.chunks(fill).tolist()) == (min(size, 21), count, each)
