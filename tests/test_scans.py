"""Scans that cut, sniff or prune files: JSON records, first records, parts of profiles, rows of references, streams."""

import json
import os
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from evalspark.functions.archives import workbook_rows
from evalspark.operators import grounding, incremental_profile, profiling
from evalspark.plans import fixtures
from evalspark.sources import evalfiles, files, jsonscan, sniff
from evalspark.streaming import incremental


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records and strings cross them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def some_value(rnd, depth=0):
    draw = rnd.random()
    if draw < 0.3:
        return rnd.choice(["a}b", '{"x"', "\\", "]", '"', "é{", "\n}", '\\"}', "x" * 30])
    if draw < 0.5:
        return rnd.randint(0, 99)
    if draw < 0.7 and depth < 3:
        return [some_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    if depth < 3:
        return {rnd.choice("abc}"): some_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    return None


def test_records_of_split_documents(small_splits, tmp_path):
    rnd = random.Random(1)
    documents = {}
    for i in range(8):
        rows = [{"id": n, "v": some_value(rnd)} for n in range(rnd.choice([0, 1, 2, 60]))]
        text = json.dumps(rows, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5)
        documents[f"a{i}.json"] = rows, text + rnd.choice(["", "\n", " "])
    for i in range(4):
        rows = [{"id": n, "v": some_value(rnd)} for n in range(rnd.choice([1, 2, 40]))]
        documents[f"l{i}.json"] = rows, "\n".join(map(json.dumps, rows)) + rnd.choice(["", "\n", "\n\n"])
    documents["one.json"] = [{"a": {"b": "}"}}], json.dumps({"a": {"b": "}"}}, indent=2)
    documents["blank.json"] = [], " \n"
    for name, (_, text) in documents.items():
        (tmp_path / name).write_text(text)
    records = jsonscan.json_records(small_splits, [str(tmp_path / n) for n in documents])
    got = {}
    for r in records.orderBy("path", "pos").collect():
        got.setdefault(os.path.basename(r.path), []).append((r.pos, json.loads(r.text)))
    for name, (rows, _) in documents.items():
        assert got.get(name, []) == list(enumerate(rows)), name


BROKEN = [
    "[1, 2]", '[{"a":1} {"a":2}]', '[{"a":7}] {"a":8}', '[{"a":1}', '{"a":1', '{"a":{"b":1}', "5", '[{"a":1},]', '[[{"a":1}]]', '{"a":1} {"a":2}',
    '{"a":1}\n{"a":', '[{"a":1}]]', '{"a":1}}', '[{"a":1},{"b":2},3]', '[{"a":1}}',
]


def test_broken_documents_are_refused(spark, tmp_path):
    for i, text in enumerate(BROKEN):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(ValueError):
            files.read_json_documents(spark, str(tmp_path / f"{i}.json"))


def test_one_array_is_read_without_whole_files_or_python(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i, "b": {"c": "}"}} for i in range(50)]))
    df = files.read_json_documents(spark, str(tmp_path / "a.json"))
    plan = df._jdf.queryExecution().toString().lower()
    assert "python" not in plan and "arrow" not in plan and "wholetext" not in plan
    assert [r["a"] for r in df.collect()] == list(range(50))


def test_workbook_rows_stream_in_bounded_memory():
    count = 500_000
    body = "".join(f'<row><c><v>{i}</v></c><c t="s"><v>{i % 1000}</v></c></row>' for i in range(-1, count)).replace("<v>-1</v>", '<v>0</v>')
    entries = {
        "xl/workbook.xml": fixtures._WORKBOOK, "xl/_rels/workbook.xml.rels": fixtures._RELATIONS, "xl/worksheets/sheet1.xml": fixtures._SHEET.format(body),
        "xl/sharedStrings.xml": f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{"".join(f"<si><t>text {i}</t></si>" for i in range(1000))}</sst>',
    }
    content = fixtures._zip(entries)
    del body, entries
    seen = 0
    tracemalloc.start()
    try:
        for row in workbook_rows(content):
            seen += 1
            if seen % 250_000 == 0:
                assert row["text 999"] == f"text {(seen - 1) % 1000}"
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
    assert seen == count


def jobs(spark, fn):
    group = f"group-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_headers_of_many_files_in_few_jobs(spark, tmp_path):
    for i in range(500):
        (tmp_path / f"{i}.csv").write_text(("a,b\n1,2\n" if i % 2 else "\n b , a\n1,2\n") if i else "")
    found = []
    listed = files.listing(spark, str(tmp_path))
    assert jobs(spark, lambda: found.extend(files.header_groups(listed).collect())) <= 3
    assert sorted((tuple(r.cells), r.n) for r in found) == [(("a", "b"), 250), (("b", "a"), 249)]
    rows = files.read_dataset(spark, str(tmp_path)).collect()
    assert len(rows) == 499 and {(r["a"], r["b"]) for r in rows} == {("1", "2"), ("2", "1")}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a,b\n1,2\n", ["a", "b"]), ('\n,\n" a\nb ",c\r\n1,2', ["a\nb", "c"]), ("", []), ("﻿x;y\nz", ["x;y"]), ('"a""b",c', ['a"b', "c"]),
    ],
)
def test_first_record(text, want):
    assert sniff.first_record(text.encode(), True, ",") == want
    assert sniff.first_record(text.encode()[:3], False, ",") is None


def test_first_records_where_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("prompt,expected_answer,source_location\nq,e,s\n")
    monkeypatch.setattr(sniff, "_reachable", lambda path: False)
    assert [r["prompt"] for r in evalfiles.read_eval_rows(spark, str(tmp_path), "csv").collect()] == ["q"]


def test_profile_by_parts(spark, tmp_path):
    source, store = str(tmp_path / "data"), str(tmp_path / "parts")
    rows = spark.range(40_000).select(
        "id", (F.col("id") * 0.5).alias("half"), F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 4 > 0, "x").alias("some"),
        F.to_date(F.lit("2024-01-01")).alias("day"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, "1").otherwise("w").alias("mix"),
    )
    rows.filter("id < 10000").repartition(3).write.parquet(source)
    assert incremental_profile.update_profile(spark, source, store) == 3
    rows.filter("id >= 10000").repartition(2).write.mode("append").parquet(source)
    assert incremental_profile.update_profile(spark, source, store) == 2
    assert incremental_profile.update_profile(spark, source, store) == 0
    got = {r.field: r for r in incremental_profile.profile_of_store(spark, store).collect()}
    want = {r.field: r for r in profiling.profile_columns(spark.read.parquet(source)).collect()}
    assert list(got) == list(got) and got.keys() == want.keys()
    for name, w in want.items():
        g = got[name]
        assert (g.data_type, g.null_count, g.total_count, g.min, g.max) == (w.data_type, w.null_count, w.total_count, w.min, w.max), name
        assert abs(g.about_unique - w.unique_count) <= 0.05 * w.unique_count
    for g, share in zip(got["half"].about_quartiles, (0.25, 0.5, 0.75)):
        assert abs(g / 20_000 - share) < 0.03
    assert got["key"].about_quartiles is None


def test_references_read_their_files_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).withColumn("v", F.col("id") * 7).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    scan = spark.read.parquet(path)
    wanted = spark.createDataFrame([(3,), (3,), (5,), (998,), (5000,), (-1,)], "row_index long")
    found = grounding.referenced_rows(scan, wanted)
    assert sorted(tuple(r) for r in found.collect()) == [(3, 21, 3), (5, 35, 5), (998, 6986, 998)]
    assert len({f for f in found.inputFiles() if f.startswith("file:" + path) or path in f}) == 2
    every = grounding.referenced_rows(scan, spark.range(1000).select(F.col("id").alias("row_index")), most_files=2)
    assert every.count() == 1000 and every.filter("id <> row_index").count() == 0
    assert grounding.referenced_rows(scan, wanted.filter("row_index < 0")).count() == 0


def test_rows_sent_again_are_scored_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def score(rows):
        @F.udf("int")
        def scored(ord_value):
            with open(os.path.join(calls, f"{ord_value}-{time.time_ns()}"), "w"):
                return 50

        return rows.withColumn("similarity_score", scored("ord"))

    schema = "ord long, prompt string, expected_answer string, actual_answer string, assertions array<struct<type:string,value:string,values:array<string>,whole_word:boolean>>, sent timestamp"
    source = str(tmp_path / "in")

    def send(first, last):
        rows = [(i, "p", "e", "a", [], None) for i in range(first, last)]
        df = spark.createDataFrame(rows, schema).withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord")))
        df.coalesce(1).write.mode("append").parquet(source)
        return df.schema

    for name, more in (("all", {}), ("horizon", {"event_time": "sent", "horizon": "1 hour"})):
        target, state = str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")
        for span in ((0, 6), (3, 9)):
            kind = send(*span)
            out = incremental.score_stream(spark, source, kind, target, state, score=score, key="ord", **more)
        assert sorted(r["ord"] for r in out.collect()) == list(range(9))
