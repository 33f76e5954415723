"""What tasks hold, read and compute again stays bounded."""

from __future__ import annotations

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.functions.batches import pieces, slices
from evalspark.operators import graphs, grounding, incremental_profile, validation
from evalspark.operators.chunking import chunk_sections
from evalspark.plans import drafts, fixtures, load_queries
from evalspark.sources import archives, evalfiles, pages, sinks, textscan


def test_pieces_close_at_their_size():
    rows = [("a", 4), ("b", 7), ("c", 1), ("d", 30), ("e", 2)]
    assert list(pieces(rows, lambda r: r[1], 10)) == [rows[:2], rows[2:4], rows[4:]]
    assert list(pieces([], lambda r: 1)) == []


def test_slices_keep_every_row_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:03}" * 100 for i in range(50)] + ["x" * 9000])], names=["t"])
    parts = list(slices([batch, batch.slice(0, 0)], 2000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.nbytes <= 2000 or p.num_rows == 1 for p in parts) and len(parts) > 8


def test_archives_are_read_in_pieces():
    rows = [(f"p{i}", "x" * 300_000) for i in range(10)]
    assert [b.num_rows for b in archives._batches(iter(rows), archives._DOCUMENTS)] == [4, 4, 2]


def test_documents_and_decks_come_back(spark):
    texts = [(1, "one two\nthree"), (2, None), (3, "long " * 90_000 + "\nend")]
    lines = spark.createDataFrame(texts, "id long, text string").select("id", F.split("text", "\n").alias("lines"))
    chunks = archives.document_chunks(fixtures.as_documents(lines)).groupBy("path").count()
    assert {(r["path"], r["count"]) for r in chunks.collect()} == {("1", 1), ("3", 2)}
    slides = archives.slide_records(fixtures.as_decks(lines)).select("path", "slide_number", "title").collect()
    assert sorted(map(tuple, slides)) == [("1", 1, "one"), ("1", 2, "three"), ("3", 1, "long"), ("3", 2, "end")]


def test_pages_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pages, "pieces", lambda rows, size: pieces(rows, size, 50))
    html = '<title>T</title><a href="/x">l</a><p>text</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table>'
    given = [(f"http://h/{i}", html) for i in range(30)] + [("http://h/none", None)]
    parsed = pages.parse_pages(spark.createDataFrame(given, "url string, html string"))
    assert pages.same_host_links(parsed).count() == 30
    assert pages.table_records(parsed).count() == 30
    assert parsed.filter("url = 'http://h/none'").select("title", "links").first() == ("", [])


def test_assertions_of_very_many_facts(spark):
    """Facts are told apart by hashes and looked up only until there are enough."""
    words = [f"w{i}word" for i in range(30_000)]
    row = spark.createDataFrame([(["x=absent", "x=w0word", *[f"x={w}" for w in words]], " ".join(words))], "f array<string>, a string")
    derived = row.select(grounding.derive_assertions(F.col("f"), F.col("a")).alias("d"))
    started = time.time()
    assert [a["value"] for a in derived.first()["d"]] == words[:5]
    assert time.time() - started < 5


def test_assertions_without_facts(spark):
    rows = spark.createDataFrame([(None, "a"), ([], "a"), (["x=aa", None, "noequals", "x=aa", "x=b"], "Aa b")], "f array<string>, a string")
    found = [r["d"] for r in rows.select(grounding.derive_assertions(F.col("f"), F.col("a")).alias("d")).collect()]
    assert found[:2] == [[], []]
    assert [tuple(a) for a in found[2]] == [("must_contain", "aa", None, True)]


def test_files_are_joined_in_the_order_of_their_names(spark, tmp_path):
    spark.range(5000, numPartitions=7).selectExpr("CAST(id AS string) AS value").write.option("lineSep", " ").text(str(tmp_path / "parts"))
    fixtures.join_files(spark, str(tmp_path / "parts"), f"file:{tmp_path}/one.txt")
    assert (tmp_path / "one.txt").read_text().split() == [str(i) for i in range(5000)]
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")].count("one.txt") == 1


def test_one_array_keeps_its_order(spark, tmp_path):
    rows = [((i * 37) % 101 + 1, i, "O", float(i), "1-URGENT") for i in range(101)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    found = load_queries()[0]["source_json_one_array"](spark, str(tmp_path)).select("pos", "o_orderkey", "o_custkey").collect()
    assert sorted(map(tuple, found)) == [(k - 1, k, c) for k, c, *_ in sorted(rows)]


def test_eval_files_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 10)
    rows = [(f"p{i}\nline", f"a{i}", f"f:row {i}") for i in range(95)]
    items = spark.createDataFrame(rows, "prompt string, expected_answer string, source_location string").coalesce(1)
    path = sinks.write_eval_csv(items, str(tmp_path / "set"))
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 10
    back = evalfiles.read_eval_rows(spark, path, "csv")
    assert sorted(map(tuple, back.select("prompt", "expected_answer", "source_location").collect())) == sorted(rows)


def test_questions_use_all_cores(spark, tmp_path):
    part = spark.range(50).selectExpr("id AS p_partkey", "concat('n', id) AS p_name")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = drafts.part(spark, str(tmp_path)).rows
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["row_index"] for r in rows.collect()) == list(range(50))


def test_profiles_make_no_text_of_numbers_and_times(spark, tmp_path):
    spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN id / 3 END AS x", "date_add(DATE'2020-01-01', CAST(id % 90 AS int)) AS d", "CAST(id AS decimal(9,2)) AS m"
    ).write.parquet(str(tmp_path / "in"))
    parts = incremental_profile.file_profiles(spark.read.parquet(str(tmp_path / "in")))
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "date_format" not in plan
    found = {r["field"]: r for r in incremental_profile.merged_profile(parts).collect()}
    assert {f: (r["data_type"], r["null_count"]) for f, r in found.items()} == {"id": ("number", 0), "x": ("number", 100), "d": ("date", 0), "m": ("number", 0)}
    assert found["d"]["about_unique"] == pytest.approx(90, rel=0.06) and found["x"]["about_unique"] == pytest.approx(900, rel=0.06)


def test_links_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame

    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "earlier long, later long").mapInPandas(count, "earlier long, later long")
    assert sorted(r["ord"] for r in graphs.drop_linked_to_kept(links).collect()) == list(range(1, 41, 2))
    assert seen.value == 40


def test_kept_items_are_written_without_normalised_text(spark):
    items = spark.createDataFrame([(1, "What is it?"), (2, "what is  it"), (3, "other"), (4, None), (5, None)], "ord long, prompt string")
    kept = validation.deduplicate(items)
    assert sorted(r["ord"] for r in kept.collect()) == [1, 3, 4]
    assert "norm" not in kept._jdf.queryExecution().analyzed().toString()
    assert validation.deduplicate(items.withColumn("nothing", F.lit(None))).count() == 3


def test_pieces_of_text_files_stay_where_they_are(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(textscan, "with_offsets", lambda *a, real=textscan.with_offsets: asked.append(a[3]) or real(*a))
    text = "# a\nline\n\nmore\n# b\n" + "word " * 200 + "\n\nlast\n"
    (tmp_path / "one.txt").write_text(text)
    found = textscan.chunk_text_files(spark, [str(tmp_path / "one.txt")]).select("chunk_number", "content").collect()
    whole = chunk_sections(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).select("chunk_number", "content").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole)) and asked == [2]
