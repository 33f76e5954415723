import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions.html import parse_page, resolve_link
from evalspark.operators import chunking
from evalspark.plans import fixtures
from evalspark.sources import archives, evalfiles, files, pages, payloads, sinks
from evalspark.streaming import incremental

CSV = 'id,name,services\n1, Ann ,"a, b"\n\n2,"Bo ""B""",c\n'


def test_merged_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "b.csv").write_text(CSV)
    (tmp_path / "a.json").write_text('[{"id": 5, "extra": {"k": 1}}, {"id": 6}]')
    (tmp_path / "c.jsonl").write_text('{"id": 7}\n\n{"id": 8, "name": "z"}\n')
    (tmp_path / "sub dir" / "d.tsv").write_text("id\tother\n9\tx\n")
    (tmp_path / "e.bin").write_text("ignored")
    df = files.read_dataset(spark, str(tmp_path)).orderBy("row_index")
    rows = df.collect()
    assert [r["row_index"] for r in rows] == list(range(7))
    assert [r["_source_file"] for r in rows] == ["a.json"] * 2 + ["b.csv"] * 2 + ["c.jsonl"] * 2 + ["d.tsv"]
    assert [r["id"] for r in rows] == ["5", "6", "1", "2", "7", "8", "9"]
    assert rows[2]["name"] == "Ann" and rows[2]["services"] == "a, b" and rows[3]["name"] == 'Bo "B"'
    only = files.read_dataset(spark, str(tmp_path), recursive=False, extensions=[".csv"])
    assert only.count() == 2
    listed = files.read_dataset(spark, f"{tmp_path}/c.jsonl, {tmp_path}/b.csv").orderBy("row_index").collect()
    assert [r["_source_file"] for r in listed] == ["c.jsonl"] * 2 + ["b.csv"] * 2
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path), extensions=["pptx"])


def test_single_json_object_and_bad_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    assert files.read_json_documents(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(ValueError):
        files.read_json_documents(spark, str(tmp_path / "bad.json"))


def loop_chunks(pieces, separator, limit=500):
    chunks, current = [], ""
    for piece in pieces:
        if len(current) + len(piece) > limit and current:
            chunks.append(current.strip())
            current = ""
        current += piece + separator
    if current.strip():
        chunks.append(current.strip())
    return chunks


@pytest.mark.parametrize("seed", range(3))
def test_chunks_against_loop(spark, seed):
    import re

    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = ["w" * rng.choice([1, 3, 8, 40, 499, 500, 501, 700]) for _ in range(rng.randint(1, 60))]
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n", "\n\n"]).join(words) + rng.choice(["", " "]))
    texts.append("# Title\nbody\n\n\n## Part\ntext ### not a heading\n### Three\n#### four\n" + "z" * 490)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for chunked, pieces, separator in (
        (chunking.chunk_words(df, ["id"]), lambda t: re.split(r"\s+", t), " "),
        (
            chunking.chunk_sections(df, ["id"]),
            lambda t: [s for s in re.split(r"\n{2,}|(?=^#{1,3}\s)", t, flags=re.M) if s.strip()],
            "\n\n",
        ),
    ):
        got = {}
        for r in chunked.orderBy("id", "chunk_number").collect():
            got.setdefault(r["id"], []).append(r["content"])
            assert r["word_count"] == len(r["content"].split()) or r["content"] == ""
        for i, text in enumerate(texts):
            assert got.get(i, []) == loop_chunks(pieces(text), separator), text[:80]


def test_office_documents(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(fixtures.workbook(["name", "n", "n", "flag"], [["Ann", 1, 2.5, None], [None, None, None, None], ["B&o", 3, None, "x"]]))
    (tmp_path / "d.docx").write_bytes(fixtures.document(["First paragraph", "  ", "x" * 497, "Last"]))
    (tmp_path / "s.pptx").write_bytes(fixtures.deck([["Title", " ", "Body"], [" "], *([["t"]] * 9)]))
    load = lambda name: spark.read.format("binaryFile").load(str(tmp_path / name))
    cells = archives.workbook_cells(load("b.xlsx")).orderBy("row_no").collect()
    assert [r["cells"] for r in cells] == [{"name": "Ann", "n": "1", "n_1": "2.5"}, {"name": "B&o", "n": "3", "flag": "x"}]
    chunks = archives.document_chunks(load("d.docx")).orderBy("chunk_number").collect()
    assert [r["content"] for r in chunks] == ["First paragraph", "x" * 497, "Last"]
    slides = archives.slide_records(load("s.pptx")).orderBy("slide_number").collect()
    assert [r["slide_number"] for r in slides] == [1, *range(3, 12)] and slides[0]["content"] == "Title\nBody"
    merged = files.read_dataset(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["row_index"] for r in merged] == list(range(2 + 3 + 10))


PAGE = """<html><head><title> A &amp; B </title><script>var x = "<p>no</p>";</script></head><body><h1>Top <b>bold</b></h1>
<p>A first paragraph that is long enough<p>short<div>x</div><p>Second <i>paragraph</i>, long enough too<h2>Sub</h2>
<a href="/x?q=1#f">in</a> <a href="http://other.example/y">out</a><a href="mailto:a@b.c">mail</a><a>none</a>
<table><tr><th>K<th>V<tr><td>a<td>1</tr><tr><td>only</td></tr></table></body>"""


def test_page_structure():
    page = parse_page(PAGE)
    assert page["title"] == "A & B" and page["headings"] == ["Top bold", "Sub"]
    assert page["paragraphs"] == ["A first paragraph that is long enough", "short", "Second paragraph, long enough too"]
    assert page["tables"] == [(["K", "V"], [["a", "1"]])]
    assert page["links"] == ["/x?q=1#f", "http://other.example/y", "mailto:a@b.c"]
    assert resolve_link("http://H.example/a/b", "../ü") == ("http://h.example/%C3%BC", "h.example")
    assert resolve_link("http://h.example/a", "mailto:a@b.c") is None


def test_page_records(spark):
    df = spark.createDataFrame([("http://h.example/1", PAGE), ("http://h.example/2", PAGE.split("<table>")[0])], "url string, html string")
    parsed = pages.parse_pages(df)
    content = pages.content_records(parsed).collect()
    assert [r["_source_url"] for r in content] == ["http://h.example/2"]
    assert content[0]["content"] == "A first paragraph that is long enough\n\nSecond paragraph, long enough too"
    assert [r["cells"] for r in pages.table_records(parsed).collect()] == [{"K": "a", "V": "1"}]
    assert {r["target"] for r in pages.same_host_links(parsed).collect()} == {"http://h.example/x?q=1#f"}


@pytest.mark.parametrize("seed", [0, 1])
def test_crawl_against_queue(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://h/{i}" for i in range(40)]
    links = {u: rng.sample(urls, rng.randint(0, 5)) for u in urls[:30]}
    rows = [(u, p, t) for u, out in links.items() for p, t in enumerate(out)]
    got = {}
    df = pages.crawl(spark.createDataFrame([(urls[0],), (urls[1],)], "seed string"), spark.createDataFrame(rows, "url string, pos int, target string"), 7)
    for r in df.orderBy("seed", "visit_no").collect():
        got.setdefault(r["seed"], []).append(r["url"])
    for seed_url in urls[:2]:
        visited, queue = [], [seed_url]
        while queue and len(visited) < 7:
            url = queue.pop(0)
            if url not in visited:
                visited.append(url)
                queue.extend(t for t in links.get(url, []) if t not in visited)
        assert got[seed_url] == visited


def test_payloads(spark):
    texts = ['[{"a":1},2]', '{"items":[{"a":3}],"data":{}}', '{"a":4}', "broken", "5", '{"value":[],"records":[{"a":6}]}', json.dumps([{"a": i} for i in range(80)])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = {}
    for r in payloads.unwrap_payloads(df, ["id"]).select("id", F.try_variant_get("record", "$.a", "int").alias("a")).collect():
        got.setdefault(r["id"], []).append(r["a"])
    assert got[0] == [1, None] and got[1] == [3] and got[2] == [4] and len(got[6]) == 50
    assert 3 not in got and 4 not in got and got[5] == [6]


def test_endpoints(spark):
    paths = {f"/p{i}": {"get": {}} for i in range(12)}
    spec = json.dumps({"paths": {"/z": {"post": {}}, "/y/{id}": {"get": {}}, "/n": {"get": None}, **paths}})
    df = spark.createDataFrame([(1, spec), (2, "{}")], "id int, spec string")
    assert [r["path"] for r in payloads.list_endpoints(df, ["id"]).orderBy("pos").collect()] == [f"/p{i}" for i in range(10)]


def test_catalog_sample(spark):
    spark.range(300).createOrReplaceTempView("numbers_a")
    spark.range(3).selectExpr("id AS other").createOrReplaceTempView("numbers_b")
    sample = payloads.sample_catalog(spark, names=["numbers_a", "numbers_b"])
    counts = {r["_source_table"]: r["count"] for r in sample.groupBy("_source_table").count().collect()}
    assert counts == {"numbers_a": 100, "numbers_b": 3} and sample.columns == ["id", "_source_table", "other"]


def test_eval_row_files(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        return [tuple(r)[:4] for r in evalfiles.read_eval_rows(spark, str(tmp_path / name)).collect()]

    assert read("a.csv", 'Question,Expected Answer,Source Location,Actual Answer\n"q, 1",e,s,\n\nq2,e2,s2,a2\n') == [("q, 1", "e", "s", ""), ("q2", "e2", "s2", "a2")]
    assert read("a.tsv", "prompt\texpected_answer\tsource_location\tactual_answer\nq\te\ts\ta\n") == [("q", "e", "s", "a")]
    assert read("b.csv", "first,second,third,fourth,fifth\n") == [("first", "second", "third", "fourth")]
    assert read("c.csv", "prompt,Prompt,expected_answer,source_location\nx,y,e,s\n")[0][1:3] == ("e", "s")
    assert read("a.json", '[{"prompt":"q","expectedAnswer":"e","sourceLocation":"s"},{"prompt":"r","expectedAnswer":"e","sourceLocation":"s","actualAnswer":"a"}]') == [("q", "e", "s", ""), ("r", "e", "s", "a")]
    (tmp_path / "x.xlsx").write_bytes(fixtures.workbook(["prompt", "expected_answer", "source_location"], [["q", "e", 5]]))
    assert tuple(evalfiles.read_eval_rows(spark, str(tmp_path / "x.xlsx")).first()) == ("q", "e", "5", "")
    for name, text in (("bad.csv", "expected_answer,source_location\ne,s\n"), ("obj.json", '{"a":1}'), ("a.doc", "x")):
        with pytest.raises(ValueError):
            read(name, text)
    (tmp_path / "s.csv").write_text("prompt,expected_answer,source_location,similarity score\nq,e,s,88\nq,e,s,\n")
    assert [r["similarity_score"] for r in evalfiles.read_eval_rows(spark, str(tmp_path / "s.csv"), with_score=True).collect()] == [88, None]


def test_eval_set_documents(spark, tmp_path):
    item = {"id": "i1", "prompt": "Who?", "expected_answer": "Dana", "source_location": "f:row 1", "category": "temporal", "assertions": [{"type": "must_contain", "value": "Dana", "wholeWord": True}]}
    (tmp_path / "set.json").write_text(json.dumps({"version": "1.0", "items": [item, {"prompt": "x"}], "metadata": {"model": "m"}}))
    rows, envelope = evalfiles.read_eval_set(spark, str(tmp_path / "set.json"))
    first = rows.orderBy("ord").first()
    assert (first["prompt"], first["category"], first["actual_answer"], first["assertions"][0]["whole_word"]) == ("Who?", "temporal", "", True)
    assert envelope.first()["metadata"] == {"model": "m"}
    assert evalfiles.read_sidecar(spark, str(tmp_path / "set.json")).count() == 2
    (tmp_path / "bad.json").write_text('{"version": "1.0"}')
    with pytest.raises(ValueError):
        evalfiles.read_eval_set(spark, str(tmp_path / "bad.json"))
    (tmp_path / "v2.json").write_text('{"version": "2.0", "items": []}')
    with pytest.warns(UserWarning):
        evalfiles.read_eval_set(spark, str(tmp_path / "v2.json"))
    written = rows.withColumnsRenamed({"confidence": "grounding_confidence"}).withColumns(
        {"difficulty": F.lit("easy"), "supporting_facts": F.array(F.lit("a=1"))}
    )
    sinks.write_eval_set(written, str(tmp_path / "out"), "text", "f", ["w1"])
    again, meta = evalfiles.read_eval_set(spark, str(tmp_path / "out"))
    assert again.orderBy("ord").first()["assertions"][0]["whole_word"] is True
    assert (meta.first()["item_count"], meta.first()["warnings"]) == (2, ["w1"])


def test_index_schema(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name": "n", "contentFields": ["a", "b"], "hasSummaryItems": false}')
    schema = evalfiles.read_index_schema(spark, str(tmp_path / "s.json"))
    assert [r["field"] for r in evalfiles.content_fields(schema).collect()] == ["a", "b"]
    (tmp_path / "t.json").write_text('{"name": "n"}')
    with pytest.raises(ValueError):
        evalfiles.read_index_schema(spark, str(tmp_path / "t.json"))


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", x\nline', "e", "s", " a ", 80), ("b", "e", "s", "", None)], "prompt string, expected_answer string, source_location string, actual_answer string, similarity_score int")
    for kind in ("csv", "tsv"):
        path = sinks.write_results(df, "in/set.csv", str(tmp_path), kind)
        assert path.endswith(f"set-results.{kind}")
        back = evalfiles.read_eval_rows(spark, path, kind, with_score=True).collect()
        assert {(r["prompt"], r["similarity_score"]) for r in back} == {('a "q", x\nline', 80), ("b", None)}
    path = sinks.write_results(df, "in/set.csv", str(tmp_path), "json")
    assert {r["similarity_score"] for r in spark.read.json(path).collect()} == {80, None}
    with pytest.raises(ValueError):
        sinks.write_results(df, "x", str(tmp_path), "pdf")


def test_stream_resumes(spark, tmp_path):
    schema = "ord long, prompt string, expected_answer string, source_location string, actual_answer string, category string, assertions array<struct<type:string,value:string,values:array<string>,whole_word:boolean>>"
    batch = lambda lo: spark.createDataFrame([(i, "p", "a b", "s", "a b", "c", None) for i in range(lo, lo + 5)], schema)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo in (0, 5):
        batch(lo).write.mode("append").parquet(source)
        out = incremental.score_stream(spark, source, batch(0).schema, target, state)
    assert sorted(r["ord"] for r in out.collect()) == list(range(10))
    assert {r["similarity_score"] for r in out.collect()} == {100}
    table = incremental.category_stream(spark, target, out.schema, str(tmp_path / "table"), str(tmp_path / "state2"))
    assert table.first()["questions"] == 10


def test_json_lines_under_a_json_name(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('[{"a": 4},\n{"a": 5}]')
    (tmp_path / "c.json").write_text('{\n"a": 6\n}')
    assert sorted(r["a"] for r in files.read_json_documents(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["a"] for r in files.read_dataset(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6]
    (tmp_path / "d.json").write_text('[{"a": 7}] {"a": 8}')
    with pytest.raises(ValueError):
        files.read_json_documents(spark, str(tmp_path / "d.json"))


def test_ragged_lines_fail(spark, tmp_path):
    for name, text in (("long.csv", "a,b\n1,2,3\n"), ("short.csv", "a,b\n1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="(?i)malformed"):
            files.read_delimited(spark, str(tmp_path / name)).collect()


def test_headers_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x\none",y\n1,2\n')
    (tmp_path / "b.csv").write_text('"x\ntwo",y\n3,4\n')
    got = files.read_dataset(spark, str(tmp_path), multiline=True)
    assert {"x\none", "x\ntwo", "y"} <= set(got.columns)
    assert [(r["x\none"], r["x\ntwo"], r["y"]) for r in got.orderBy("row_index").collect()] == [("1", None, "2"), (None, "3", "4")]


def test_eval_files_with_two_header_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prompt,expected_answer,source_location\nq1,e1,s1\n")
    (tmp_path / "b.csv").write_text("source_location,expected_answer,prompt\ns2,e2,q2\n")
    got = sorted(tuple(r)[:3] for r in evalfiles.read_eval_rows(spark, str(tmp_path), "csv").collect())
    assert got == [("q1", "e1", "s1"), ("q2", "e2", "s2")]


def test_results_in_json_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "e", "s", "x", 80), ("c", "e", "s", "", None)], "prompt string, expected_answer string, source_location string, actual_answer string, similarity_score int")
    path = sinks.write_results(df, "in/set.json", str(tmp_path), "json")
    assert {(r["prompt"], r["similarity_score"]) for r in evalfiles.read_eval_rows(spark, path, "json", with_score=True).collect()} == {("a\nb", 80), ("c", None)}
