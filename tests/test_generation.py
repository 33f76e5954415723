import pytest
from pyspark.sql import functions as F

from evalspark.operators import diagnostics, grounding, questions

ROWS = [("Alder Foods", "Dana", "Active", "High", 0), ("Birch Tools", "Lee", "Paused", "Low", 1), ("Cedar Mills", "Kim", "Active", "Medium", 2)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "supplier_name string, owner string, status string, risk string, row_index long")


def draft(spark, location, facts, answer="Dana owns Alder Foods.", prompt="Who owns it?"):
    return spark.createDataFrame(
        [(0, prompt, "attribute_retrieval", "easy", answer, facts, location)],
        "ord long, prompt string, category string, difficulty string, expected_answer string, supporting_facts array<string>, source_location string",
    )


@pytest.mark.parametrize(
    ("location", "facts", "expected", "where"),
    [
        ("data.csv:row 1", ["owner=Dana", "status=Wrong"], ["owner=Dana"], "s.csv:row 1"),
        ("data.csv:ROW  2", ['owner="lee"', "status=PAUSED"], ["owner=Lee", "status=Paused"], "s.csv:row 2"),
        ("data.csv:row 1", ["owner=Nobody", "bare"], ["owner=Nobody", "bare"], "s.csv:row 1"),
        ("data.csv:row 99", ["owner=Dana"], ["owner=Dana"], "data.csv:row 99"),
        ("data.csv:row 0", ["owner=Dana"], ["owner=Dana"], "data.csv:row 0"),
        (None, ["owner=Dana"], ["owner=Dana"], None),
        ("data.csv:row 1", None, None, "s.csv:row 1"),
    ],
)
def test_ground_answers(spark, rows, location, facts, expected, where):
    row = grounding.ground_answers(draft(spark, location, facts), rows, "s.csv").first()
    assert (row["supporting_facts"], row["source_location"]) == (expected, where)


@pytest.mark.parametrize(
    ("facts", "answer", "level"),
    [
        (["owner=Dana", "name=Alder Foods"], "Dana owns alder foods", "high"),
        (["a=1", "b=zzz"], "only 1", "medium"),
        (["a=zzz"], "nothing", "low"),
        ([], "x", "low"),
        (["a=x", "no sign", "also none"], "x", "low"),
        (['a="x y"'], "X Y", "high"),
    ],
)
def test_confidence(spark, facts, answer, level):
    items = grounding.build_items(draft(spark, "f:row 1", facts, answer))
    assert items.first()["grounding_confidence"] == level


def test_assertions_from_facts(spark):
    facts = ["a=1", "b=High", "c=High", "d=Alder Foods", "e=2024-01-01", "f=absent", "g=Dana", "h=Paused now", "i=AB"]
    answer = "High Alder Foods 2024-01-01 dana Paused now AB 1"
    got = grounding.build_items(draft(spark, "f:row 1", facts, answer)).first()["assertions"]
    assert [a["value"] for a in got] == ["High", "Alder Foods", "2024-01-01", "Dana", "Paused now"]
    assert [a["whole_word"] for a in got] == [True, None, None, True, None]
    long_value = "x" * 81
    assert grounding.build_items(draft(spark, "f:row 1", [f"a={long_value}"], long_value)).first()["assertions"] == []


def test_item_id(spark):
    import hashlib

    item = grounding.build_items(draft(spark, "f:row 1", ["a=1"])).first()
    assert item["id"] == hashlib.sha256(b"Who owns it?|f:row 1").hexdigest()[:12]


def test_quotas(spark):
    assert {r["category"]: r["quota"] for r in questions.category_quotas(spark, 30).collect()} == {
        "single_record_lookup": 9, "attribute_retrieval": 6, "filtered_find": 6, "temporal": 3, "comparison": 3, "edge_case": 3,
    }
    assert min(r["quota"] for r in questions.category_quotas(spark, 2).collect()) == 1
    assert [questions.clamp_count(n) for n in (1, 30, 500)] == [10, 30, 50]


@pytest.mark.parametrize(
    "reply",
    [
        '{"questions": [{"prompt": "a"}, {"prompt": "b"}]}',
        'Sure:\n```json\n{"questions": [{"prompt": "a"}, {"prompt": "b"}]}\n```\nBye',
        'Here it is {"questions": [{"prompt": "a"}, {"prompt": "b"}]} as asked',
        '\x1b[32m {"questions": [{"prompt": "a"}, {"prompt": "b"}]} \x1b[0m',
    ],
)
def test_reply_forms(spark, reply):
    df = spark.createDataFrame([(1, reply)], "id int, reply string")
    assert [r["prompt"] for r in questions.explode_reply(df, ["id"]).orderBy("pos").collect()] == ["a", "b"]


def test_reply_without_json(spark):
    df = spark.createDataFrame([(1, "no json"), (2, "```json broken ``` {\"questions\": []}"), (3, None)], "id int, reply string")
    assert questions.explode_reply(df, ["id"]).count() == 0


def test_generators_on_small_table(spark, rows):
    data = questions.Dataset(rows, "s.csv", "supplier_name")
    single = questions.single_record_questions(data, ["owner", "status"]).orderBy("ord").first()
    assert single["expected_answer"] == "Alder Foods: owner is Dana, status is Active."
    assert single["supporting_facts"] == ["owner=Dana", "status=Active"] and single["source_location"] == "s.csv:row 1"
    found = questions.filtered_find_questions(data, ["status"], listed=1).orderBy("ord").collect()
    assert found[0]["expected_answer"] == "With status Active: Alder Foods and 1 more."
    absent = questions.edge_case_questions(data, "status", "risk").collect()
    assert sorted(tuple(r["supporting_facts"]) for r in absent) == [("status=Active", "risk=Low"), ("status=Paused", "risk=High")]
    members = questions.filtered_find_members(data, ["status"]).orderBy("value", "rank").collect()
    assert [(r["value"], r["rank"]) for r in members][:2] == [("Active", 1), ("Active", 2)]
    union = questions.union_drafts(questions.single_record_questions(data, ["owner"]), questions.attribute_questions(data, ["owner", "risk"]))
    items = grounding.build_items(grounding.ground_answers(union, rows, "s.csv"))
    assert {r["grounding_confidence"] for r in items.collect()} == {"high"}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_next_in_group_across_blocks(spark, block):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], f"e{i}") for i in range(20)], "row_index long, g string, entity string")
    got = {(r["entity"], r["next"]["entity"]) for r in questions.next_in_group(df, "g", ["entity"], block).collect()}
    want = set()
    for members in ([i for i in range(20) if i % 3 == 0], [i for i in range(20) if i % 3]):
        want |= {(f"e{a}", f"e{b}") for a, b in zip(members, members[1:])}
    assert got == want


def test_intents_fall_back_to_fields(spark):
    facts = spark.createDataFrame(
        [(n, f, f"s:row {n}") for n in range(1, 9) for f in ("owner",)], "fact_no long, field string, row_ref string"
    )
    intents = spark.createDataFrame([(0, ["s:row 2", "s:row 1"], ["x"]), (1, ["none"], ["owner"]), (2, [], ["gone"])],
                                    "intent long, target_row_references array<string>, target_fields array<string>")
    context = questions.intent_context(intents, facts)
    drafts = spark.createDataFrame([(0,), (1,), (2,)], "draft long")
    lists = {r["draft"]: r["referenced_facts"] for r in questions.attach_context(drafts, context).collect()}
    assert lists == {0: [2, 1], 1: [1, 2, 3, 4, 5], 2: None}


def diag(spark, prompt, facts, fields=("supplier_name",), summary=False):
    columns = spark.createDataFrame([("Supplier_Name",), ("contract_value",)], "field string")
    items = draft(spark, "f:row 1", facts, prompt=prompt)
    return diagnostics.diagnose_items(items, diagnostics.field_coverage(columns, list(fields)), summary).first()


def test_diagnostics(spark):
    assert diag(spark, "Who is it?", ["supplier_name=X"])["severity"] == "ok"
    bad = diag(spark, "How many are there?", ["Contract_Value=5"])
    assert bad["severity"] == "error" and len(bad["issues"]) == 2
    assert diag(spark, "How many are there?", [], summary=True)["severity"] == "ok"
    assert diag(spark, "Give the total", [])["severity"] == "warning"
    assert diag(spark, "totally allowed accounts", [])["severity"] == "ok"
    assert diag(spark, "List ALL things", [], summary=True)["issues"] == [
        "Broad/exhaustive question — connector retrieval returns limited results"
    ]
    columns = spark.createDataFrame([("a",), ("B",), ("c",)], "field string")
    row = diagnostics.coverage_summary(diagnostics.field_coverage(columns, ["b", "z"])).first()
    assert (row["indexed_fields"], row["unindexed_fields"], row["coverage_percent"]) == (1, 2, 33)


def test_shown_warnings(spark):
    items = spark.createDataFrame([(i, f"List all {i}", []) for i in range(8)], "ord long, prompt string, supporting_facts array<string>")
    columns = spark.createDataFrame([("a",)], "field string")
    diagnosed = diagnostics.diagnose_items(items, diagnostics.field_coverage(columns, ["a"]), True)
    shown = diagnostics.shown_warnings(diagnostics.warning_lines(diagnosed)).orderBy("warning_no").collect()
    assert len(shown) == 5 and shown[0]["more"] == 3 and shown[0]["warning"].startswith("List all 0: Broad")
    assert diagnosed.select(F.sum(F.size("issues"))).first()[0] == 8
