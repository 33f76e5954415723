import pytest
from pyspark.sql import functions as F

from evalspark.operators import assertions, preparation, scoring

ROW = "ord long, prompt string, expected_answer string, source_location string, actual_answer string, similarity_score int, category string"


def rows(spark, scores, answers=None):
    return spark.createDataFrame(
        [(i, f"p{i}", "e", "s", (answers or {}).get(i, "a"), s, "c") for i, s in enumerate(scores)], ROW
    )


def checked(df):
    return df.withColumn("assertion_results", F.array().cast("array<struct<type:string,passed:boolean,detail:string>>"))


def test_summary(spark):
    row = scoring.scoring_summary(rows(spark, [90, 80, 60, 40])).first()
    assert (row["average_score"], row["min_score"], row["max_score"], row["pass_count"], row["fail_count"]) == (67.5, 40, 90, 2, 2)
    row = scoring.scoring_summary(rows(spark, [100, None])).first()
    assert (row["average_score"], row["min_score"], row["pass_count"]) == (50.0, 0, 1)
    row = scoring.scoring_summary(checked(rows(spark, []))).first()
    assert (row["total_questions"], row["average_score"], row["max_score"], row["total_assertions"]) == (0, 0.0, 0, 0)
    assert scoring.scoring_summary(rows(spark, [80, 60, 90])).first()["average_score"] == 76.7
    assert scoring.scoring_summary(rows(spark, [70, 71])).first()["gate_passed"] is True


def test_histogram(spark):
    table = {r["label"]: r for r in scoring.score_histogram(rows(spark, [100, 90, 89, 70, 50, 0, None, 95])).collect()}
    assert {k: v["count"] for k, v in table.items()} == {"Excellent": 3, "Good": 2, "Fair": 1, "Poor": 1}
    assert table["Excellent"]["bar"] == "█" * 20 and table["Good"]["bar"] == "█" * 13
    assert table["Excellent"]["percent"] == "38"
    empty = scoring.score_histogram(rows(spark, [])).collect()
    assert [r["count"] for r in empty] == [0, 0, 0, 0] and {r["bar"] for r in empty} == {""}


def test_details_and_categories(spark):
    df = checked(rows(spark, [90, None, 10])).withColumn("prompt", F.when(F.col("ord") == 0, F.repeat(F.lit("x"), 61)).otherwise("short"))
    details = scoring.result_details(df).orderBy("question_no").collect()
    assert details[0]["preview"] == "x" * 60 + "..." and details[1]["preview"] == "short"
    assert [d["score"] for d in details] == ["90/100", "N/A", "10/100"] and details[1]["passed"] is None
    row = scoring.category_breakdown(df).first()
    assert (row["questions"], row["average_score"], row["pass_rate"], row["assertions"]) == (3, 33.3, "33%", "-")


ANSWER = "The Owner is Dana (risk: High)."


def check(spark, *items):
    df = spark.createDataFrame([(ANSWER,)], "actual_answer string").withColumn("assertions", F.array(*items))
    return assertions.evaluate_assertions(df).first()["assertion_results"]


def test_assertion_types(spark):
    results = check(
        spark,
        assertions.must_contain(F.lit("dana")),
        assertions.must_contain(F.lit("Bob")),
        assertions.must_contain(F.lit("own"), whole_word=True),
        assertions.must_contain(F.lit("HIGH"), whole_word=True),
        assertions.must_contain_any(F.array(F.lit("Bob"), F.lit("risk"))),
        assertions.must_contain_any(F.array(F.lit("x9"), F.lit("y9"))),
        assertions.must_not_contain(F.lit("low")),
        assertions.must_not_contain(F.lit("HIGH")),
        assertions.must_contain_any(F.array(F.lit(""), F.lit("dana"))),
    )
    assert [r["passed"] for r in results] == [True, False, False, True, True, False, True, False, False]
    assert [r["detail"] for r in results][:8] == [
        '✅ Found "dana"', '❌ Missing "Bob"', '❌ Missing "own"', '✅ Found "HIGH"', '✅ Found "risk"',
        '❌ None found: "x9", "y9"', '✅ Correctly absent: "low"', '❌ Unexpectedly found "HIGH"',
    ]


def test_unknown_type_and_skipped_rows(spark):
    unknown = F.struct(F.lit("other").alias("type"), F.lit("x").alias("value"), F.lit(None).cast("array<string>").alias("values"), F.lit(None).cast("boolean").alias("whole_word"))
    (result,) = check(spark, unknown.cast(preparation.ASSERTION))
    assert result["passed"] is False and result["detail"] == "⚠️ Unknown assertion type"
    df = spark.createDataFrame([("[ERROR: x]",), ("",), (None,)], "actual_answer string").withColumn(
        "assertions", F.array(assertions.must_contain(F.lit("x")))
    )
    assert [r["assertion_results"] for r in assertions.evaluate_assertions(df).collect()] == [[], [], []]
    none = df.withColumn("assertions", F.lit(None).cast("array<struct<type:string,value:string,values:array<string>,whole_word:boolean>>"))
    none = none.withColumn("actual_answer", F.lit("ok"))
    assert assertions.evaluate_assertions(none).first()["assertion_results"] == []


@pytest.mark.parametrize(("reply", "score"), [("85", 85), ("150", 100), ("I rate it 75 of 100", 75), ("none", 0), ("9" * 20, 100), (None, 0)])
def test_parse_score(spark, reply, score):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(preparation.parse_score(F.col("r"))).first()[0] == score


def test_judging_skips_settled_rows(spark):
    calls = []

    def judge(prompts):
        if "boom" in prompts[0]:
            raise RuntimeError("down")
        return ["score 40" for _ in prompts]

    df = rows(spark, [12, None, None, None, None], {1: "[ERROR: t]", 2: "", 3: "fine", 4: "boom"})
    got = {r["ord"]: r["similarity_score"] for r in preparation.score_answers(df, judge).collect()}
    assert got == {0: 12, 1: 0, 2: 0, 3: 40, 4: 0} and not calls
    same = spark.createDataFrame([("a b c", "a b d"), ("x", "x")], "e string, a string")
    assert [r[0] for r in same.select(preparation.token_overlap_score(F.col("e"), F.col("a"))).collect()] == [50, 100]


def test_answers(spark):
    def answer(prompts):
        if "p2" in prompts[0]:
            raise ValueError("no luck")
        return [f"  reply to {p} " for p in prompts]

    df = rows(spark, [None] * 3, {0: "kept", 1: "", 2: None}).drop("similarity_score")
    got = {r["ord"]: r["actual_answer"] for r in preparation.answer_prompts(df, answer, "Sys", "Look in id9.").collect()}
    assert got[0] == "kept" and got[2] == "[ERROR: no luck]"
    assert got[1] == "reply to Look in id9.\n\nSys\n\np1"


def test_resume(spark):
    todo = rows(spark, [None] * 4)
    done = rows(spark, [5, None, 7, None]).filter("ord < 3")
    seen = preparation.resume(todo, done, lambda df: df.withColumn("similarity_score", F.lit(1)), key="ord")
    assert {r["ord"]: r["similarity_score"] for r in seen.collect()} == {0: 5, 1: 1, 2: 7, 3: 1}


def test_header_aliases():
    assert preparation.map_headers([" Question ", "Expected Answer", "SOURCE_LOCATION", "extra"]) == {
        " Question ": "prompt", "Expected Answer": "expected_answer", "SOURCE_LOCATION": "source_location",
    }
    with pytest.raises(ValueError, match="prompt"):
        preparation.map_headers(["expected_answer", "source_location"])
    assert preparation.deduplicate_headers(["a", "A", "b", "a"]) == ["a", "A_dup1", "b", "a_dup2"]
    assert preparation.resolve_system_prompt("x", "y") == "x" and preparation.resolve_system_prompt(None, " y\n") == "y"


def test_required_values(spark):
    df = spark.createDataFrame([("p", "e", "s"), (" ", "e", None)], "prompt string, expected_answer string, source_location string")
    complete, rejected = preparation.split_incomplete(df)
    assert complete.count() == 1 and rejected.first()["missing"] == ["prompt", "source_location"]
    with pytest.raises(ValueError):
        preparation.split_incomplete(df, strict=True)


def test_sidecar_last_item_wins(spark):
    item = lambda v: F.array(assertions.must_contain(v))
    side = spark.createDataFrame([(0, " What? ", "first"), (1, "WHAT?", "last"), (2, "other", "o")], "ord long, prompt string, v string")
    side = side.select("ord", "prompt", item(F.col("v")).alias("assertions"))
    df = spark.createDataFrame([("what?",), ("What? ",), ("nope",)], "prompt string")
    got = {r["prompt"]: r["assertions"] and r["assertions"][0]["value"] for r in preparation.attach_assertions(df, side).collect()}
    assert got == {"what?": "last", "What? ": "last", "nope": None}
    counts = scoring.input_counts(preparation.attach_assertions(df, side)).first()
    assert (counts["rows"], counts["rows_with_assertions"], counts["assertions"]) == (3, 2, 2)


def test_calls_are_made_once_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}", "e", "s", "") for i in range(6)], "ord int, prompt string, expected_answer string, source_location string, actual_answer string")
    log = tmp_path / "calls"

    def answer(prompts):
        with open(log, "a") as out:
            out.write("".join(p + "\n" for p in prompts))
        if prompts[0] == "p3":
            return []
        return [None] if prompts[0] == "p4" else ["reply to " + p for p in prompts]

    rows = preparation.answer_prompts(df, answer)
    got = {r["ord"]: r["actual_answer"] for r in rows.collect()}
    assert rows.filter("actual_answer <> ''").count() == 6
    assert sorted(log.read_text().split()) == [f"p{i}" for i in range(6)]
    assert got[0] == "reply to p0" and all(got[i].startswith("[ERROR:") for i in (3, 4))
