"""Queries over evaluation rows: preparation, answers, scores, assertions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text import whole_word_ci
from evalspark.operators import assertions, preparation, scoring
from evalspark.plans import evalrows as rows
from evalspark.plans.registry import query, table


@query(
    "eval_header_aliases",
    f"""SELECT conv_id, prompt, expected_answer, source_location,
      CASE WHEN actual_answer = '' THEN '' ELSE actual_answer END AS actual_answer FROM ({rows.ROWS_SQL})""",
)
def _(spark, sf):
    raw = rows.eval_rows(spark, sf).select(
        "conv_id",
        F.col("prompt").alias(" Question "),
        F.col("expected_answer").alias("Expected Answer"),
        F.col("source_location").alias("SourceLocation"),
        F.expr("nullif(actual_answer, '')").alias("Actual_Answer"),
    )
    return preparation.normalize_rows(raw)


_BLANKED = f"""SELECT ord, CASE WHEN conv_id % 5 = 0 THEN ' \t' ELSE prompt END AS prompt,
    CASE WHEN conv_id % 7 = 0 THEN '' ELSE expected_answer END AS expected_answer,
    CASE WHEN conv_id % 9 = 0 THEN NULL ELSE source_location END AS source_location FROM ({rows.ROWS_SQL})"""


@query(
    "eval_required_values",
    f"""SELECT ord, array_to_string(list_filter([
      CASE WHEN coalesce(trim(prompt, ' \t'), '') = '' THEN 'prompt' END,
      CASE WHEN coalesce(trim(expected_answer), '') = '' THEN 'expected_answer' END,
      CASE WHEN coalesce(trim(source_location), '') = '' THEN 'source_location' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM ({_BLANKED})""",
)
def _(spark, sf):
    blanked = rows.eval_rows(spark, sf).selectExpr(
        "ord",
        "if(conv_id % 5 = 0, ' \t', prompt) AS prompt",
        "if(conv_id % 7 = 0, '', expected_answer) AS expected_answer",
        "if(conv_id % 9 = 0, null, source_location) AS source_location",
    )
    complete, rejected = preparation.split_incomplete(blanked)
    return complete.select("ord", F.lit("").alias("missing")).unionAll(
        rejected.select("ord", F.array_join("missing", ",").alias("missing"))
    )


@query(
    "eval_sidecar_attach",
    f"""WITH {rows.ATTACHED_SQL} SELECT r.ord, CAST(count(a.pos) AS BIGINT) AS assertions,
      coalesce(string_agg(a."value", '|' ORDER BY a.pos), '') AS listed
    FROM rows r LEFT JOIN att a ON a.ord = r.ord GROUP BY r.ord""",
)
def _(spark, sf):
    return rows.attached(spark, sf).select(
        "ord",
        F.coalesce(F.size(F.coalesce("assertions", F.array().cast("array<struct<type:string,value:string,values:array<string>,whole_word:boolean>>"))), F.lit(0)).cast("bigint").alias("assertions"),
        F.coalesce(
            F.array_join(F.array_compact(F.transform("assertions", lambda a: a["value"])), "|"), F.lit("")
        ).alias("listed"),
    )


@query(
    "eval_prompt_assembly",
    f"""SELECT ord, 'Search connector c-1 first.' || chr(10) || chr(10)
      || 'Answer briefly.' || chr(10) || chr(10) || prompt AS full_prompt FROM ({rows.ROWS_SQL})""",
)
def _(spark, sf):
    full = preparation.assemble_prompt(F.col("prompt"), "Answer briefly.", "Search connector c-1 first.")
    return rows.eval_rows(spark, sf).select("ord", full.alias("full_prompt"))


def echo(texts: list[str]) -> list[str]:
    """A deterministic stand-in for an answering service; it fails on long prompts."""
    if any(len(t) > 300 for t in texts):
        raise RuntimeError("prompt too long")
    return [f" echo {t} " for t in texts]


@query(
    "eval_batch_answers",
    f"""SELECT ord, CASE WHEN actual_answer <> '' THEN actual_answer
      WHEN length('Be brief.' || chr(10) || chr(10) || prompt) > 300 THEN '[ERROR: prompt too long]'
      ELSE trim('echo Be brief.' || chr(10) || chr(10) || prompt, ' ' || chr(10)) END AS actual_answer FROM ({rows.ROWS_SQL})""",
)
def _(spark, sf):
    return preparation.answer_prompts(rows.eval_rows(spark, sf), echo, system_prompt="Be brief.").select(
        "ord", "actual_answer"
    )


def length_judge(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a judging service: replies with prose around a number."""
    return [f"Score: {len(p)} of 100" for p in prompts]


@query(
    "eval_batch_judging",
    f"""SELECT ord, CAST(CASE WHEN conv_id % 3 = 0 THEN 55
      WHEN actual_answer = '' OR starts_with(actual_answer, '[ERROR:') THEN 0
      ELSE least(100, length('Expected Answer: ' || expected_answer || chr(10) || chr(10) || 'Actual Answer: ' || actual_answer)) END AS INTEGER)
      AS similarity_score FROM ({rows.ROWS_SQL})""",
)
def _(spark, sf):
    scored = rows.eval_rows(spark, sf).withColumn("similarity_score", F.expr("if(conv_id % 3 = 0, 55, null)"))
    return preparation.score_answers(scored, length_judge).select("ord", "similarity_score")


@query("eval_overlap_scores", f"SELECT ord, similarity_score FROM ({rows.SCORED_SQL})")
def _(spark, sf):
    return preparation.score_answers(rows.eval_rows(spark, sf)).select("ord", "similarity_score")


@query(
    "eval_score_parsing",
    r"""SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, CAST(least(100, coalesce(try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE), 0)) AS INTEGER) AS score
      FROM documents UNION ALL
      SELECT 'e' || CAST(event_id AS VARCHAR), CAST(least(100, coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE), 0)) AS INTEGER)
      FROM events""",
)
def _(spark, sf):
    texts = table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "text")
    props = table(spark, sf, "events").selectExpr("concat('e', event_id) AS id", "props AS text")
    return texts.unionAll(props).select("id", preparation.parse_score(F.col("text")).alias("score"))


@query(
    "eval_resume",
    f"""SELECT ord, CASE WHEN conv_id % 2 = 0 THEN 100 ELSE similarity_score END AS similarity_score FROM ({rows.SCORED_SQL})""",
)
def _(spark, sf):
    todo = rows.eval_rows(spark, sf)
    earlier = todo.withColumn("similarity_score", F.expr("if(conv_id % 2 = 0, 100, null)"))
    return preparation.resume(todo, earlier, preparation.score_answers, key="ord").select("ord", "similarity_score")


# --- assertions ------------------------------------------------------------------------------------


@query(
    "assert_must_contain",
    """SELECT doc_id, p.i AS pos, contains(lower(text), lower(p.v)) AS passed FROM documents,
    (VALUES (0, 'The'), (1, 'ING '), (2, 'ü')) AS p(i, v)""",
)
def _(spark, sf):
    answer = F.col("text")
    checks = F.array(*[assertions.must_contain(F.lit(v)) for v in ("The", "ING ", "ü")])
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.transform(checks, lambda a: assertions.evaluate_assertion(a, answer))).alias("pos", "r")
    ).select("doc_id", "pos", "r.passed")


@query(
    "assert_whole_word",
    r"""SELECT doc_id, p.i AS pos, regexp_matches(text, p.v) AS passed FROM documents,
    (VALUES (0, '(?i)\bthe\b'), (1, '(?i)\bER\b'), (2, '(?i)\be\b'), (3, '(?i)\bat\.\b')) AS p(i, v)""",
)
def _(spark, sf):
    # The last value ends in a non-word character: there a boundary needs a word character after it.
    words = F.array(*[F.lit(v) for v in ("the", "ER", "e", "at.")])
    answer = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.transform(words, lambda w: whole_word_ci(answer, w))).alias("pos", "passed")
    )


@query(
    "assert_contain_any",
    """SELECT doc_id, coalesce(list_filter(['Quality', 'sch', 'ción', 'the'], lambda v: contains(lower(text), lower(v)))[1], '-') AS hit
    FROM documents""",
)
def _(spark, sf):
    check = assertions.must_contain_any(F.array(*[F.lit(v) for v in ("Quality", "sch", "ción", "the")]))
    result = assertions.evaluate_assertion(check, F.col("text"))
    hit = F.when(result["passed"], F.regexp_extract(result["detail"], '"(.*)"$', 1)).otherwise("-")
    return table(spark, sf, "documents").select("doc_id", hit.alias("hit"))


@query("assert_must_not_contain", "SELECT doc_id, NOT contains(lower(text), 'sch') AS passed FROM documents")
def _(spark, sf):
    result = assertions.evaluate_assertion(assertions.must_not_contain(F.lit("SCH")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", result["passed"].alias("passed"))


@query(
    "assert_row_results",
    f"""WITH {rows.RESULTS_SQL} SELECT ord, CAST(pos AS INTEGER) AS pos, kind AS type, passed, CASE
      WHEN kind = 'must_contain' AND passed THEN '✅ Found "' || "value" || '"'
      WHEN kind = 'must_contain' THEN '❌ Missing "' || "value" || '"'
      WHEN kind = 'must_contain_any' AND passed THEN '✅ Found "' || list_filter("values", lambda v: contains(lower(actual_answer), lower(v)))[1] || '"'
      WHEN kind = 'must_contain_any' THEN '❌ None found: ' || array_to_string(list_transform("values", lambda v: '"' || v || '"'), ', ')
      WHEN kind = 'must_not_contain' AND passed THEN '✅ Correctly absent: "' || "value" || '"'
      WHEN kind = 'must_not_contain' THEN '❌ Unexpectedly found "' || "value" || '"'
      ELSE '⚠️ Unknown assertion type' END AS detail FROM res""",
)
def _(spark, sf):
    return assertions.long_results(assertions.evaluate_assertions(rows.attached(spark, sf)), ["ord"])


# --- score aggregation -----------------------------------------------------------------------------

_SUMMARY = """CAST(count(*) AS BIGINT) AS total_questions, round(avg(s), 1) AS average_score, CAST(min(s) AS BIGINT) AS min_score,
  CAST(max(s) AS BIGINT) AS max_score, CAST(count(*) FILTER (s >= 70) AS BIGINT) AS pass_count,
  CAST(count(*) FILTER (s < 70) AS BIGINT) AS fail_count"""


@query(
    "score_summary",
    f"""SELECT {_SUMMARY}, 70 AS pass_threshold, count(*) FILTER (s < 70) = 0 AS gate_passed
    FROM (SELECT coalesce(similarity_score, 0) AS s FROM ({rows.EVENT_SCORES_SQL}))""",
)
def _(spark, sf):
    return scoring.scoring_summary(rows.event_scores(spark, sf))


@query(
    "score_assertion_totals",
    f"""WITH {rows.RESULTS_SQL} SELECT CAST(count(*) AS BIGINT) AS total_assertions,
    CAST(count(*) FILTER (passed) AS BIGINT) AS assertions_passed,
    CAST(count(*) FILTER (NOT passed) AS BIGINT) AS assertions_failed FROM res""",
)
def _(spark, sf):
    return scoring.scoring_summary(rows.checked(spark, sf)).select(
        "total_assertions", "assertions_passed", "assertions_failed"
    )


@query(
    "score_histogram",
    f"""WITH s AS ({rows.EVENT_SCORES_SQL}),
    b(pos, label, lo, hi) AS (VALUES (0, 'Excellent', 90, 100), (1, 'Good', 70, 89), (2, 'Fair', 50, 69), (3, 'Poor', 0, 49)),
    c AS (SELECT b.*, (SELECT count(*) FROM s WHERE similarity_score BETWEEN b.lo AND b.hi) AS n FROM b)
    SELECT pos, label, CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) AS score_range, CAST(n AS BIGINT) AS "count",
      repeat('█', CAST(round(n * 20 / (SELECT max(n) FROM c)) AS INTEGER)) AS bar,
      CAST(CAST(round(n * 100.0 / (SELECT count(*) FROM s)) AS BIGINT) AS VARCHAR) AS "percent" FROM c""",
)
def _(spark, sf):
    return scoring.score_histogram(rows.event_scores(spark, sf))


_CATEGORY = f"""WITH {rows.RESULTS_SQL}, sc AS ({rows.SCORED_SQL}),
  per AS (SELECT ord, count(*) AS n, count(*) FILTER (passed) AS good FROM res GROUP BY ord),
  j AS (SELECT sc.category, sc.similarity_score AS s, coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM sc LEFT JOIN per ON per.ord = sc.ord)"""
_CATEGORY_COLUMNS = """CAST(count(*) AS BIGINT) AS questions, round(avg(s), 1) AS average_score,
  CAST(count(*) FILTER (s >= 70) AS BIGINT) AS pass_count,
  CAST(CAST(round(count(*) FILTER (s >= 70) * 100.0 / count(*)) AS BIGINT) AS VARCHAR) || '%' AS pass_rate,
  CASE WHEN sum(n) > 0 THEN CAST(CAST(sum(good) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) ELSE '-' END AS assertions"""


@query(
    "score_by_category",
    f"{_CATEGORY} SELECT category, {_CATEGORY_COLUMNS} FROM j WHERE category IS NOT NULL GROUP BY category",
)
def _(spark, sf):
    return scoring.category_breakdown(rows.checked(spark, sf))


@query(
    "score_category_rollup",
    f"""{_CATEGORY} SELECT category, {_CATEGORY_COLUMNS} FROM j WHERE category IS NOT NULL GROUP BY category
    UNION ALL SELECT NULL, {_CATEGORY_COLUMNS} FROM j""",
)
def _(spark, sf):
    return scoring.category_rollup(rows.checked(spark, sf))


@query(
    "score_labels_by_language",
    f"""SELECT lang AS category, {_SUMMARY} FROM (
      SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.quality * 80 + (1 - l.toxic) * 20 END AS s
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels").selectExpr("doc_id", "quality * 80 + (1 - toxic) * 20 AS similarity_score")
    # Labels hold one row per document id, so the join key is unique on that side.
    joined = table(spark, sf, "documents").selectExpr("doc_id", "lang AS category").join(labels, "doc_id", "left")
    return joined.groupBy("category").agg(*scoring._score_measures(70, False))


@query(
    "score_details",
    f"""WITH {rows.RESULTS_SQL}, per AS (SELECT ord, count(*) AS n, count(*) FILTER (passed) AS good FROM res GROUP BY ord)
    SELECT sc.ord + 1 AS question_no, CASE WHEN length(prompt) > 60 THEN substring(prompt, 1, 60) || '...' ELSE prompt END AS preview,
      CAST(similarity_score AS VARCHAR) || '/100' AS score, similarity_score >= 70 AS passed,
      CASE WHEN n > 0 THEN CAST(good AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' assertions passed' END AS assertion_tally
    FROM ({rows.SCORED_SQL}) sc LEFT JOIN per ON per.ord = sc.ord""",
)
def _(spark, sf):
    return scoring.result_details(rows.checked(spark, sf))


@query("score_gate", f"SELECT count(*) FILTER (coalesce(similarity_score, 0) < 70) = 0 AS gate_passed FROM ({rows.EVENT_SCORES_SQL})")
def _(spark, sf):
    return scoring.scoring_summary(rows.event_scores(spark, sf)).select("gate_passed")


@query(
    "score_input_counts",
    f"""WITH {rows.ATTACHED_SQL} SELECT (SELECT CAST(count(*) AS BIGINT) FROM rows) AS "rows",
    CAST(count(DISTINCT ord) AS BIGINT) AS rows_with_assertions, CAST(count(*) AS BIGINT) AS assertions FROM att""",
)
def _(spark, sf):
    return scoring.input_counts(rows.attached(spark, sf))
