"""The chained workflow as registered queries."""

from __future__ import annotations

from evalspark.plans import drafts as d
from evalspark.plans import end_to_end
from evalspark.plans.evalrows import OVERLAP_SQL
from evalspark.plans.registry import query
from evalspark.plans.scoring_queries import _CATEGORY_COLUMNS

_VALUE = """regexp_replace(trim(substring(f, instr(f, '=') + 1)), '^"|"$', '', 'g')"""
_ITEMS = " UNION ALL ".join(
    [
        d.PART.single(d.PART_FIELDS[:3]),
        d.PART.attribute(d.PART_FIELDS),
        d.PART.comparison("p_type", "p_retailprice"),
        d.PART.filtered(["p_type"]),
    ]
)
# Grounding keeps the facts that hold for the referenced row: of a comparison only the first.
_SCORED = f"""items AS (SELECT * REPLACE (CASE WHEN category = 'comparison' THEN facts[1:1] ELSE facts END AS facts), substring(sha256(prompt || '|' || source_location), 1, 12) AS id FROM ({_ITEMS})),
  drawn AS (SELECT *, CAST('0x' || id[1:2] AS INTEGER) % 10 AS pick FROM items),
  answered AS (SELECT *, CASE WHEN pick = 0 THEN '' WHEN pick = 1 THEN '[ERROR: timeout]'
    WHEN pick < 4 THEN regexp_replace(expected_answer, '\\S+\\.$', 'unknown.') ELSE expected_answer END AS actual_answer FROM drawn),
  kept AS (SELECT *, list_filter(facts, lambda f, i: list_position(facts, f) = i AND length({_VALUE}) BETWEEN 2 AND 80
      AND contains(lower(expected_answer), lower({_VALUE})))[1:5] AS kf FROM answered),
  judged AS (SELECT category, {OVERLAP_SQL} AS s,
    CASE WHEN actual_answer = '' OR starts_with(actual_answer, '[ERROR:') THEN 0 ELSE len(kf) END AS n,
    CASE WHEN actual_answer = '' OR starts_with(actual_answer, '[ERROR:') THEN 0 ELSE len(list_filter(kf, lambda f:
      CASE WHEN length({_VALUE}) < 5 AND regexp_full_match({_VALUE}, '[a-zA-Z]+')
        THEN regexp_matches(actual_answer, '(?i)\\b' || {_VALUE} || '\\b') ELSE contains(lower(actual_answer), lower({_VALUE})) END)) END AS good FROM kept),
  j AS (SELECT * FROM judged)"""


@query(
    "workflow_category_report",
    f"""WITH {_SCORED} SELECT category, {_CATEGORY_COLUMNS} FROM j GROUP BY category
    UNION ALL SELECT NULL, {_CATEGORY_COLUMNS} FROM j""",
)
def _(spark, sf):
    return end_to_end.category_report(spark, sf)
