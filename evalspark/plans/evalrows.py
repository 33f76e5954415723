"""Evaluation rows, sidecar assertions and scores derived from the given conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import assertions, preparation
from evalspark.plans.registry import table

# The same rows in SQL; word lists index from 1 in both engines here.
ROWS_SQL = """SELECT u.conv_id * 4294967296 + u.turn AS ord, u.conv_id, u.text AS prompt, u.text AS expected_answer,
    'conversations.parquet:row ' || CAST(u.conv_id * 4294967296 + u.turn + 1 AS VARCHAR) AS source_location,
    CASE WHEN u.conv_id % 11 = 0 THEN '[ERROR: timeout]' ELSE coalesce(a.text, '') END AS actual_answer,
    CASE WHEN u.conv_id % 13 = 0 THEN NULL ELSE 'turn ' || CAST(u.turn AS VARCHAR) END AS category
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""


def eval_rows(spark, sf) -> DataFrame:
    """User turns as prompts with the assistant turn that follows as the answer.

    The next turn comes from an equi-join on (conversation, turn), which spreads well however long one
    conversation is; a window per conversation would not.
    """
    turns = table(spark, sf, "conversations")
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    users = turns.filter("role = 'user'").drop("role")
    position = F.col("conv_id") * (1 << 32) + F.col("turn")
    answer = F.when(F.col("conv_id") % 11 == 0, "[ERROR: timeout]").otherwise(F.coalesce("reply", F.lit("")))
    return users.join(replies, ["conv_id", "turn"], "left").select(
        position.alias("ord"),
        "conv_id",
        F.col("text").alias("prompt"),
        F.col("text").alias("expected_answer"),
        F.concat(F.lit("conversations.parquet:row "), (position + 1).cast("string")).alias("source_location"),
        answer.alias("actual_answer"),
        F.when(F.col("conv_id") % 13 == 0, None).otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("category"),
    )


# Assertions derived from the first, middle and last word of every prompt.
WORDS_SQL = "list_filter(string_split(prompt, ' '), lambda x: x <> '')"
SIDECAR_SQL = f"""SELECT ord, prompt, pos, kind, "value", "values", whole FROM (
    SELECT ord, prompt, {WORDS_SQL} AS w FROM rows WHERE len({WORDS_SQL}) >= 1) src,
  LATERAL (VALUES
    (0, 'must_contain', w[len(w)], NULL, false), (1, 'must_contain', w[len(w) // 2 + 1], NULL, true),
    (2, 'must_contain_any', NULL, [w[1], w[len(w)], 'the'], false), (3, 'must_not_contain', 'ing', NULL, false),
    (4, 'must_match', w[1], NULL, false)) AS t(pos, kind, "value", "values", whole)"""


def sidecar(rows: DataFrame) -> DataFrame:
    """``(ord, prompt, assertions)`` for every prompt with a word."""
    words = F.filter(F.split("prompt", " "), lambda w: w != "")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    middle = F.get(words, F.floor(F.size(words) / 2).cast("int"))
    unknown = F.struct(
        F.lit("must_match").alias("type"),
        first.alias("value"),
        F.lit(None).cast("array<string>").alias("values"),
        F.lit(False).alias("whole_word"),
    ).cast(preparation.ASSERTION)
    items = F.array(
        assertions.must_contain(last),
        assertions.must_contain(middle, whole_word=True),
        assertions.must_contain_any(F.array(first, last, F.lit("the"))),
        assertions.must_not_contain(F.lit("ing")),
        unknown,
    )
    return rows.filter(F.size(words) >= 1).select("ord", "prompt", items.alias("assertions"))


# Attached by prompt text: the last item of a prompt wins.
ATTACHED_SQL = f"""rows AS ({ROWS_SQL}),
  side AS ({SIDECAR_SQL}),
  last AS (SELECT lower(trim(prompt)) AS k, max(ord) AS last_ord FROM side GROUP BY 1),
  att AS (SELECT r.ord, r.category, r.actual_answer, s.pos, s.kind, s."value", s."values", s.whole
    FROM rows r JOIN last l ON l.k = lower(trim(r.prompt)) JOIN side s ON s.ord = l.last_ord)"""

RESULTS_SQL = f"""{ATTACHED_SQL},
  res AS (SELECT *, CASE
      WHEN kind = 'must_contain' AND whole THEN regexp_matches(actual_answer, '(?i)\\b' || regexp_escape("value") || '\\b')
      WHEN kind = 'must_contain' THEN contains(lower(actual_answer), lower("value"))
      WHEN kind = 'must_contain_any' THEN len(list_filter("values", lambda v: contains(lower(actual_answer), lower(v)))) > 0
      WHEN kind = 'must_not_contain' THEN NOT contains(lower(actual_answer), lower("value"))
      ELSE false END AS passed
    FROM att WHERE actual_answer <> '' AND NOT starts_with(actual_answer, '[ERROR:'))"""


def attached(spark, sf) -> DataFrame:
    rows = eval_rows(spark, sf)
    return preparation.attach_assertions(rows, sidecar(rows))


def checked(spark, sf) -> DataFrame:
    """Rows with scores and assertion results."""
    return assertions.evaluate_assertions(preparation.score_answers(attached(spark, sf)))


NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
OVERLAP_SQL = f"""CASE WHEN actual_answer = '' OR starts_with(actual_answer, '[ERROR:') THEN 0 ELSE
    CAST(round(100.0 * len(list_intersect(list_distinct(string_split({NORM.format('expected_answer')}, ' ')),
      list_distinct(string_split({NORM.format('actual_answer')}, ' '))))
    / greatest(1, len(list_distinct(list_concat(string_split({NORM.format('expected_answer')}, ' '),
      string_split({NORM.format('actual_answer')}, ' ')))))) AS INTEGER) END"""
SCORED_SQL = f"SELECT *, {OVERLAP_SQL} AS similarity_score FROM ({ROWS_SQL})"


# Plain deterministic scores over a larger table, some of them missing.
EVENT_SCORES_SQL = """SELECT event_id AS ord, event_type AS category,
    CASE WHEN user_id % 17 = 0 THEN NULL ELSE CAST(event_id * 37 % 101 AS INTEGER) END AS similarity_score FROM events"""


def event_scores(spark, sf) -> DataFrame:
    score = F.when(F.col("user_id") % 17 == 0, None).otherwise((F.col("event_id") * 37 % 101).cast("int"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("event_type").alias("category"), score.alias("similarity_score")
    )
