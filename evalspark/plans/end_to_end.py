"""The whole workflow in one session: generate an eval set, answer it, check and score it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import assertions, grounding, preparation, questions, scoring
from evalspark.plans import drafts as d
from evalspark.plans.registry import numbered


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded items about the part table, every row asked about."""
    data = d.part(spark, sf_dir)
    drafted = questions.union_drafts(
        questions.single_record_questions(data, d.PART_FIELDS[:3]),
        questions.attribute_questions(data, d.PART_FIELDS),
        questions.comparison_questions(data, "p_type", "p_retailprice"),
        questions.filtered_find_questions(data, ["p_type"]),
    )
    # The generators refer to a row a few times at most, so no row can be hot.
    grounded = grounding.ground_answers(drafted, numbered(spark, sf_dir, "part"), data.label)
    return grounding.build_items(grounded)


def simulated_answers(items: DataFrame) -> DataFrame:
    """Evaluation rows with a deterministic answer: right, shortened, missing or failed, by the item's id."""
    pick = F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 10
    answer = (
        F.when(pick == 0, "")
        .when(pick == 1, "[ERROR: timeout]")
        .when(pick < 4, F.regexp_replace("expected_answer", r"\S+\.$", "unknown."))
        .otherwise(F.col("expected_answer"))
    )
    return items.withColumn("actual_answer", answer)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulated_answers(eval_items(spark, sf_dir))
    return assertions.evaluate_assertions(preparation.score_answers(rows))


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-category table and grand total of a generated, answered and scored eval set."""
    return scoring.category_rollup(scored_rows(spark, sf_dir))
