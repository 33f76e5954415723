"""Score aggregation: summary, histogram, per-category table, detail rows and the pass gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS_THRESHOLD = 70
BAR_WIDTH = 20
PREVIEW_CHARS = 60

# Closed integer score ranges.
BUCKETS = [("Excellent", 90, 100), ("Good", 70, 89), ("Fair", 50, 69), ("Poor", 0, 49)]


def percent_text(part: Column, total: Column) -> Column:
    """Whole percent without sign; '0' where there is nothing to divide by."""
    return F.when(total == 0, "0").otherwise(
        F.round(part * 100.0 / F.greatest(total, F.lit(1))).cast("bigint").cast("string")
    )


def _passed_assertions() -> Column:
    return F.size(F.filter("assertion_results", lambda r: r["passed"]))


def _score_measures(threshold: int, with_assertions: bool) -> list[Column]:
    score = F.coalesce("similarity_score", F.lit(0))
    passed = F.count_if(score >= threshold)
    measures = [
        F.count(F.lit(1)).alias("total_questions"),
        F.coalesce(F.floor(F.avg(score) * 10 + 0.5) / 10, F.lit(0.0)).alias("average_score"),
        F.coalesce(F.min(score), F.lit(0)).cast("bigint").alias("min_score"),
        F.coalesce(F.max(score), F.lit(0)).cast("bigint").alias("max_score"),
        passed.alias("pass_count"),
        (F.count(F.lit(1)) - passed).alias("fail_count"),
    ]
    if with_assertions:
        total = F.coalesce(F.sum(F.size("assertion_results")), F.lit(0).cast("bigint"))
        good = F.coalesce(F.sum(_passed_assertions()), F.lit(0).cast("bigint"))
        measures += [
            total.alias("total_assertions"),
            good.alias("assertions_passed"),
            (total - good).alias("assertions_failed"),
        ]
    return measures


def scoring_summary(rows: DataFrame, threshold: int = PASS_THRESHOLD) -> DataFrame:
    """One row of totals; a missing score counts as 0 and an empty input gives zeros."""
    with_assertions = "assertion_results" in rows.columns
    summary = rows.agg(*_score_measures(threshold, with_assertions))
    return summary.withColumn("pass_threshold", F.lit(threshold)).withColumn(
        "gate_passed", F.col("fail_count") == 0
    )


def score_histogram(rows: DataFrame, total: Column | None = None) -> DataFrame:
    """Counts per score range with bar and percent of all rows; rows without a score are in no range.

    The range is a ``CASE`` on the row, so the data is reduced to four counts before any shuffle.
    """
    score = F.col("similarity_score")
    bucket = F.lit(None).cast("int")
    for position, (_, low, high) in reversed(list(enumerate(BUCKETS))):
        bucket = F.when(score.between(low, high), position).otherwise(bucket)
    counted = rows.select(bucket.alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    values = ", ".join(f"({i}, '{label}', '{low}-{high}')" for i, (label, low, high) in enumerate(BUCKETS))
    dimension = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS b(pos, label, score_range)")
    # Five groups at most (four ranges and "none"), joined to four ranges.
    total = counted.agg(F.sum("n")).scalar() if total is None else total
    joined = dimension.join(F.broadcast(counted), "pos", "left").withColumn("count", F.coalesce("n", F.lit(0).cast("bigint")))
    largest = F.max("count").over(Window.partitionBy())
    width = F.when(largest == 0, 0).otherwise(F.round(F.col("count") * BAR_WIDTH / F.greatest(largest, F.lit(1))))
    return joined.select(
        "pos",
        "label",
        "score_range",
        "count",
        F.repeat(F.lit("█"), width.cast("int")).alias("bar"),
        percent_text(F.col("count"), F.coalesce(total, F.lit(0))).alias("percent"),
    )


def category_breakdown(rows: DataFrame, threshold: int = PASS_THRESHOLD) -> DataFrame:
    """Questions, average, pass rate and assertion tally per category; rows without one are left out."""
    categorised = rows.filter(F.col("category").isNotNull() & (F.col("category") != ""))
    return _breakdown_columns(categorised.groupBy("category").agg(*_score_measures(threshold, True)))


def category_rollup(rows: DataFrame, threshold: int = PASS_THRESHOLD) -> DataFrame:
    """The category table and, as the row with ``category`` null, the grand total, in one aggregation."""
    categorised = rows.withColumn("category", F.coalesce("category", F.lit("")))
    rolled = categorised.rollup("category").agg(F.grouping("category").alias("is_total"), *_score_measures(threshold, True))
    wanted = rolled.filter((F.col("is_total") == 1) | (F.col("category") != ""))
    return _breakdown_columns(wanted.drop("is_total"))


def _breakdown_columns(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "category",
        F.col("total_questions").alias("questions"),
        "average_score",
        "pass_count",
        F.concat(percent_text(F.col("pass_count"), F.col("total_questions")), F.lit("%")).alias("pass_rate"),
        F.when(
            F.col("total_assertions") > 0,
            F.concat(
                F.col("assertions_passed").cast("string"), F.lit("/"), F.col("total_assertions").cast("string")
            ),
        )
        .otherwise(F.lit("-"))
        .alias("assertions"),
    )


def truncate_text(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def result_details(rows: DataFrame, threshold: int = PASS_THRESHOLD) -> DataFrame:
    """One detail row per question; ``ord`` is the 0-based position in the input."""
    score = F.col("similarity_score")
    total = F.size("assertion_results")
    return rows.select(
        (F.col("ord") + 1).alias("question_no"),
        truncate_text(F.col("prompt"), PREVIEW_CHARS).alias("preview"),
        F.when(score.isNull(), "N/A").otherwise(F.concat(score.cast("string"), F.lit("/100"))).alias("score"),
        F.when(score.isNotNull(), score >= threshold).alias("passed"),
        F.when(
            total > 0,
            F.concat(_passed_assertions().cast("string"), F.lit("/"), total.cast("string"), F.lit(" assertions passed")),
        ).alias("assertion_tally"),
    )


def input_counts(rows: DataFrame) -> DataFrame:
    """How many rows carry assertions and how many assertions there are."""
    size = F.when(F.col("assertions").isNull(), 0).otherwise(F.size("assertions"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(size > 0).alias("rows_with_assertions"),
        F.coalesce(F.sum(size), F.lit(0).cast("bigint")).cast("bigint").alias("assertions"),
    )
