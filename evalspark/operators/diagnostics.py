"""Diagnostics against an index schema: which questions an index cannot answer well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import fact_field, matches_any_phrase

# Wordings that ask for aggregates or for everything.
AGGREGATION_PHRASES = ["how many", "count", "total", "average", "sum", "all"]
BROAD_PHRASES = ["list all", "show all", "every", "summarize all", "everything"]
SHOWN_WARNINGS = 5

# Texts of item issues; the name of the assistant goes into the braces.
UNINDEXED = 'References unindexed field "'
NOT_FOUND = '" — {} may not find this data'
UNRELIABLE = "Aggregation question without summary items — {} may give unreliable results"
BROAD = "Broad/exhaustive question — connector retrieval returns limited results"


def aggregation_wording(prompt: Column) -> Column:
    return matches_any_phrase(prompt, AGGREGATION_PHRASES)


def broad_wording(prompt: Column) -> Column:
    return matches_any_phrase(prompt, BROAD_PHRASES)


def _unique_fields(names: DataFrame | Sequence[str], spark) -> DataFrame:
    if isinstance(names, DataFrame):
        return names.select(F.lower("field").alias("field")).distinct()
    return spark.createDataFrame([(n.lower(),) for n in names], "field string").distinct()


def field_coverage(columns: DataFrame, content_fields: DataFrame | Sequence[str]) -> DataFrame:
    """``(field, indexed)`` for every dataset column, compared without case. One row per column."""
    dataset = columns.select(F.lower("field").alias("field"))
    indexed = _unique_fields(content_fields, columns.sparkSession).withColumn("_hit", F.lit(True))
    # Schema-sized on both sides.
    return dataset.join(F.broadcast(indexed), "field", "left").select(
        "field", F.coalesce("_hit", F.lit(False)).alias("indexed")
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    indexed = F.count_if("indexed")
    total = F.count(F.lit(1))
    return coverage.agg(
        indexed.alias("indexed_fields"),
        (total - indexed).alias("unindexed_fields"),
        F.coalesce(F.floor(F.try_divide(indexed * 100.0, total) + 0.5), F.lit(0)).cast("bigint").alias("coverage_percent"),
    )


def unindexed_fields(coverage: DataFrame) -> Column:
    """Scalar array of the unindexed names; bounded by the number of dataset columns."""
    return coverage.filter(~F.col("indexed")).agg(F.array_sort(F.collect_set("field")).alias("f")).scalar()


def diagnose_items(items: DataFrame, coverage: DataFrame, has_summary_items: bool = False, assistant: str = "the assistant") -> DataFrame:
    """Add ``issues`` (texts in order) and ``severity`` to each item, without a shuffle.

    ``assistant`` is the name used in the texts.
    """
    missing = unindexed_fields(coverage)
    fields = F.transform("supporting_facts", lambda f: F.lower(fact_field(f)))
    texts = F.transform(
        F.filter(fields, lambda f: F.array_contains(F.col("_unindexed"), f)),
        lambda f: F.concat(F.lit(UNINDEXED), f, F.lit(NOT_FOUND.format(assistant))),
    )
    none = F.array().cast("array<string>")
    aggregation = (
        none
        if has_summary_items
        else F.when(
            aggregation_wording(F.col("prompt")),
            F.array(F.lit(UNRELIABLE.format(assistant))),
        ).otherwise(none)
    )
    broad = F.when(
        broad_wording(F.col("prompt")),
        F.array(F.lit(BROAD)),
    ).otherwise(none)
    with_issues = items.withColumn("_unindexed", missing).withColumn(
        "issues", F.concat(F.coalesce(texts, none), aggregation, broad)
    )
    severity = (
        F.when(F.size("issues") == 0, "ok")
        .when(F.exists("issues", lambda i: F.contains(i, F.lit("unindexed"))), "error")
        .otherwise("warning")
    )
    return with_issues.withColumn("severity", severity).drop("_unindexed")


def issue_rows(diagnosed: DataFrame, ids: Sequence[str]) -> DataFrame:
    return diagnosed.select(*ids, F.posexplode("issues").alias("pos", "issue"))


def diagnostic_summary(diagnosed: DataFrame) -> DataFrame:
    """One row: items by severity, items on unindexed fields, aggregation warnings."""
    has = lambda word: F.exists("issues", lambda i: F.contains(i, F.lit(word)))
    return diagnosed.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("severity") == "ok").alias("ok_items"),
        F.count_if(F.col("severity") == "warning").alias("warning_items"),
        F.count_if(F.col("severity") == "error").alias("error_items"),
        F.count_if(has("unindexed")).alias("targeting_unindexed"),
        F.count_if(has("Aggregation")).alias("aggregation_warnings"),
    )


def aggregation_prompts(diagnosed: DataFrame) -> DataFrame:
    flagged = F.exists("issues", lambda i: F.contains(i, F.lit("Aggregation")))
    return diagnosed.filter(flagged).select("ord", "prompt")


def warning_lines(diagnosed: DataFrame) -> DataFrame:
    """``(ord, pos, warning)``: one ``prompt: issue`` line per issue."""
    return issue_rows(diagnosed.filter(F.col("severity") != "ok"), ["ord", "prompt"]).select(
        "ord", "pos", F.concat("prompt", F.lit(": "), "issue").alias("warning")
    )


def shown_warnings(warnings: DataFrame, shown: int = SHOWN_WARNINGS) -> DataFrame:
    """The first warnings in order, each with the number of those not shown (a top-k report)."""
    first = warnings.orderBy("ord", "pos").limit(shown)
    rest = F.greatest(warnings.agg(F.count(F.lit(1))).scalar() - shown, F.lit(0)).cast("bigint")
    numbered = first.withColumn("warning_no", F.row_number().over(Window.orderBy("ord", "pos")))
    return numbered.select(F.col("warning_no").cast("bigint").alias("warning_no"), "warning", rest.alias("more"))
