"""Fact selection: interesting rows by index, then one fact per filled cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.profiling import (
    ROW_INDEX,
    DatasetProfile,
    column_dimension,
    profiled_columns,
    unpivot_cells,
)
from evalspark.session import ensure_checkpoint_dir
from evalspark.sources.rowindex import with_row_reference

MAX_FACTS = 200
SUMMARY_RECORDS = 15


def extreme_rows(stats: DataFrame, profile: DataFrame) -> DataFrame:
    """First row at the minimum and first row at the maximum of each numeric column."""
    # One profile row per column, so the broadcast is bounded by the schema.
    ranges = F.broadcast(profile.filter(F.col("data_type") == "number").select("field", "num_min", "num_max"))
    at_edge = stats.join(ranges, "field").filter(
        (F.col("num") == F.col("num_min")) | (F.col("num") == F.col("num_max"))
    )
    return at_edge.groupBy("field").agg(
        F.min(F.when(F.col("num") == F.col("num_min"), F.col("first_idx"))).alias("min_row"),
        F.min(F.when(F.col("num") == F.col("num_max"), F.col("first_idx"))).alias("max_row"),
    )


def rare_and_common_rows(categories: DataFrame) -> DataFrame:
    """First rows of the rarest and of the most common category of each categorical column.

    Ties go to the first-seen category for the rarest and to the last-seen one for the most common;
    a column with one category has no separate most common row. At most 20 rows per column.
    """
    rare = Window.partitionBy("field").orderBy("cnt", "first_idx")
    common = Window.partitionBy("field").orderBy(F.desc("cnt"), F.desc("first_idx"))
    size = F.count(F.lit(1)).over(Window.partitionBy("field"))
    ranked = categories.select(
        "field",
        "value",
        "first_idx",
        F.row_number().over(rare).alias("rare_pos"),
        F.row_number().over(common).alias("common_pos"),
        size.alias("categories"),
    )
    rarest = ranked.filter("rare_pos = 1").select("field", F.lit("rarest").alias("role"), "value", "first_idx")
    most = ranked.filter("common_pos = 1 AND categories > 1").select(
        "field", F.lit("most_common").alias("role"), "value", "first_idx"
    )
    return rarest.unionAll(most)


def null_rows(df: DataFrame, columns: int = 3) -> DataFrame:
    """First row with a null or empty cell, for the first ``columns`` columns that have one."""
    names = profiled_columns(df)
    first_null = [
        F.min(F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), F.col(ROW_INDEX))).alias(c)
        for c in names
    ]
    # A single aggregate row is melted back to one row per column.
    per_column = df.agg(*first_null).unpivot([], [F.col(f"`{c}`") for c in names], "field", "first_idx")
    found = per_column.filter(F.col("first_idx").isNotNull()).join(column_dimension(df), "field")
    return found.orderBy("ord").limit(columns).select("field", "first_idx")


def priority_rows(df: DataFrame, profile: DatasetProfile) -> DataFrame:
    """Distinct indexes from extremes, categories and nulls: at most 4 per column plus 3."""
    extremes = extreme_rows(profile.stats, profile.columns)
    return (
        extremes.select(F.col("min_row").alias(ROW_INDEX))
        .unionAll(extremes.select("max_row"))
        .unionAll(rare_and_common_rows(profile.categories).select("first_idx"))
        .unionAll(null_rows(df).select("first_idx"))
        .filter(F.col(ROW_INDEX).isNotNull())
        .distinct()
    )


def spread_rows(selected: DataFrame, total: Column, target: int) -> DataFrame:
    """Evenly spaced indexes that top ``selected`` up to ``target``; ``total`` is the row count (a scalar subquery).

    Everything happens in one row of arrays: the selection is bounded by the schema and the candidate
    sequence by about twice the number of rows still wanted.
    """
    one = selected.agg(F.collect_set(ROW_INDEX).alias("sel")).withColumn("total_count", total)
    goal = F.least(F.col("total_count"), F.lit(target).cast("bigint"))
    remaining = goal - F.size("sel")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total_count") / F.greatest(remaining, F.lit(1))))
    free = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.col("total_count") - 1, step),
        lambda i: ~F.array_contains(F.col("sel"), i),
    )
    picked = F.when(remaining > 0, F.slice(free, F.lit(1), F.greatest(remaining, F.lit(0)).cast("int")))
    return one.filter(F.col("total_count") > 0).select(F.explode(picked).alias(ROW_INDEX))


def target_rows(columns: int, max_facts: int = MAX_FACTS) -> int:
    return -(-max_facts // max(1, columns))


def selected_rows(df: DataFrame, profile: DatasetProfile, max_facts: int = MAX_FACTS) -> DataFrame:
    """All selected row indexes, distinct."""
    ensure_checkpoint_dir(df.sparkSession)
    # A few rows per column, used twice: written once instead of being derived again.
    first = priority_rows(df, profile).checkpoint()
    total = df.agg(F.count(F.lit(1))).scalar()
    target = target_rows(len(profiled_columns(df)), max_facts)
    return first.unionAll(spread_rows(first, total, target)).distinct()


def emit_facts(df: DataFrame, rows: DataFrame, label: str | None = None, max_facts: int = MAX_FACTS) -> DataFrame:
    """``(fact_id, fact_no, field, value, row_index, row_ref)`` of the selected rows, first ``max_facts``.

    ``rows`` holds a few hundred indexes at most, so it is broadcast and the table is scanned once; the
    numbering window sees only the cells of the selected rows.
    """
    chosen = df.join(F.broadcast(rows), ROW_INDEX, "left_semi")
    if label is not None:
        chosen = chosen.withColumn("_source_file", F.lit(label))
    cells = unpivot_cells(with_row_reference(chosen), [ROW_INDEX, "row_ref"], profiled_columns(df))
    ordered = cells.join(F.broadcast(column_dimension(df)), "field")
    numbered = ordered.withColumn("fact_no", F.row_number().over(Window.orderBy(ROW_INDEX, "ord")))
    return numbered.filter(F.col("fact_no") <= max_facts).select(
        F.concat(F.lit("f-"), F.col("fact_no").cast("string")).alias("fact_id"),
        F.col("fact_no").cast("bigint").alias("fact_no"),
        "field",
        "value",
        ROW_INDEX,
        "row_ref",
    )


def extract_facts(df: DataFrame, profile: DatasetProfile, label: str | None = None, max_facts: int = MAX_FACTS) -> DataFrame:
    return emit_facts(df, selected_rows(df, profile, max_facts), label, max_facts)


def facts_by_record(facts: DataFrame) -> DataFrame:
    """One row per record with its facts in order; a record has one fact per column at most."""
    return facts.groupBy("row_ref").agg(
        F.min("fact_no").alias("first_fact"),
        F.array_sort(F.collect_list(F.struct("fact_no", "field", "value"))).alias("facts"),
    )


def summarize_facts(facts: DataFrame, numeric_fields: list[str] = (), max_records: int = SUMMARY_RECORDS) -> DataFrame:
    """Lines ``[ref] f="v", f=v`` of the first records; text values are JSON-quoted."""
    bare = F.array(*[F.lit(f) for f in numeric_fields]).cast("array<string>")

    def render(fact):
        quoted = F.regexp_replace(F.to_json(F.struct(fact["value"].alias("v"))), r'^\{"v":|\}$', "")
        shown = F.when(F.array_contains(bare, fact["field"]), fact["value"]).otherwise(quoted)
        return F.concat(fact["field"], F.lit("="), shown)

    records = facts_by_record(facts)
    line = F.concat(F.lit("["), F.col("row_ref"), F.lit("] "), F.array_join(F.transform("facts", render), ", "))
    return (
        records.withColumn("record_no", F.row_number().over(Window.orderBy("first_fact")))
        .filter(F.col("record_no") <= max_records)
        .select(F.col("record_no").cast("bigint").alias("record_no"), line.alias("line"))
    )
