"""Text assertions on answers, evaluated in place with higher-order functions (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import contains_ci, whole_word_ci
from evalspark.operators.preparation import ASSERTION, unusable_answer

# Texts of assertion results.
FOUND = "✅ Found "
MISSING = "❌ Missing "
NONE_FOUND = "❌ None found: "
ABSENT = "✅ Correctly absent: "
UNEXPECTED = "❌ Unexpectedly found "
UNKNOWN = "⚠️ Unknown assertion type"


def must_contain(value: Column, whole_word: Column | bool | None = None) -> Column:
    """An assertion struct; used to build assertion arrays in queries and tests."""
    return _assertion("must_contain", value=value, whole_word=whole_word)


def must_contain_any(values: Column) -> Column:
    return _assertion("must_contain_any", values=values)


def must_not_contain(value: Column) -> Column:
    return _assertion("must_not_contain", value=value)


def _assertion(kind: str, value=None, values=None, whole_word=None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
        (F.lit(None) if values is None else values).cast("array<string>").alias("values"),
        (whole_word if isinstance(whole_word, Column) else F.lit(whole_word)).cast("boolean").alias("whole_word"),
    ).cast(ASSERTION)


def evaluate_assertion(assertion: Column, answer: Column) -> Column:
    """``struct(type, passed, detail)`` of one assertion; an unknown type fails."""
    kind, value, values = assertion["type"], assertion["value"], assertion["values"]
    present = F.when(F.coalesce(assertion["whole_word"], F.lit(False)), whole_word_ci(answer, value)).otherwise(
        contains_ci(answer, value)
    )
    # Only the first hit counts, and an empty text is never a hit.
    hit = F.try_element_at(F.filter(values, lambda v: contains_ci(answer, v)), F.lit(1))
    any_hit = F.coalesce(hit != "", F.lit(False))
    absent = ~contains_ci(answer, value)
    passed = (
        F.when(kind == "must_contain", present)
        .when(kind == "must_contain_any", any_hit)
        .when(kind == "must_not_contain", absent)
        .otherwise(False)
    )
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    listed = F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    detail = (
        F.when(
            kind == "must_contain",
            F.concat(F.when(present, F.lit(FOUND)).otherwise(F.lit(MISSING)), quoted),
        )
        .when(
            kind == "must_contain_any",
            F.when(any_hit, F.concat(F.lit(FOUND + '"'), hit, F.lit('"'))).otherwise(
                F.concat(F.lit(NONE_FOUND), listed)
            ),
        )
        .when(
            kind == "must_not_contain",
            F.concat(
                F.when(absent, F.lit(ABSENT)).otherwise(F.lit(UNEXPECTED)), quoted
            ),
        )
        .otherwise(F.lit(UNKNOWN))
    )
    return F.struct(kind.alias("type"), passed.alias("passed"), detail.alias("detail"))


def evaluate_assertions(rows: DataFrame) -> DataFrame:
    """Add ``assertion_results``: empty for rows without assertions and for unusable answers."""
    answer = F.col("actual_answer")
    results = F.transform("assertions", lambda a: evaluate_assertion(a, answer))
    nothing = F.slice(results, 1, 0)
    return rows.withColumn(
        "assertion_results",
        F.when(unusable_answer(answer), nothing).otherwise(
            F.coalesce(results, F.array().cast("array<struct<type:string,passed:boolean,detail:string>>"))
        ),
    )


def long_results(rows: DataFrame, ids: list[str]) -> DataFrame:
    """One row per assertion result."""
    return rows.select(*ids, F.posexplode("assertion_results").alias("pos", "result")).select(*ids, "pos", "result.*")
