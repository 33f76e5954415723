"""Grounding drafts in their source rows, and the evaluation items built from them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import fact_field, fact_value, js_string, strip_quotes
from evalspark.operators.joins import lookup_join
from evalspark.operators.preparation import ASSERTION
from evalspark.operators.profiling import ROW_INDEX
from evalspark.session import ensure_checkpoint_dir

MAX_ASSERTIONS = 5
ID_CHARS = 12
# So many files are read by name for the rows that are referred to; beyond, the scan is read as a whole.
MOST_FILES = 10_000


def referenced_row(location: Column) -> Column:
    """0-based row of ``...:row N``; null where there is none."""
    number = F.regexp_extract(location, r"(?i):row\s*(\d+)", 1)
    return F.nullif(number, F.lit("")).try_cast("bigint") - 1


def referenced_rows(scan: DataFrame, rows: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """The rows of a Parquet scan whose numbers stand in ``rows(row_index)``, with ``row_index``, read from their files alone.

    A row number is the number of rows in the files before plus the position in its own, so footers tell which file
    holds it. References to more than ``most_files`` different files read the whole scan instead of naming them.
    """
    spark = scan.sparkSession
    counts = scan.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
    ensure_checkpoint_dir(spark)
    counts = counts.checkpoint()
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    # Files are met by stretches of row numbers as long as a file on average, so this is an equality join.
    total = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("files")).first()
    stretch = max(1, (total["rows"] or 0) // max(1, total["files"]))
    files = counts.withColumn("_start", start).withColumn(
        "_stretch", F.explode(F.sequence(F.floor(F.col("_start") / stretch), F.floor((F.col("_start") + F.col("_n") - 1) / stretch)))
    )
    inside = (F.col(ROW_INDEX) >= F.col("_start")) & (F.col(ROW_INDEX) < F.col("_start") + F.col("_n"))
    wanted = rows.select(ROW_INDEX).distinct().withColumn("_stretch", F.floor(F.col(ROW_INDEX) / stretch))
    places = wanted.join(files, "_stretch").filter(inside).select("_path", (F.col(ROW_INDEX) - F.col("_start")).alias("_pos"), ROW_INDEX).checkpoint()
    paths = [r["_path"] for r in places.select("_path").distinct().limit(most_files + 1).toLocalIterator()]
    if not paths:
        return scan.select("*", F.lit(None).cast("bigint").alias(ROW_INDEX)).limit(0)
    if len(paths) <= most_files:
        scan = spark.read.schema(scan.schema).parquet(*[unquote(p) for p in paths])
    placed = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos"))
    return placed.join(places, ["_path", "_pos"]).drop("_path", "_pos")


def ground_in_files(drafts: DataFrame, scan: DataFrame, label: str, most_files: int = MOST_FILES) -> DataFrame:
    """``ground_answers`` against a Parquet scan of which only the files that drafts refer to are read."""
    wanted = drafts.select(referenced_row(F.col("source_location")).alias(ROW_INDEX)).filter(F.col(ROW_INDEX).isNotNull())
    return ground_answers(drafts, referenced_rows(scan, wanted, most_files), label)


def _verified(facts: Column, row: Column) -> Column:
    """Facts whose value agrees with the row (a map), rewritten with the row's own value."""

    def check(fact):
        field, expected = fact_field(fact), fact_value(fact)
        actual = F.try_element_at(row, field)
        agrees = (
            (actual == expected)
            | (actual == strip_quotes(expected))
            | (F.lower(actual) == strip_quotes(F.lower(expected)))
        )
        return F.when(agrees, F.concat(field, F.lit("="), actual))

    return F.array_compact(F.transform(facts, check))


def ground_answers(drafts: DataFrame, rows: DataFrame, label: str | None = None) -> DataFrame:
    """Check each draft's facts against the row it refers to and rewrite facts and location.

    Drafts without a usable reference stay unchanged, and so do the facts of a draft when none of them
    holds. Each row is looked up once by ``row_index``; all facts of a draft are then checked inside the
    joined row, so nothing is exploded and regrouped. A row that very many drafts refer to is handled by
    the lookup join.
    """
    names = [c for c in rows.columns if c != ROW_INDEX]
    asked = drafts.withColumn("_row", referenced_row(F.col("source_location")).cast("string"))
    wanted = asked.filter(F.col("_row").isNotNull()).select(F.col("_row").cast("bigint").alias(ROW_INDEX)).distinct()
    cells = [js_string(F.col(f"`{c}`"), rows.schema[c].dataType).alias(c) for c in names]
    file = F.lit(label) if label is not None else F.col("_source_file")
    lookup = rows.join(wanted, ROW_INDEX, "left_semi").select(
        F.col(ROW_INDEX).cast("string").alias("_row"),
        file.alias("_file"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*cells)).alias("_cells"),
    )
    joined = lookup_join(asked, lookup, "_row", "left")
    verified = _verified(F.col("supporting_facts"), F.col("_cells"))
    located = F.concat("_file", F.lit(":row "), (F.col("_row").cast("bigint") + 1).cast("string"))
    found = F.col("_cells").isNotNull()
    return joined.withColumn("_verified", F.when(found, verified)).select(
        *[c for c in drafts.columns if c not in ("supporting_facts", "source_location")],
        F.when(F.size("_verified") > 0, F.col("_verified")).otherwise(F.col("supporting_facts")).alias("supporting_facts"),
        F.when(found, located).otherwise(F.col("source_location")).alias("source_location"),
    )


def grounding_confidence(facts: Column, answer: Column) -> Column:
    """high / medium / low by the share of facts whose value occurs in the answer."""
    lowered = F.lower(F.coalesce(answer, F.lit("")))

    def hit(fact):
        value = strip_quotes(F.lower(fact_value(fact)))
        return F.coalesce((value != "") & F.contains(lowered, value), F.lit(False))

    ratio = F.size(F.filter(facts, hit)) / F.size(facts)
    return (
        F.when(facts.isNull() | (F.size(facts) == 0), "low")
        .when(ratio >= 0.8, "high")
        .when(ratio >= 0.4, "medium")
        .otherwise("low")
    )


def derive_assertions(facts: Column, answer: Column, limit: int = MAX_ASSERTIONS) -> Column:
    """``must_contain`` for each fact value of 2 to 80 characters found in the answer, distinct, first five.

    Short values made of letters only are matched as whole words. Equal values give equal assertions, so
    distinct structs are distinct (type, value) pairs.
    """

    def add(lowered):
        def step(found, value):
            usable = F.length(value).between(2, 80) & F.contains(lowered, F.lower(value))
            return F.when(F.size(found) >= limit, found).when(usable, F.array_append(found, value)).otherwise(found)

        return step

    def assertion(value):
        whole = (F.length(value) < 5) & value.rlike("^[a-zA-Z]+$")
        return F.struct(
            F.lit("must_contain").alias("type"),
            value.alias("value"),
            F.lit(None).cast("array<string>").alias("values"),
            F.when(whole, True).alias("whole_word"),
        ).cast(ASSERTION)

    # Texts are told apart by hashes, structs would be compared with each other; and no value is looked up behind the last one needed.
    distinct = F.array_distinct(F.transform(facts, lambda f: strip_quotes(fact_value(f))))
    none = F.array().cast("array<string>")
    # The answer is bound by an outer array of one element, else it would be lowered again for every fact.
    bound = F.array(F.lower(F.coalesce(answer, F.lit(""))))
    found = F.get(F.transform(bound, lambda low: F.aggregate(distinct, none, add(low))), F.lit(0))
    return F.coalesce(F.transform(found, assertion), F.array().cast(f"array<{ASSERTION.simpleString()}>"))


def item_id(prompt: Column, location: Column) -> Column:
    return F.substring(F.sha2(F.concat(prompt, F.lit("|"), location), 256), 1, ID_CHARS)


def build_items(questions: DataFrame) -> DataFrame:
    """Evaluation items: id, question, assertions and confidence, in one projection."""
    facts = F.coalesce("supporting_facts", F.array().cast("array<string>"))
    return questions.select(
        item_id(F.col("prompt"), F.col("source_location")).alias("id"),
        "ord",
        "prompt",
        "expected_answer",
        "source_location",
        derive_assertions(facts, F.col("expected_answer")).alias("assertions"),
        "category",
        "difficulty",
        facts.alias("supporting_facts"),
        grounding_confidence(facts, F.col("expected_answer")).alias("grounding_confidence"),
    )


