"""Writers. All of them write in parallel, one file per partition."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVAL_COLUMNS = ["prompt", "expected_answer", "source_location", "actual_answer"]
# Cells may hold line breaks, so a delimited file is read as a whole by one task: files are cut at so many rows.
ROWS_PER_FILE = 100_000
SEPARATORS = {"csv": ",", "tsv": "\t"}


def _delimited_writer(df: DataFrame, separator: str):
    return (
        df.write.option("header", True)
        .option("sep", separator)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_eval_csv(items: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Questions to be answered: the four text columns with an empty answer."""
    rows = items.select("prompt", "expected_answer", "source_location", F.lit("").alias("actual_answer"))
    _delimited_writer(rows, ",").mode(mode).csv(path)
    return path


def _file_assertions():
    return F.transform(
        "assertions",
        lambda a: F.struct(
            a["type"].alias("type"), a["value"].alias("value"), a["values"].alias("values"), a["whole_word"].alias("wholeWord")
        ),
    )


def write_eval_set(
    items: DataFrame, path: str, description: str = "", source_file: str = "", warnings: list[str] | None = None,
    metadata: dict[str, str] | None = None, mode: str = "errorifexists",
) -> str:
    """An eval set as ``items/`` (one JSON object per line, in parallel) and a one-row ``envelope/``."""
    columns = [
        "ord", "id", "prompt", "expected_answer", "source_location", _file_assertions().alias("assertions"), "category",
        "difficulty", "supporting_facts", "grounding_confidence",
    ]
    items.select(*columns).write.mode(mode).json(os.path.join(path, "items"))
    meta = {"model": "unknown", **(metadata or {})}
    # The count is taken from the written items, so it cannot disagree with them.
    written = items.sparkSession.read.schema("id string").json(os.path.join(path, "items"))
    envelope = written.agg(F.count(F.lit(1)).alias("item_count")).select(
        F.lit("1.0").alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
        F.lit(description).alias("description"),
        F.lit(source_file).alias("source_file"),
        "item_count",
        F.array(*[F.lit(w) for w in warnings or []]).cast("array<string>").alias("warnings"),
        F.create_map(*[F.lit(x) for pair in meta.items() for x in pair]).alias("metadata"),
    )
    envelope.write.mode(mode).json(os.path.join(path, "envelope"))
    return path


def results_path(input_path: str, output_dir: str, kind: str) -> str:
    base = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    return os.path.join(output_dir, f"{base}-results.{kind}")


def write_results(rows: DataFrame, input_path: str, output_dir: str, kind: str, mode: str = "errorifexists") -> str:
    """Scored rows in the input's format: csv / tsv with an empty cell, or json with null, for no score."""
    path = results_path(input_path, output_dir, kind)
    table = rows.select(*EVAL_COLUMNS, "similarity_score")
    if kind in SEPARATORS:
        _delimited_writer(table, SEPARATORS[kind]).mode(mode).csv(path)
    elif kind == "json":
        table.write.option("ignoreNullFields", False).mode(mode).json(path)
    else:
        raise ValueError(f"unsupported results format {kind!r}")
    return path
