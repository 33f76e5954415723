"""Evaluation rows, eval sets and index schemas from files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.preparation import (
    ASSERTION,
    HEADER_ALIASES,
    SCORE_ALIASES,
    deduplicate_headers,
    normalize_rows,
    warn_version,
)
from evalspark.sources import archives
from evalspark.sources.files import delimited_reader, extension_of, listing, read_json_documents
from evalspark.sources.sniff import first_records

EVAL_FORMATS = {".csv": "csv", ".tsv": "tsv", ".xlsx": "xlsx", ".json": "json"}
HEADER_NAMES = HEADER_ALIASES.keys() | SCORE_ALIASES.keys()
POSITIONAL = ("prompt", "expected_answer", "source_location", "actual_answer")

_FILE_ASSERTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("wholeWord", T.BooleanType()),
    ]
)
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("source_location", T.StringType()),
        T.StructField("assertions", T.ArrayType(_FILE_ASSERTION)),
        T.StructField("category", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("supporting_facts", T.ArrayType(T.StringType())),
        T.StructField("grounding_confidence", T.StringType()),
    ]
)
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("item_count", T.LongType()),
        T.StructField("items", T.ArrayType(ITEM_SCHEMA)),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def is_header(cells: Iterable[str | None]) -> bool:
    """A first row is a header if any of its cells is a known column name."""
    return not {(c or "").strip().lower() for c in cells}.isdisjoint(HEADER_NAMES)


def _delimited(spark: SparkSession, path: str, separator: str) -> list[DataFrame]:
    """The files at ``path``, one table for all files with equal first rows where these are headers.

    First rows are found in one job. Cells may hold line breaks, so each file is read as a whole.
    """
    first = first_records(listing(spark, path), separator).filter(F.size("cells") > 0)
    known = F.exists("cells", lambda c: F.lower(c).isin(sorted(HEADER_NAMES)))
    groups = first.groupBy(F.when(known, F.col("cells")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("uris"))
    tables = []
    for group in groups.toLocalIterator():
        files, header = [unquote(u) for u in group["uris"]], group["header"]
        reader = delimited_reader(spark, separator, multiline=True)
        if header is not None:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in deduplicate_headers(header)])
            tables.append(reader.schema(schema).csv(files))
        else:
            raw = reader.option("header", False).csv(files)
            tables.append(raw.toDF(*[POSITIONAL[i] if i < len(POSITIONAL) else f"column_{i + 1}" for i in range(len(raw.columns))]))
    return tables or [spark.createDataFrame([], ", ".join(f"`{c}` string" for c in POSITIONAL))]


def read_eval_rows(spark: SparkSession, path: str, kind: str | None = None, with_score: bool = False) -> DataFrame:
    """Evaluation rows from a file (format by extension) or from a folder written by the sinks (``kind``).

    The header of delimited files is recognised by its names, for each file by itself; without one, columns are
    positional. JSON is an array, or one object per line as the sinks write it.
    """
    kind = kind or EVAL_FORMATS.get(extension_of(path))
    if kind not in EVAL_FORMATS.values():
        raise ValueError(f"unsupported file extension {extension_of(path)!r}; supported: {', '.join(EVAL_FORMATS)}")
    if kind == "json":
        tables = [read_json_documents(spark, path)]
    elif kind == "xlsx":
        cells = archives.workbook_cells(spark.read.format("binaryFile").load(path))
        tables = [archives.map_columns(cells).drop("path", "row_no")]
    else:
        tables = _delimited(spark, path, "\t" if kind == "tsv" else ",")
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), [normalize_rows(t, with_score) for t in tables])


def _assertions(column: str = "assertions"):
    return F.transform(
        column,
        lambda a: F.struct(
            a["type"].alias("type"), a["value"].alias("value"), a["values"].alias("values"), a["wholeWord"].alias("whole_word")
        ).cast(ASSERTION),
    )


def items_to_rows(items: DataFrame) -> DataFrame:
    """Eval-set items as evaluation rows without an answer; metadata become ordinary columns."""
    return items.select(
        "ord", "prompt", "expected_answer", "source_location", F.lit("").alias("actual_answer"),
        _assertions().alias("assertions"), "category", "difficulty",
        F.col("grounding_confidence").alias("confidence"), "id",
    )


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, envelope)`` of an eval-set document, or of a folder written by ``write_eval_set``.

    A document is one JSON object with ``items``; many documents can be read at once from a folder.
    """
    if _is_split(spark, path):
        envelope = spark.read.schema(_without_items()).json(f"{path}/envelope")
        items = spark.read.schema(_item_lines()).json(f"{path}/items")
    else:
        document = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path)
        envelope = document.drop("items")
        if document.filter(F.col("items").isNull()).limit(1).count():
            raise ValueError('invalid eval set: missing "items" array')
        items = document.select(F.posexplode("items").alias("pos", "item")).select(
            F.col("pos").cast("bigint").alias("ord"), "item.*"
        )
    first = envelope.select("version").first()
    warn_version(first["version"] if first else None)
    return items_to_rows(items), envelope


def _is_split(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, "envelope")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _without_items() -> T.StructType:
    return T.StructType([f for f in ENVELOPE_SCHEMA.fields if f.name != "items"])


def _item_lines() -> T.StructType:
    return T.StructType([T.StructField("ord", T.LongType()), *ITEM_SCHEMA.fields])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, prompt, assertions)`` of an eval set, for attaching to rows by prompt."""
    rows, _ = read_eval_set(spark, path)
    return rows.select("ord", "prompt", "assertions")


def read_index_schema(spark: SparkSession, path: str, multiple: bool = False) -> DataFrame:
    """One row: ``name, contentFields, titleField, urlField, hasSummaryItems, connectionDescription``.

    ``multiple`` reads a folder of schemas with one JSON object per line, one row each.
    """
    schema = (
        "name string, contentFields array<string>, titleField string, urlField string, "
        "hasSummaryItems boolean, connectionDescription string"
    )
    df = spark.read.schema(schema).option("multiLine", not multiple).json(path)
    if df.filter(F.col("contentFields").isNull()).limit(1).count():
        raise ValueError('index schema must have a "contentFields" array')
    return df


def content_fields(schema: DataFrame) -> DataFrame:
    """``(field)`` rows of an index schema."""
    return schema.select(F.explode("contentFields").alias("field"))
