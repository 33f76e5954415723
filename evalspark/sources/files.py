"""Datasets from files: discovery, one reader per format, and the merge with provenance."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import js_string
from evalspark.sources import archives
from evalspark.sources.jsonscan import json_records, parse_records
from evalspark.sources.rowindex import with_offsets, with_row_index_by
from evalspark.sources.sniff import first_records
from evalspark.sources.textscan import chunk_text_files

# File extensions and how they are read.
FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".xlsx": "xlsx",
    ".docx": "docx",
    ".pptx": "pptx",
    ".txt": "text",
    ".md": "text",
    ".parquet": "parquet",
}


def extension_of(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``uri`` of the files at or below a path, as scans name them in their metadata; no content is read.

    Names that start with an underscore or a dot are left out, as every scan does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("_metadata.file_path").alias("uri")).filter(~F.element_at(F.split("uri", "/"), -1).rlike("^[_.]"))


def _extension(uri: str = "uri") -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(uri, "/"), -1), r"(\.[^.]*)$", 1))


def discover_files(spark: SparkSession, path: str, recursive: bool = True, extensions: Iterable[str] | None = None) -> DataFrame:
    """``uri``, ``extension`` of the supported files below a folder."""
    wanted = set(FORMATS) if extensions is None else {f".{e.lstrip('.').lower()}" for e in extensions} & set(FORMATS)
    return listing(spark, path, recursive).withColumn("extension", _extension()).filter(F.col("extension").isin(sorted(wanted)))


def delimited_reader(spark: SparkSession, separator: str = ",", multiline: bool = False):
    """Reader options for delimited text: header, trimmed cells, quotes doubled, everything a string.

    ``multiline`` allows line breaks inside quotes; such a file is one unit of work. Without it files are split. A line
    with more or fewer cells than the header fails the job, as does a quoted line break read without ``multiline``.
    """
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
    )


def read_delimited(spark: SparkSession, paths: Sequence[str] | str, separator: str = ",", multiline: bool = False) -> DataFrame:
    """Files that share one header."""
    return delimited_reader(spark, separator, multiline).csv(paths)


def _parsed(scan: DataFrame) -> DataFrame:
    if "_corrupt_record" in scan.columns:
        raise ValueError("JSON file must contain an array of objects, a single object, or one object per line")
    return scan


def read_json_documents(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """JSON files of any form: an array of objects, one object, or one object per line.

    Keys are united over all files. Documents are cut into records on all cores (``jsonscan``); what follows the
    one value of a document fails.
    """
    records = json_records(spark, [paths] if isinstance(paths, str) else paths)
    return parse_records(records).drop("_path", "_pos")


def read_json_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return _parsed(spark.read.json(paths))


def _with_position(scan: DataFrame) -> DataFrame:
    """Add ``_path`` and ``_pos``, the position of the row in its file."""
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = tagged.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint"))).drop("_n")
    splits = scan.rdd.getNumPartitions() + len(scan.inputFiles())
    positioned = with_offsets(tagged, starts, ["_path", "_block"], splits)
    return positioned.withColumn("_pos", F.col("_start") + F.col("_mid") - F.col("_first")).drop(
        "_block", "_mid", "_first", "_start"
    )


def header_groups(files: DataFrame, separator: str = ",") -> DataFrame:
    """``cells``, ``uris``, ``n``: the files of ``files(uri)`` that have the same first record; found in one job."""
    return first_records(files, separator).groupBy(F.col("cells")).agg(F.sort_array(F.collect_list("path")).alias("uris"), F.count(F.lit(1)).alias("n"))


@dataclass
class _Scan:
    """What the files of one format are read with: the inputs, and a filter on names."""

    spark: SparkSession
    inputs: list[str]
    recursive: bool
    extensions: list[str]

    def reader(self, reader: DataFrameReader) -> DataFrameReader:
        letters = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in self.extensions]
        return reader.option("pathGlobFilter", f"*{{{','.join(letters)}}}").option("recursiveFileLookup", self.recursive)


def _delimited_scans(scan: _Scan, files: DataFrame, separator: str, multiline: bool) -> list[DataFrame]:
    """One scan for each different header; where all files have the same, no path is named."""
    reader = scan.reader(delimited_reader(scan.spark, separator, multiline))
    groups = header_groups(files, separator).filter(F.size("cells") > 0).checkpoint()
    if groups.count() < 2:
        return [reader.csv(scan.inputs)]
    return [reader.csv([unquote(u) for u in group["uris"]]) for group in groups.toLocalIterator()]


def _read_group(scan: _Scan, kind: str, files: DataFrame, multiline: bool = False) -> list[DataFrame]:
    spark, inputs = scan.spark, scan.inputs
    if kind in ("csv", "tsv"):
        return [_with_position(part) for part in _delimited_scans(scan, files, "\t" if kind == "tsv" else ",", multiline)]
    if kind == "json":
        return [parse_records(json_records(spark, inputs, scan.reader(spark.read)))]
    if kind == "jsonl":
        return [_with_position(_parsed(scan.reader(spark.read).json(inputs)))]
    if kind == "parquet":
        table = scan.reader(spark.read).option("mergeSchema", True).parquet(*inputs)
        return [table.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos"))]
    if kind == "text":
        chunks = chunk_text_files(spark, inputs, scan.reader(spark.read)).withColumnRenamed("path", "_path")
        return [chunks.withColumn("_pos", F.col("chunk_number").cast("bigint") - 1)]
    binaries = scan.reader(spark.read.format("binaryFile")).load(inputs)
    contents = binaries.select(F.col("_metadata.file_path").alias("path"), "content")
    if kind == "xlsx":
        cells = archives.workbook_cells(contents)
        return [archives.map_columns(cells).withColumnsRenamed({"path": "_path", "row_no": "_pos"})]
    if kind == "docx":
        chunks = archives.document_chunks(contents)
        return [chunks.withColumnRenamed("path", "_path").withColumn("_pos", F.col("chunk_number").cast("bigint") - 1)]
    # Empty slides leave gaps in the numbers of a file's slides.
    rank = F.row_number().over(Window.partitionBy("path").orderBy("slide_number")) - 1
    slides = archives.slide_records(contents).withColumn("_pos", rank.cast("bigint"))
    return [slides.withColumnRenamed("path", "_path")]


def align_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns whose type differs between the parts become text, as a column has one type in a table."""
    seen: dict[str, set[str]] = {}
    for part in parts:
        for field in part.schema.fields:
            if not isinstance(field.dataType, T.NullType):
                seen.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = {name for name, types in seen.items() if len(types) > 1}
    return [
        part.select(
            *[
                js_string(F.col(f"`{f.name}`"), f.dataType).cast("string").alias(f.name) if f.name in mixed else F.col(f"`{f.name}`")
                for f in part.schema.fields
            ]
        )
        for part in parts
    ]


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union by name over the union of all columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), align_types(parts))


def read_dataset(
    spark: SparkSession, inputs: str | Sequence[str], recursive: bool = True, extensions: Iterable[str] | None = None,
    formats: dict[str, str] | None = None, multiline: bool = False,
) -> DataFrame:
    """Read files and folders (a list or a comma-separated text) into one numbered dataset.

    Adds ``_source_file`` and ``row_index``, the position in the merged input: files in the given order,
    folders sorted by path, rows in file order. ``formats`` overrides how an extension is read. ``multiline`` lets cells
    of delimited files hold line breaks, at the price of one task per file.
    """
    names = [p.strip() for p in inputs.split(",")] if isinstance(inputs, str) else list(inputs)
    names = [n for n in names if n]
    if not names:
        raise ValueError("no files to read")
    kinds = {**FORMATS, **(formats or {})}
    manifest = _manifest(spark, names, recursive, extensions)
    found = sorted(manifest.agg(F.collect_set("extension")).first()[0])
    by_kind: dict[str, list[str]] = {}
    for extension in found:
        by_kind.setdefault(kinds[extension], []).append(extension)
    parts = []
    for kind, own in by_kind.items():
        scan = _Scan(spark, list(dict.fromkeys(names)), recursive, own)
        parts += _read_group(scan, kind, manifest.filter(F.col("extension").isin(own)).select("uri").distinct(), multiline)
    merged = merge(parts)
    counts = merged.groupBy(F.col("_path").alias("uri")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        manifest.join(counts, "uri")
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))
        .select(F.col("uri").alias("_path"), "_offset", "_source_file")
    )
    numbered = with_offsets(merged, offsets, ["_path"], manifest.count()).withColumn("row_index", F.col("_offset") + F.col("_pos"))
    return numbered.drop("_path", "_pos", "_offset")


def _manifest(spark: SparkSession, names: list[str], recursive: bool, extensions: Iterable[str] | None) -> DataFrame:
    """``uri``, ``extension``, ``_source_file``, ``file_no``: the files to read as a written table, numbered in order of input and path.

    A path with a known extension is a file, or a folder of parts whose names say how they are read; ``extensions`` chooses
    among the files of other folders.
    """
    lists = []
    for place, name in enumerate(names):
        chosen = None if extension_of(name) in FORMATS else extensions
        lists.append(discover_files(spark, name, recursive, chosen).withColumn("place", F.lit(place)))
    files = reduce(DataFrame.unionAll, lists).withColumn("_source_file", F.url_decode(F.regexp_replace(F.element_at(F.split("uri", "/"), -1), r"\+", "%2B")))
    manifest = with_row_index_by(files, ["place", "uri"], "file_no")
    missing = set(range(len(names))) - set(manifest.agg(F.collect_set("place")).first()[0])
    if missing:
        raise ValueError(f"no supported files found in {names[min(missing)]}")
    return manifest.drop("place")
