"""Office documents as table jobs.

Input is any DataFrame with ``path`` and ``content``, such as ``spark.read.format("binaryFile")``. Python
only opens the archives; text rules run on columns afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.archives import document_xml, slide_xmls, workbook_rows
from evalspark.functions.batches import pieces, slices
from evalspark.functions.text import trim_ws
from evalspark.operators.chunking import chunk_rows


_DOCUMENTS = pa.schema([("path", pa.string()), ("xml", pa.string())])
_SLIDES = pa.schema([("path", pa.string()), ("slide_number", pa.int32()), ("xml", pa.string())])


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """``(path, content)`` of each archive; a slice of a batch at a time becomes Python objects."""
    for part in slices(batches):
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for piece in pieces(rows, lambda row: len(row[-1])):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece), schema)], schema=schema)


def workbook_cells(files: DataFrame) -> DataFrame:
    """``(path, row_no, cells)``: one row per data row of each first sheet, cells as a map of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                start = 0
                for part in batched(workbook_rows(bytes(content)), 10_000):
                    yield pd.DataFrame({"path": path, "row_no": range(start, start + len(part)), "cells": list(part)})
                    start += len(part)

    return files.select("path", "content").mapInPandas(run, "path string, row_no long, cells map<string,string>")


def map_columns(df: DataFrame, column: str = "cells", names: list[str] | None = None) -> DataFrame:
    """Turn a map column into columns. Without ``names`` the distinct keys are looked up: one per column."""
    if names is None:
        keys = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k")
        names = [r["k"] for r in keys.collect()]
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[n].alias(n) for n in names])


def document_paragraphs(files: DataFrame) -> DataFrame:
    """``(path, paragraphs)``: text runs of each paragraph joined, blank paragraphs dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((path, document_xml(content)) for path, content in _archives(batches)), _DOCUMENTS)

    xml = files.select("path", "content").mapInArrow(run, "path string, xml string")
    found = F.regexp_extract_all("xml", F.lit(r"(<w:p[ >][\s\S]*?</w:p>)"), 1)
    texts = F.transform(
        found, lambda p: trim_ws(F.array_join(F.regexp_extract_all(p, F.lit(r"<w:t[^>]*>([^<]*)</w:t>"), 1), ""))
    )
    return xml.select("path", F.filter(texts, lambda t: t != "").alias("paragraphs"))


def document_chunks(files: DataFrame) -> DataFrame:
    """``(path, chunk_number, content, word_count)`` of word-processing documents."""
    return chunk_rows(document_paragraphs(files), ["path"], F.col("paragraphs"), "\n")


def slide_records(files: DataFrame) -> DataFrame:
    """``(path, slide_number, title, content)`` of the slides that hold text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, *slide) for path, content in _archives(batches) for slide in slide_xmls(content))
        return _batches(rows, _SLIDES)

    xml = files.select("path", "content").mapInArrow(run, "path string, slide_number int, xml string")
    runs = F.transform(F.regexp_extract_all("xml", F.lit("<a:t>([^<]*)</a:t>"), 1), trim_ws)
    texts = F.filter(runs, lambda t: t != "")
    return (
        xml.select("path", "slide_number", texts.alias("texts"))
        .filter(F.size("texts") > 0)
        .select("path", "slide_number", F.element_at("texts", 1).alias("title"), F.array_join("texts", "\n").alias("content"))
    )
