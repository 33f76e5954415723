"""The first record of each of many files, in one job that reads only the beginnings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_BYTES = 1 << 16
SNIFFED = "path string, cells array<string>"


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path is in, and the path there. Spark prints local paths as ``file:/x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def first_record(start: bytes, complete: bool, separator: str) -> list[str] | None:
    """Cells of the first record that isn't blank; None where ``start`` breaks off within it.

    A file without one gives no cells.
    """
    text = start.decode("utf-8-sig", errors="strict" if complete else "ignore")
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=separator)
    found = [row for _, row in zip(range(2), (r for r in rows if any(c.strip() for c in r)))]
    if not found:
        return [] if complete else None
    if len(found) == 1 and not complete:
        # The record may go on behind the bytes at hand.
        return None
    return [c.strip() for c in found[0]]


def _read(path: str, separator: str) -> list[str]:
    store, inner = open_store(path)
    with store.open_input_stream(inner) as stream:
        start, size = b"", FIRST_BYTES
        while True:
            more = stream.read(size)
            start += more
            found = first_record(start, not more, separator)
            if found is not None:
                return found
            size *= 2


def _reachable(path: str) -> bool:
    try:
        open_store(path)
    except Exception:  # noqa: BLE001 - any scheme that only Spark's readers know
        return False
    return True


def first_records(files: DataFrame, separator: str) -> DataFrame:
    """``path``, ``cells`` of the first record of each file of ``files(uri)``; a file without any has no cells.

    Tasks open files by address and stop behind the first record. Files in a store that only Spark's readers open are read
    by these instead, as a whole.
    """
    spark = files.sparkSession
    sample = files.first()
    if sample is None:
        return spark.createDataFrame([], SNIFFED)

    if _reachable(sample["uri"]):

        def sniff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"path": frame["uri"], "cells": [_read(p, separator) for p in frame["uri"]]})

        return files.select("uri").mapInPandas(sniff, SNIFFED)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "cells": [first_record(c, True, separator) for c in frame["content"]]})

    paths = [unquote(r["uri"]) for r in files.select("uri").toLocalIterator()]
    content = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    return content.mapInPandas(parse, SNIFFED)
