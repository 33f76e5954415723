"""Office documents made from table rows inside Spark tasks, as input for the archive queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.batches import slices

_WORKBOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_RELATIONS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
)
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def _zip(entries: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            archive.writestr(name, text)
    return buffer.getvalue()


def workbook(columns: list[str], rows: list[list], shared: bool = False) -> bytes:
    """Texts stand in their cells, or with ``shared`` in a table of different texts that cells point to."""
    texts: dict[str, int] = {}

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)):
            return f"<c><v>{value}</v></c>"
        if shared:
            return f'<c t="s"><v>{texts.setdefault(str(value), len(texts))}</v></c>'
        return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in [columns, *rows])
    entries = {"xl/workbook.xml": _WORKBOOK, "xl/_rels/workbook.xml.rels": _RELATIONS, "xl/worksheets/sheet1.xml": _SHEET.format(body)}
    if shared:
        # Each text in two runs, as texts with formats are.
        items = "".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r></si>" for t in texts)
        entries["xl/sharedStrings.xml"] = f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{items}</sst>'
    return _zip(entries)


def document(paragraphs: list[str]) -> bytes:
    """Each paragraph in two runs, split at its middle."""
    def runs(text: str) -> str:
        half = len(text) // 2
        return "".join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in (text[:half], text[half:]))

    body = "".join(f"<w:p>{runs(p)}</w:p>" for p in paragraphs)
    return _zip({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"})


def deck(slides: list[list[str]]) -> bytes:
    return _zip(
        {
            f"ppt/slides/slide{i + 1}.xml": "<p:sld>" + "".join(f"<a:t>{escape(t)}</a:t>" for t in texts) + "</p:sld>"
            for i, texts in enumerate(slides)
        }
    )


def as_workbooks(df: DataFrame, shared: bool = False) -> DataFrame:
    """``(path, content)``: one workbook per Arrow batch of rows."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = frame.astype(object).values.tolist()
            yield pd.DataFrame({"path": [f"book-{rows[0][0]}.xlsx"], "content": [workbook(columns, rows, shared)]})

    return df.mapInPandas(run, "path string, content binary")


def _files(df: DataFrame, make: Callable[[list[str]], bytes]) -> DataFrame:
    """``(path, content)``: one file per row of ``(id, lines)``; a null text has no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            content = [make(lines or []) for lines in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    return df.select(F.col("id").cast("string"), "lines").mapInArrow(run, "path string, content binary")


def as_documents(df: DataFrame) -> DataFrame:
    """``(path, content)``: one document per row of ``(id, lines)``."""
    return _files(df, document)


def as_decks(df: DataFrame) -> DataFrame:
    """``(path, content)``: one deck per row, a slide per line, and a slide text per word."""
    return _files(df, lambda lines: deck([line.split(" ") for line in lines]))


def join_files(spark: SparkSession, source: str, target: str) -> None:
    """The part files of the folder ``source``, in the order of their names, as one file; a task copies them by blocks."""

    def address(path: str) -> str:
        return path if "://" in path else f"file://{path.removeprefix('file:')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(address(source))
        attempt = f"{target}.{TaskContext.get().taskAttemptId()}"
        for _ in batches:
            parts = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.base_name.startswith("part-")]
            size = 0
            with fs.open_output_stream(pyarrow.fs.FileSystem.from_uri(address(attempt))[1], compression=None) as out:
                for part in sorted(parts, key=lambda f: f.base_name):
                    with fs.open_input_stream(part.path, compression=None) as stream:
                        while block := stream.read(1 << 20):
                            size += len(block)
                            out.write(block)
            # A file has its name only when it is whole.
            fs.move(*(pyarrow.fs.FileSystem.from_uri(address(x))[1] for x in (attempt, target)))
            yield pa.RecordBatch.from_arrays([pa.array([size])], names=["size"])

    spark.range(1, numPartitions=1).mapInArrow(run, "size long").collect()
