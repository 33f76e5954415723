"""Readers for zipped office documents: workbook rows, document text XML and slide XML."""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SLIDE = re.compile(r"^ppt/slides/slide(\d+)\.xml$")


def _first_sheet_name(archive: zipfile.ZipFile) -> str | None:
    workbook = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    sheet = workbook.find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        return None
    targets = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    for relation in targets:
        if relation.get("Id") == sheet.get(_RELATION):
            target = relation.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _column_of(reference: str) -> int:
    number = 0
    for char in reference:
        if not char.isalpha():
            break
        number = number * 26 + ord(char.upper()) - 64
    return number - 1


class SharedStrings:
    """The shared texts of a workbook, end to end in one buffer; no object per text."""

    def __init__(self, archive: zipfile.ZipFile):
        self._bytes, self._ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" not in archive.namelist():
            return
        with archive.open("xl/sharedStrings.xml") as stream:
            for item in _elements(stream, f"{_MAIN}si"):
                self._bytes += "".join(t.text or "" for t in item.iter(f"{_MAIN}t")).encode()
                self._ends.append(len(self._bytes))

    def __getitem__(self, at: int) -> str:
        if not 0 <= at < len(self._ends) - 1:
            raise ValueError(f"workbook names shared text {at} of {len(self._ends) - 1}")
        return self._bytes[self._ends[at] : self._ends[at + 1]].decode()


def _elements(stream: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements called ``tag`` as they are read; each is emptied and let go after its turn."""
    events = ElementTree.iterparse(stream, events=("start", "end"))
    open_elements: list[ElementTree.Element] = []
    for event, element in events:
        if event == "start":
            open_elements.append(element)
            continue
        open_elements.pop()
        if element.tag == tag:
            yield element
            element.clear()
            if open_elements:
                open_elements[-1].remove(element)


def _cell_text(cell: ElementTree.Element, shared: SharedStrings) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


class _Headers:
    """Names of columns by position: those of the first row; blank ones are numbered, and so are repeated ones."""

    def __init__(self, first: dict[int, str]):
        self._first, self._names, self._seen = first, [], {}

    def __getitem__(self, at: int) -> str:
        while len(self._names) <= at:
            base = self._first.get(len(self._names)) or "__EMPTY"
            count = self._seen[base] = self._seen.get(base, -1) + 1
            self._names.append(f"{base}_{count}" if count else base)
        return self._names[at]


def workbook_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of the first sheet as they are read, keyed by the header row; blank cells are left out, blank rows skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = _first_sheet_name(archive)
        if name is None:
            raise ValueError("workbook has no sheets")
        shared, headers = SharedStrings(archive), None
        with archive.open(name) as stream:
            for row in _elements(stream, f"{_MAIN}row"):
                cells = {}
                for at, cell in enumerate(row.findall(f"{_MAIN}c")):
                    text = _cell_text(cell, shared)
                    if text is not None:
                        cells[_column_of(cell.get("r")) if cell.get("r") else at] = text
                if headers is None:
                    headers = _Headers(cells)
                elif cells:
                    yield {headers[at]: text for at, text in sorted(cells.items())}


def document_xml(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return archive.read("word/document.xml").decode("utf-8")


def slide_xmls(content: bytes) -> list[tuple[int, str]]:
    """``(slide number, XML)`` in slide order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        slides = [(int(m.group(1)), n) for n in archive.namelist() if (m := _SLIDE.match(n))]
        return [(number, archive.read(name).decode("utf-8")) for number, name in sorted(slides)]
