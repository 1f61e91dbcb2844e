"""Heads and row counts of spreadsheet workbooks (zip archives of XML), in bounded memory.

The sheets are streamed first: of each, the head is kept with the numbers of the shared strings that it names, and rows are counted. Then the
shared strings are streamed once, as far as the last of those numbers, and only those are kept. So neither a sheet nor the table of strings is ever
held, whatever their size.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable
from typing import BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat

# Bytes of a sheet beyond which its rows are not counted, cells kept of a head, sheets that are opened, rows that may hold the head.
COUNTED, CELLS, SHEETS, HEAD_ROWS = 100 << 20, 4096, 64, 8
_BLOCK = 1 << 16

Cell = tuple[bool, str]  # whether it names a shared string, and its text


class _Enough(Exception):
    """Nothing more is wanted of this part."""


def _stream(part: BinaryIO, start: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None]) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: start(name.rsplit(":", 1)[-1], attributes)
    parser.EndElementHandler = lambda name: end(name.rsplit(":", 1)[-1])
    parser.CharacterDataHandler = text
    try:
        while block := part.read(_BLOCK):
            parser.Parse(block, False)
        parser.Parse(b"", True)
    except _Enough:
        pass


class _Sheet:
    """What a sheet's stream tells: its head, its rows, and the rows that it declares."""

    def __init__(self, counted: bool):
        self.counted, self.rows, self.declared = counted, 0, None
        self.head: list[Cell] | None = None
        self.above = 0  # rows over the head
        self._first: list[Cell] = []  # the first row with cells
        self._row: list[Cell] = []
        self._cell: tuple[bool, bool] | None = None  # of the open cell: shared, inline
        self._text: list[str] | None = None

    def start(self, name: str, attributes: dict) -> None:
        if name == "row":
            if self.head is not None and not self.counted:
                raise _Enough
            self.rows += 1
            self._row = []
        elif name == "dimension":
            last = re.search(r"(\d+)\s*$", attributes.get("ref", ""))
            self.declared = int(last[1]) if last else None
        elif self.head is None:
            if name == "c" and len(self._row) < CELLS:
                self._cell, self._row = (attributes.get("t") == "s", attributes.get("t") == "inlineStr"), [*self._row, (attributes.get("t") == "s", "")]
            elif self._cell is not None and name == ("t" if self._cell[1] else "v"):
                self._text = []

    def text(self, data: str) -> None:
        if self._text is not None:
            self._text.append(data)

    def end(self, name: str) -> None:
        if self._text is not None and name in ("t", "v"):
            shared, so_far = self._row[-1]
            self._row[-1], self._text = (shared, so_far + "".join(self._text)), None
        elif name == "c":
            self._cell = None
        elif name == "row" and self.head is None:
            self._first = self._first or self._row
            if sum(shared or bool(value.strip()) for shared, value in self._row) >= 2:
                self.head, self.above = self._row, self.rows - 1
            elif self.rows >= HEAD_ROWS:
                self.head = self._first or self._row

    def result(self) -> tuple[list[Cell], dict]:
        head, below = self.head if self.head is not None else self._first, self.above + 1
        if not self.counted:
            if self.declared is None:
                return head, {"row_count": None, "row_count_exact": False, "row_count_reason": "no_dimension"}
            return head, {"row_count": max(self.declared - below, 0), "row_count_exact": False, "row_count_reason": "size_gated"}
        if not self.rows:
            return [], {"row_count": 0, "row_count_exact": True, "row_count_reason": "empty"}
        return head, {"row_count": max(self.rows - below, 0), "row_count_exact": True}


def _head(book: zipfile.ZipFile, part: str | None, counted: int) -> tuple[list[Cell], dict]:
    unread = {"row_count": None, "row_count_exact": False, "row_count_reason": "read_error"}
    if part is None or part not in book.namelist():
        return [], unread
    sheet = _Sheet(book.getinfo(part).file_size <= counted)
    try:
        with book.open(part) as stream:
            _stream(stream, sheet.start, sheet.end, sheet.text)
    except (expat.ExpatError, OSError, zipfile.BadZipFile):
        return sheet.head or [], unread
    return sheet.result()


def shared_strings(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of some numbers."""
    found: dict[int, str] = {}
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return found
    at, last, open_ = -1, max(wanted), False

    def start(name: str, _: dict) -> None:
        nonlocal at, open_
        if name == "si":
            at += 1
            if at > last:
                raise _Enough
        elif name == "t":
            open_ = at in wanted

    def text(data: str) -> None:
        if open_:
            found[at] = found.get(at, "") + data

    def end(name: str) -> None:
        nonlocal open_
        open_ = open_ and name != "t"

    try:
        with book.open("xl/sharedStrings.xml") as stream:
            _stream(stream, start, end, text)
    except (expat.ExpatError, OSError, zipfile.BadZipFile):
        pass
    return found


def _parts(book: zipfile.ZipFile) -> list[tuple[str, str | None]]:
    """(name, part) of the sheets in workbook order; a sheet whose relationship is missing has the part of its position, if that is there."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        listed = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
    except (KeyError, ElementTree.ParseError):
        return []
    try:
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (KeyError, ElementTree.ParseError):
        links = {}
    names, found = set(book.namelist()), []
    for position, sheet in enumerate(listed, 1):
        link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        target = links.get(link, "").lstrip("./")
        part = (target if target.startswith("xl/") else f"xl/{target}") if target else f"xl/worksheets/sheet{position}.xml"
        found.append((sheet.get("name", ""), part if target or part in names else None))
    return found


def describe_workbook(path: str, counted: int = COUNTED) -> dict:
    """Sheets in workbook order with their columns and rows; nothing for a file that is no archive.

    A head is the first of HEAD_ROWS rows with two filled cells, else the first row with cells. Rows below it are counted, or taken from
    the declared range where a sheet is larger than `counted`. Sheets beyond SHEETS are only named.
    """
    try:
        book = zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError):
        return {}
    with book:
        parts = _parts(book)
        heads = [_head(book, part, counted) for _, part in parts[:SHEETS]]
        number = lambda text: int(text) if text.strip().isdigit() else -1
        strings = shared_strings(book, {number(v) for cells, _ in heads for shared, v in cells if shared} - {-1})
        sheets = []
        for (name, _), (cells, counts) in zip(parts, heads):
            columns = [(strings.get(number(v), "") if shared else v).strip() for shared, v in cells]
            sheets.append({"name": name, "columns": columns, "n_columns": len(columns)} | counts)
    closed = {"columns": [], "n_columns": 0, "row_count": None, "row_count_exact": False, "row_count_reason": "sheet_cap"}
    sheets += [{"name": name} | closed for name, _ in parts[SHEETS:]]
    if not sheets:
        return {}
    found = {"n_sheets": len(sheets), "sheet_names": [s["name"] for s in sheets], "sheets": sheets}
    if len(sheets) == 1:  # only then has the workbook one shape
        found |= {"primary_sheet": sheets[0]["name"]} | {k: v for k, v in sheets[0].items() if k != "name"}
    return found
