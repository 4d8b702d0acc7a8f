"""Cells of an ``.xlsx`` package, streamed (zip of XML parts)."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

# XML namespaces and built-in date formats of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_COMMON = ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml")
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

Row = tuple[str, int, list[str | None], list[str | None]]


def packages_of_sheets(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(sheet, package with only that sheet's cells) for each sheet of a workbook.

    Parts are unpacked and packed again one after the other; no cell is parsed.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        book = ElementTree.fromstring(package.read("xl/workbook.xml"))
        of_sheet = {s.get("name"): _part_of(package, s) for s in book.iter(f"{_MAIN}sheet")}
        common = [n for n in _COMMON if n in package.namelist()]
        for sheet, part in of_sheet.items():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as one:
                for name in (*common, part):
                    if name in package.namelist():
                        one.writestr(name, package.read(name))
            yield sheet, out.getvalue()


def _part_of(package: zipfile.ZipFile, sheet: ElementTree.Element) -> str:
    """Name of the part with the sheet's cells."""
    targets = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))
    }
    return posixpath.normpath(posixpath.join("/xl", targets[sheet.get(_REL_ID)])).lstrip("/")


def sheet_rows(stream: IO[bytes]) -> Iterator[Row]:
    """(sheet, row number, cell kinds, cell texts) of each non-blank row, of the sheets that are there.

    Kinds are int, float, bool, date, text, or None for an empty or error cell.
    """
    with zipfile.ZipFile(stream) as package:
        book = ElementTree.fromstring(package.read("xl/workbook.xml"))
        settings = book.find(f"{_MAIN}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        epoch = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
        strings = _shared_strings(package)
        date_styles = _date_styles(package)
        for sheet in book.iter(f"{_MAIN}sheet"):
            name = _part_of(package, sheet)
            if name not in package.namelist():  # in another package
                continue
            with package.open(name) as part:
                row_no = 0
                for row in _elements(part, "row"):
                    cells = [_cell(c, strings, date_styles, epoch) for c in row.iter(f"{_MAIN}c")]
                    kinds, texts = _in_columns(cells)
                    if any(t is not None for t in texts):
                        yield sheet.get("name"), row_no, kinds, texts
                        row_no += 1


def _elements(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """Each element once complete; finished ones are let go of."""
    parents = []
    for event, element in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag == _MAIN + tag:
            yield element
            if parents:
                parents[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """Plain or rich text, without phonetic hints."""
    runs = [element.find(f"{_MAIN}t"), *[r.find(f"{_MAIN}t") for r in element.iter(f"{_MAIN}r")]]
    return "".join(t.text or "" for t in runs if t is not None)


def _shared_strings(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    with package.open("xl/sharedStrings.xml") as part:
        return [_text(item) for item in _elements(part, "si")]


def _date_styles(package: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a date."""
    if "xl/styles.xml" not in package.namelist():
        return set()
    styles = ElementTree.fromstring(package.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in styles.iter(f"{_MAIN}numFmt"):
        # quoted text, escapes and [colours] say nothing about the kind
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code.lower()):
            dates.add(int(fmt.get("numFmtId")))
    cells = styles.find(f"{_MAIN}cellXfs")
    formats = [] if cells is None else cells.findall(f"{_MAIN}xf")
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in dates}


def _cell(
    cell: ElementTree.Element, strings: list[str], date_styles: set[int], epoch: dt.datetime
) -> tuple[str | None, str | None, str | None]:
    """(reference, kind, text)."""
    ref, kind = cell.get("r"), cell.get("t", "n")
    if kind == "inlineStr":
        inner = cell.find(f"{_MAIN}is")
        return ref, "text", None if inner is None else _text(inner)
    value = cell.findtext(f"{_MAIN}v")
    if value is None or value == "" or kind == "e":
        return ref, None, None
    if kind == "s":
        return ref, "text", strings[int(value)]
    if kind == "str":
        return ref, "text", value
    if kind == "b":
        return ref, "bool", "true" if value == "1" else "false"
    if kind == "d":
        return ref, "date", value
    number = float(value)
    if int(cell.get("s", 0)) in date_styles:
        moment = epoch + dt.timedelta(milliseconds=round(number * 86_400_000))
        return ref, "date", moment.isoformat(sep=" ")
    if number.is_integer() and abs(number) < 2**63:
        return ref, "int", str(int(number))
    return ref, "float", repr(number)


def _in_columns(cells: list) -> tuple[list[str | None], list[str | None]]:
    """Cells at the position their reference names; a cell without one follows the last."""
    kinds: list[str | None] = []
    texts: list[str | None] = []
    for ref, kind, text in cells:
        at = _column(ref) if ref else len(texts)
        while len(texts) < at:
            kinds.append(None)
            texts.append(None)
        kinds.append(kind)
        texts.append(text)
    return kinds, texts


def _column(ref: str) -> int:
    """``"C7"`` -> 2."""
    out = 0
    for letter in ref:
        if not letter.isalpha():
            break
        out = out * 26 + ord(letter.upper()) - ord("A") + 1
    return out - 1
