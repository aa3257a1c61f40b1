"""Excel workbooks from their bytes, on the standard library alone.

Sheets are read as streams, from any row on. Cells come as text, dates in ISO form: typing
belongs to cleaning.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from lodeline.functions.columns import spark_names, unique_names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
EPOCH = datetime(1899, 12, 30)
# The tags that cut a sheet into rows, with any prefix, and the name spaces of its root.
ROOT, SPACE = re.compile(rb"<(?:[\w.-]+:)?worksheet\b[^>]*>"), re.compile(rb"""xmlns(?::[\w.-]+)?=(?:"[^"]*"|'[^']*')""")
ROW, ENDS, CLOSE = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])"), re.compile(rb"/?>"), re.compile(rb"</(?:[\w.-]+:)?row\s*>")


def opened(raw: bytes | BinaryIO) -> zipfile.ZipFile:
    """A workbook from its bytes or an open file, of which only the parts asked for are read."""
    try:
        return zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    except (zipfile.BadZipFile, ValueError) as e:  # the second where a file is too short to look for its end
        raise ValueError("The file is not a valid Excel workbook.") from e


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        target = targets[s.get(RELATION)]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)))
    return out


def sheet_names(raw: bytes | BinaryIO) -> list[str]:
    with opened(raw) as book:
        return [name for name, _ in sheets(book)]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out, root = [], None
    with book.open("xl/sharedStrings.xml") as stream:
        for event, x in ElementTree.iterparse(stream, ("start", "end")):
            if root is None:
                root = x
            if event == "end" and x.tag == MAIN + "si":
                out.append("".join(t.text or "" for t in x.iter(MAIN + "t")))
                root.clear()
    return out


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(MAIN + "numFmt")}
    formats = root.find(MAIN + "cellXfs")
    found = set()
    for k, x in enumerate(formats if formats is not None else ()):
        n = int(x.get("numFmtId", 0))
        if n in DATE_FORMATS or re.search(r"[ymdhs]", own.get(n, ""), re.I):
            found.add(k)
    return found


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(n: int) -> str:
    """Letters of the n-th column, from 1."""
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cell_text(cell, strings: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(MAIN + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        at = EPOCH + timedelta(days=float(value.text))
        at = (at + timedelta(microseconds=500_000)).replace(microsecond=0)
        return at.strftime("%Y-%m-%d %H:%M:%S")
    return value.text


def row_elements(stream: BinaryIO, first: int = 0, size: int = 1 << 20) -> Iterator[tuple[bytes, bytes]]:
    """(name spaces of the sheet, a row's element) from the row number ``first``
    on. Rows before it are only looked for, not parsed."""
    held, spaces, at, k = b"", None, 0, 0
    more = True
    while more or at < len(held):
        if spaces is None and (root := ROOT.search(held)):
            spaces = b" ".join(SPACE.findall(root[0]))
        begin = ROW.search(held, at) if spaces is not None else None
        end = begin and ENDS.search(held, begin.end() - 1)
        if end and end[0] != b"/>":
            end = CLOSE.search(held, end.end())
        if begin and end:
            if k >= first:
                yield spaces, held[begin.start() : end.end()]
            k, at = k + 1, end.end()
            continue
        if not more:
            return
        # What is left may hold the beginning of a tag.
        held, at = held[begin.start() if begin else max(at, len(held) - 64) if spaces is not None else 0 :], 0
        block = stream.read(size)
        held, more = held + block, bool(block)


def sheet_rows(book: zipfile.ZipFile, part: str, first: int = 0, most: int | None = None, size: int = 1_000) -> Iterator[list[str | None]]:
    """Rows of a sheet from number ``first`` on, parsed in groups that are let go after they are read."""
    strings, dates = shared_strings(book), date_styles(book)
    with book.open(part) as stream:
        elements = islice(row_elements(stream, first), most)
        while group := list(islice(elements, size)):
            root = ElementTree.fromstring(b"<rows " + group[0][0] + b">" + b"".join(x for _, x in group) + b"</rows>")
            for row in root:
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(MAIN + "c")):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    out[at] = cell_text(cell, strings, dates)
                yield out


def size_of(book: zipfile.ZipFile, part: str) -> int | None:
    """The number of rows that a sheet says it has, in its first bytes."""
    with book.open(part) as stream:
        found = re.search(rb'dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', stream.read(1 << 14))
    return int(found[1]) if found else None


def named(header: list[str | None]) -> list[str]:
    return spark_names(unique_names(h or f"Unnamed: {k}" for k, h in enumerate(header)))


def part_of(book: zipfile.ZipFile, sheet: str | None) -> str:
    part = next((part for name, part in sheets(book) if sheet in (None, name)), None)
    if part is None:
        raise ValueError(f"The workbook has no sheet named {sheet!r}.")
    return part


def layout(raw: bytes | BinaryIO, sheet: str | None = None) -> tuple[str, list[str]]:
    """(part of a sheet, names of its columns)."""
    with opened(raw) as book:
        part = part_of(book, sheet)
        return part, named(next(sheet_rows(book, part, most=1), []))


def blocks(raw: bytes | BinaryIO, part: str, width: int, first: int = 0, most: int | None = None, size: int = 5_000) -> Iterator[list[tuple]]:
    """Rows below the header from number ``first`` on, numbered and of one width, in blocks."""
    with opened(raw) as book:
        numbered = ((k, *(row + [None] * width)[:width]) for k, row in enumerate(sheet_rows(book, part, first + 1, most), first))
        while block := list(islice(numbered, size)):
            yield block


def write_sheet(out: BinaryIO, name: str, rows: Iterator[tuple], size: tuple[int, int]) -> None:
    """A workbook of one sheet of (rows, columns), written as its rows come:
    texts in the cells, numbers as numbers."""

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, office = MAIN[1:-1], RELATION[1:-3]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        links = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        book.writestr("_rels/.rels", f'<Relationships {links}><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {links}><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{main}"><dimension ref="A1:{column_letters(size[1])}{size[0]}"/><sheetData>'.encode())
            for row in rows:
                sheet.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
            sheet.write(b"</sheetData></worksheet>")
