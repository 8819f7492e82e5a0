"""Workbooks (.xlsx, .xlsm) as a Spark source and sink on the standard library: zip archives of XML.

``spark.read.format("xlsx").load(path)`` gives cells in long form; option ``mode=sheets`` only the catalogue of sheets,
read from the workbook part alone. Options ``include`` and ``exclude`` (sheet names, separated by newlines; include first)
and ``max_rows`` limit what is parsed. Each file is a partition of its own and is read as a stream of rows.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "file string, sheet string, sheet_idx int, row_idx int, col_idx int, col_name string, value string"
SHEETS = "file string, sheet string, sheet_idx int"
# XML namespaces of the format, built-in date formats, and texts that read as missing.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MISSING = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
SUPPORTED = (".xlsx", ".xlsm")


class UnsupportedWorkbook(ValueError):
    """A workbook format that needs more than zip and XML (.xls, .xlsb)."""


def list_files(path: str, extensions: tuple[str, ...] = SUPPORTED, recursive: bool = True) -> list[str]:
    """Sorted files with these extensions, without the temporary files of office programs."""
    path = path.removeprefix("file://")
    if os.path.isfile(path) or not os.path.isdir(path):
        return [path]
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if recursive or d == path]
    return sorted(f for f in found if os.path.splitext(f)[1].lower() in extensions and not os.path.basename(f).startswith("~$"))


def _name(book: zipfile.ZipFile, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part) in the workbook's order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name"), _name(book, rels[s.get(f"{REL}id")])) for s in sheets]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())}
    xfs = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | custom}


def column_index(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    v = cell.find(f"{MAIN}v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n" and int(cell.get("s", -1)) in dates:
        at = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v.text))
        return str(at.replace(microsecond=0))
    return v.text


def rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int]) -> Iterator[tuple[int, dict[int, str | None]]]:
    """(row number from 0, values by column) of a sheet, one row in memory at a time."""
    nth = -1
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            nth = int(e.get("r")) - 1 if e.get("r") else nth + 1
            values: dict[int, str | None] = {}
            for k, c in enumerate(e.iter(f"{MAIN}c")):
                values[column_index(c.get("r")) if c.get("r") else k] = _value(c, shared, dates)
            e.clear()
            yield nth, values


def read_cells(path: str, include: list[str] | None = None, exclude: list[str] | None = None, max_rows: int | None = None) -> Iterator[tuple]:
    """The cells below each sheet's header row, all columns of the header in each row; texts that read as missing are null."""
    if not path.lower().endswith(SUPPORTED):
        raise UnsupportedWorkbook(f"{path}: only {', '.join(SUPPORTED)} can be read")
    with zipfile.ZipFile(path) as book:
        shared, dates = _shared(book), _date_styles(book)
        for k, (sheet, part) in enumerate(sheet_parts(book)):
            if include and sheet not in include or exclude and sheet in exclude:
                continue
            header: list[str] | None = None
            n = 0
            for _, values in rows(book, part, shared, dates):
                if header is None:
                    header = [values.get(c) or f"Unnamed: {c}" for c in range(max(values, default=-1) + 1)]
                    continue
                if max_rows is not None and n >= max_rows:
                    break
                for c in range(max(len(header), max(values, default=-1) + 1)):
                    v = values.get(c)
                    yield path, sheet, k, n, c, header[c] if c < len(header) else f"Unnamed: {c}", None if v is None or v in MISSING else v
                n += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        names = lambda k: [x for x in (options.get(k) or "").split("\n") if x] or None
        self.include, self.exclude = names("include"), names("exclude")
        self.max_rows = int(options["max_rows"]) if options.get("max_rows") else None
        self.sheets = options.get("mode") == "sheets"

    def partitions(self):
        files = list_files(self.options["path"])
        glob = self.options.get("pathglobfilter")
        return [_File(f) for f in files if not glob or fnmatch.fnmatch(os.path.basename(f), glob)]

    def read(self, partition):
        if self.sheets:
            with zipfile.ZipFile(partition.path) as book:
                for k, (sheet, _) in enumerate(sheet_parts(book)):
                    if not (self.include and sheet not in self.include or self.exclude and sheet in self.exclude):
                        yield partition.path, sheet, k
        else:
            yield from read_cells(partition.path, self.include, self.exclude, self.max_rows)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SHEETS if self.options.get("mode") == "sheets" else CELLS

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(dict(self.options))


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets, each a list of rows (the first is the header); numbers and booleans keep their type."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{column_letters(c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = range(1, len(sheets) + 1)
        office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{office}.worksheet+xml"/>' for k in ids) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(ids, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{k}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids) + "</Relationships>")
        for k, table in zip(ids, sheets.values(), strict=True):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(table))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
