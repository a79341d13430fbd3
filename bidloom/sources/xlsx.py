"""XLSX as a Spark data source: one row per sheet row, in original coordinates, and the issues that a workbook holds.

``register(spark)`` makes two formats available:
``spark.read.format("xlsx_rows").load(path)`` → workbook, sheet, row_number, cells array<string>
``spark.read.format("xlsx_issues").load(path)`` → workbook, sheet, row_number, column_number, cell, kind, formula, value

Options: ``sheets`` (comma list, only these are read), ``skip`` (comma list), ``max_rows`` per sheet, ``mode`` (PERMISSIVE skips
workbooks that can't be opened, FAILFAST raises). One partition per workbook; sheets are streamed, not loaded.
Everything is standard library: zipfile and ElementTree's incremental parser; document type declarations are refused.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# What a spreadsheet shows for a formula that fails.
ERRORS = re.compile(r"#REF!|#DIV/0!|#VALUE!|#NAME\?|#N/A|#NUM!|#NULL!")
EXTERNAL = re.compile(r"\[[^\]]*\]")
ROWS = "workbook string, sheet string, row_number int, cells array<string>"
ISSUES = "workbook string, sheet string, row_number int, column_number int, cell string, kind string, formula string, value string"


def column_number(reference: str) -> int:
    """1-based column of a reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _events(book: zipfile.ZipFile, name: str):
    with book.open(name) as f:
        if b"<!DOCTYPE" in f.read(2048):
            raise ValueError(f"{name} declares a document type")
    with book.open(name) as f:
        yield from iterparse(f, events=("end",))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name → part, in workbook order."""
    targets = {}
    for _, e in _events(book, "xl/_rels/workbook.xml.rels"):
        if e.tag.endswith("}Relationship"):
            t = e.get("Target", "")
            targets[e.get("Id")] = t.lstrip("/") if t.startswith("/") else "xl/" + t
    return {e.get("name"): targets[e.get(LINK + "id")] for _, e in _events(book, "xl/workbook.xml") if e.tag == MAIN + "sheet" and e.get(LINK + "id") in targets}


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in _events(book, "xl/sharedStrings.xml"):
        if e.tag == MAIN + "si":
            out.append("".join(t.text or "" for t in e.iter(MAIN + "t")))
            e.clear()
    return out


def cells(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[tuple[int, str | None, str | None]]]]:
    """(row number, [(column, value, formula)]) of each row that holds a cell."""
    at = 0
    for _, e in _events(book, part):
        if e.tag != MAIN + "row":
            continue
        at = int(e.get("r") or at + 1)
        row, col = [], 0
        for c in e.iter(MAIN + "c"):
            col = column_number(c.get("r", "")) or col + 1
            v, f, kind = c.find(MAIN + "v"), c.find(MAIN + "f"), c.get("t")
            value = v.text if v is not None else None
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(MAIN + "t"))
            elif kind == "b" and value is not None:
                value = "TRUE" if value == "1" else "FALSE"
            row.append((col, value, f.text if f is not None else None))
        e.clear()
        if row:
            yield at, row


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, issues: bool):
        self.options, self.issues = options, issues

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        found = sorted(glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path))
        return [_Book(p) for p in found]

    def read(self, partition: _Book):
        names = lambda o: {s.strip() for s in self.options.get(o, "").split(",") if s.strip()}
        only, skip, most = names("sheets"), names("skip"), int(self.options.get("max_rows", 0))
        name = os.path.basename(partition.path)
        try:
            book = zipfile.ZipFile(partition.path)
            parts, shared = sheets(book), shared_strings(book)
        except (OSError, zipfile.BadZipFile, KeyError, ValueError):
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                raise
            return
        with book:
            for sheet, part in parts.items():
                if only and sheet not in only or sheet in skip:
                    continue
                for n, row in cells(book, part, shared):
                    if most and n > most:
                        break
                    if self.issues:
                        for col, value, formula in row:
                            shown = f"{formula or ''} {value or ''}"
                            kind = "error" if ERRORS.search(shown) else "external link" if formula and EXTERNAL.search(formula) else None
                            if kind:
                                yield name, sheet, n, col, _name(col) + str(n), kind, formula, value
                    else:
                        width = max((c for c, v, _ in row if v not in (None, "")), default=0)
                        line = [None] * width
                        for c, v, _ in row:
                            if c <= width:
                                line[c - 1] = v
                        if width:
                            yield name, sheet, n, line


def _name(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


class XlsxRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), issues=False)


class XlsxIssues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_issues"

    def schema(self) -> str:
        return ISSUES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), issues=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxRows)
    spark.dataSource.register(XlsxIssues)


def list_sheets(path: str) -> list[str]:
    with zipfile.ZipFile(path) as book:
        return list(sheets(book))


def write_xlsx(path: str, tables: dict[str, list[list]]) -> None:
    """A plain workbook from small tables (reports and tests); text that could run as a formula is written as text. Sheets split at 1,048,575 rows."""
    from xml.sax.saxutils import escape

    parts: dict[str, list[list]] = {}
    for name, rows in tables.items():
        base, most = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet", 1_048_575
        for k in range(0, max(1, len(rows)), most):
            title, i = base, 2
            while title.lower() in {p.lower() for p in parts}:
                title, i = f"{base[: 30 - len(str(i))]}_{i}", i + 1
            parts[title] = rows[k : k + most]

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if isinstance(v, tuple):  # (formula, cached value)
            return f'<c r="{ref}" t="str"><f>{escape(v[0])}</f><v>{escape(str(v[1]))}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, office = MAIN[1:-1], LINK[1:-1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(parts) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(parts, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        for i, rows in enumerate(parts.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(f"{_name(c)}{n}", v) for c, v in enumerate(row, 1)) + "</row>" for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
