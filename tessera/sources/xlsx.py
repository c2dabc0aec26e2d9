"""Workbooks by the standard library: a zip of XML parts, read and written as streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from ..errors import InvalidDataError

# Namespaces and relationship types of the workbook format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _column(reference: str) -> int:
    """Number, from 0, of the column in a cell reference such as ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    """Text of a string item, rich text runs joined and phonetic hints left out."""
    parts = []
    for child in element:
        if child.tag == _tag("t"):
            parts.append(child.text or "")
        elif child.tag == _tag("r"):
            parts += [t.text or "" for t in child.iter(_tag("t"))]
    return "".join(parts)


class Workbook:
    """Sheets of a workbook in their order, rows as lists of strings."""

    def __init__(self, data: bytes):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
            self._sheets = self._find_sheets()
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise InvalidDataError(f"not a workbook: {e}") from e
        self._strings: list[str] | None = None

    def _find_sheets(self) -> list[tuple[str, str]]:
        root = ElementTree.fromstring(self._zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self._zip.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target", "") for x in links}
        found = []
        for sheet in root.iter(_tag("sheet")):
            to = target[sheet.get(f"{{{RELATION}}}id")]
            found.append((sheet.get("name", ""), to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
        return found

    @property
    def sheets(self) -> list[str]:
        return [name for name, _ in self._sheets]

    def _shared(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self._zip.namelist():
                with self._zip.open("xl/sharedStrings.xml") as part:
                    for _, element in ElementTree.iterparse(part):
                        if element.tag == _tag("si"):
                            self._strings.append(_text(element))
                            element.clear()
        return self._strings

    def rows(self, sheet: int) -> Iterator[list[str]]:
        """Rows up to the last one with a cell, gaps as empty ones."""
        shared, expected = self._shared(), 1
        with self._zip.open(self._sheets[sheet][1]) as part:
            for _, element in ElementTree.iterparse(part):
                if element.tag != _tag("row"):
                    continue
                number = int(element.get("r", expected))
                for _ in range(number - expected):
                    yield []
                expected = number + 1
                row: list[str] = []
                for cell in element.iter(_tag("c")):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [""] * (at + 1 - len(row))
                    row[at] = self._value(cell, shared)
                yield row
                element.clear()

    @staticmethod
    def _value(cell: ElementTree.Element, shared: list[str]) -> str:
        kind, value = cell.get("t", "n"), cell.find(_tag("v"))
        if kind == "inlineStr":
            inner = cell.find(_tag("is"))
            return "" if inner is None else _text(inner)
        raw = "" if value is None else value.text or ""
        if kind == "s" and raw:
            return shared[int(raw)]
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
        if kind == "n" and re.fullmatch(r"-?\d+\.0+", raw):
            return raw.split(".")[0]
        return raw


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


#: Characters that XML cannot hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def write_workbook(out, sheet: str, rows: Iterable[list[str]]) -> None:
    """Write one sheet of text cells into a binary stream."""
    name = re.sub(r"[\[\]:*?/\\]", "_", sheet)[:31] or "Sheet1"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(
            f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in (("xl/workbook.xml", "sheet.main"), ("xl/worksheets/sheet1.xml", "worksheet"))
        )
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for i, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", v))}</t></is></c>' for j, v in enumerate(row))
                part.write(f'<row r="{i}">{cells}</row>'.encode())
            part.write(b"</sheetData></worksheet>")
