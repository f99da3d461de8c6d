"""Office containers: signature sniffing, a validated ZIP reader, and the cells of workbooks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits against hostile archives.
MAX_ENTRIES, MAX_PART, MAX_TOTAL, MAX_RATIO, RATIO_FROM = 20_000, 512 << 20, 2 << 30, 1000, 10 << 20


def signature(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.octet_length(content) < 4, "text").when(head.startswith("504B0304") | head.startswith("504B0506") | head.startswith("504B0708"), "zip").when(head.startswith("D0CF11E0"), "ole").when(head.startswith("89504E47"), "png").when(head.startswith("7B5C"), "rtf").when(head.startswith("25504446"), "pdf").otherwise("text")


def open_zip(data: bytes) -> zipfile.ZipFile:
    """A validated archive; ValueError says why one is refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:
        raise ValueError(f"not a readable archive: {e}") from None
    parts = z.infolist()
    if not parts or len(parts) > MAX_ENTRIES:
        raise ValueError("no parts, or too many")
    total = 0
    for p in parts:
        name = p.filename
        if p.flag_bits & 1:
            raise ValueError(f"encrypted part {name}")
        if name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name) or ":" in name:
            raise ValueError(f"unsafe part name {name}")
        total += p.file_size
        if p.file_size > MAX_PART or total > MAX_TOTAL or p.file_size > RATIO_FROM and p.file_size > MAX_RATIO * max(1, p.compress_size):
            raise ValueError(f"decompression bomb in {name}")
    return z


def part_xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    """A part as XML; None if it is missing, declares a DTD or entities, or is malformed."""
    try:
        with z.open(name) as f:
            raw = f.read(MAX_PART + 1)
        if len(raw) > MAX_PART or b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            return None
        return ET.fromstring(raw)
    except (KeyError, ET.ParseError, zipfile.BadZipFile, NotImplementedError):
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(el: ET.Element) -> str:
    """The joined t elements, without phonetic runs."""
    if _local(el.tag) == "rPh":
        return ""
    return (el.text or "") if _local(el.tag) == "t" else "".join(_text(x) for x in el)


def workbook_cells(data: bytes) -> list[tuple]:
    """(sheet, r, c, t, text) of every cell of an xlsx workbook that has a value."""
    z = open_zip(data)
    names = {n.lstrip("/") for n in z.namelist()}
    rels = {}
    if (x := part_xml(z, "xl/_rels/workbook.xml.rels")) is not None:
        for e in x:
            target = e.get("Target", "")
            rels[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    strings = [_text(e) for e in x] if (x := part_xml(z, "xl/sharedStrings.xml")) is not None else []
    out, book = [], part_xml(z, "xl/workbook.xml")
    for s in [] if book is None else [e for e in book.iter() if _local(e.tag) == "sheet"]:
        path = rels.get(next((v for k, v in s.attrib.items() if _local(k) == "id"), None))
        sheet = part_xml(z, path) if path in names else None
        for row in [] if sheet is None else [e for e in sheet.iter() if _local(e.tag) == "row"]:
            c = 0
            for cell in (e for e in row if _local(e.tag) == "c"):
                m = re.fullmatch(r"([A-Z]{1,3})(\d+)", (cell.get("r") or "").upper())
                c = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(m[1]))) if m else c + 1
                r = int(m[2]) if m else int(row.get("r", 0))
                kind, v = cell.get("t", "n"), next((e.text or "" for e in cell if _local(e.tag) == "v"), None)
                if kind == "inlineStr":
                    v = _text(cell)
                elif kind == "s" and v is not None:
                    v = strings[int(v)] if v.isdigit() and int(v) < len(strings) else ""
                if v is not None and r:
                    out.append((s.get("name"), r, c, kind, v))
    return out


def read_workbooks(files: DataFrame) -> DataFrame:
    """(path, sheet, r, c, t, text, error) from binary files (path, content); a refused file is one row with its reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, b in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(p, *x, None) for x in workbook_cells(bytes(b))]
                except ValueError as e:
                    out.append((p, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sheet", "r", "c", "t", "text", "error"]).astype({"r": "Int32", "c": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, r int, c int, t string, text string, error string")
