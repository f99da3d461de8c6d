"""Workbooks as records: sheets, cells, rows, columns, merges, links, filters, conditional formats, styles; also open-document sheets."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from gridloom.sources.packages import Package, Record, attr, bit, every, kid, kids, local

#: Repeats of open-document rows and columns go no further than this.
MAX_ROW_REPEAT, MAX_COLUMN_REPEAT = 5000, 1000
_REF = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")


def column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def rectangle(ref: str) -> tuple[int, int, int, int] | None:
    """(r1, c1, r2, c2) of a reference like $A$1:B2, after its sheet; the corners in order."""
    found = [(int(m[2]), column(m[1])) for m in _REF.finditer(ref.rpartition("!")[2].upper())][:2]
    if not found:
        return None
    (r1, c1), (r2, c2) = found[0], found[-1]
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def box(ref: str) -> dict:
    return dict(zip(("r1", "c1", "r2", "c2"), rectangle(ref) or ()))


def rich_text(e: ET.Element | None) -> str:
    """The text of t elements, without phonetic runs."""
    if e is None or local(e.tag) == "rPh":
        return ""
    return (e.text or "") if local(e.tag) == "t" else "".join(map(rich_text, e))


def read_workbook(data: bytes) -> Iterator[Record]:
    """Sheets without a part are left out. Scope is the sheet's index, or empty for what belongs to the book."""
    p = Package(data)
    main = p.main("xl/workbook.xml")
    book, rels = p.xml(main), p.rels(main)
    if book is None:
        raise ValueError("no workbook part")
    pr = kid(book, "workbookPr")
    yield "book", "", 0, {"date1904": bit(attr(pr, "date1904"))}
    for part in p.related(main, "sharedStrings"):
        for k, e in enumerate(kids(p.xml(part), "si")):
            yield "string", "", k, {"i": k, "text": rich_text(e)}
    for part in p.related(main, "styles"):
        yield from _styles(p.xml(part))
    for part in p.related(main, "theme"):
        yield from theme_colours(p.xml(part), ("lt1", "dk1", "lt2", "dk2"))
    for k, e in enumerate(kids(kid(book, "definedNames"), "definedName")):
        yield "name", "", k, {"name": e.get("name"), "ref": e.text or "", "sheet": e.get("localSheetId"), **box(e.text or "")}
    index = 0
    for e in kids(kid(book, "sheets"), "sheet"):
        target = rels.get(attr(e, "id") or "", {}).get("target")
        sheet = p.xml(target)
        if sheet is None:
            continue
        yield "sheet", str(index), index, {"name": e.get("name"), "index": index, "state": e.get("state") or "visible", "sheet_id": e.get("sheetId"), "part": target}
        for kind, ord_, a in _worksheet(sheet, p.rels(target)):
            yield kind, str(index), ord_, a
        index += 1


def _worksheet(sheet: ET.Element, rels: dict[str, dict]) -> Iterator[tuple[str, int, dict]]:
    for k, e in enumerate(every(kid(sheet, "cols"), "col")):
        yield "col", k, {"min": e.get("min"), "max": e.get("max"), "width": e.get("width"), "hidden": "1" if bit(e.get("hidden")) == "1" or float(e.get("width") or 1) <= 0 else "0", "style": e.get("style"), "outline": e.get("outlineLevel") or 0}
    n = 0
    for row in kids(kid(sheet, "sheetData"), "row"):
        if not (row.get("r") or "").isdigit():
            continue
        r, c = int(row.get("r")), 0
        if len(row.attrib) > 1:
            yield "row", r, {"r": r, "ht": row.get("ht"), "hidden": bit(row.get("hidden")), "outline": row.get("outlineLevel") or 0, "collapsed": bit(row.get("collapsed")), "s": row.get("s") if bit(row.get("customFormat")) == "1" else None}
        for cell in kids(row, "c"):
            m = re.fullmatch(r"([A-Z]{1,3})(\d+)", (cell.get("r") or "").upper())
            c = column(m[1]) if m else c + 1
            if cell.get("r") and not m:
                continue
            kind, v, f = cell.get("t") or "n", kid(cell, "v"), kid(cell, "f")
            text = rich_text(kid(cell, "is")) if kind == "inlineStr" else None if v is None else v.text or ""
            yield "cell", n, {"r": int(m[2]) if m else r, "c": c, "t": kind, "v": text, "s": cell.get("s"), "f": None if f is None else f.text or ""}
            n += 1
    merges = sorted(filter(None, (rectangle(e.get("ref", "")) for e in every(kid(sheet, "mergeCells"), "mergeCell"))))
    for k, m in enumerate(merges):
        yield "merge", k, {"id": k, **dict(zip(("r1", "c1", "r2", "c2"), m))}
    if (d := kid(sheet, "dimension")) is not None:
        yield "dimension", 0, box(d.get("ref", ""))
    for k, e in enumerate(every(kid(sheet, "hyperlinks"), "hyperlink")):
        yield "link", k, {**box(e.get("ref", "")), "target": rels.get(attr(e, "id") or "", {}).get("target"), "location": e.get("location"), "display": e.get("display")}
    if (auto := kid(sheet, "autoFilter")) is not None:
        area = box(auto.get("ref", ""))
        yield "filter_range", 0, area
        for k, e in enumerate(kids(auto, "filterColumn")):
            spec = {"col": int(e.get("colId", 0)) + area.get("c1", 1)}
            if (f := kid(e, "filters")) is not None:
                spec |= {"values": [x.get("val", "") for x in kids(f, "filter")] + [""] * int(bit(f.get("blank")))}
            elif (f := kid(e, "customFilters")) is not None:
                spec |= {"and": bit(f.get("and")) == "1", "custom": [[x.get("operator") or "equal", x.get("val", "")] for x in kids(f, "customFilter")]}
            yield "filter", k, {"col": spec["col"], "spec": json.dumps(spec)}
    rule = 0
    for k, block in enumerate(kids(sheet, "conditionalFormatting")):
        for j, ref in enumerate((block.get("sqref") or "").split()):
            yield "cf_range", k * 1000 + j, {"block": k, **box(ref)}
        for e in kids(block, "cfRule"):
            stops = every(e, "cfvo")
            yield "cf_rule", rule, {
                "block": k, "rule": rule, "type": e.get("type"), "operator": e.get("operator"), "text": e.get("text"), "priority": e.get("priority"), "rank": e.get("rank"),
                "percent": bit(e.get("percent")), "bottom": bit(e.get("bottom")), "above": "0" if e.get("aboveAverage") == "0" else "1", "stop": bit(e.get("stopIfTrue")), "dxf": e.get("dxfId"),
                "formulas": json.dumps([x.text or "" for x in kids(e, "formula")]), "stops": json.dumps([[x.get("type"), x.get("val")] for x in stops]), "colours": json.dumps([attr(x, "rgb") for x in every(e, "color")]),
            }
            rule += 1
    pane = next(iter(every(kid(sheet, "sheetViews"), "pane")), None)
    if pane is not None:
        yield "pane", 0, {"rows": pane.get("ySplit") or 0, "cols": pane.get("xSplit") or 0, "state": pane.get("state")}


def _colour(e: ET.Element | None) -> str | None:
    """A colour element as JSON of auto, rgb, theme, tint and indexed."""
    return None if e is None else json.dumps({k: v for k in ("auto", "rgb", "theme", "tint", "indexed") if (v := e.get(k)) is not None})


def _styles(root: ET.Element | None) -> Iterator[Record]:
    for k, e in enumerate(kids(kid(root, "numFmts"), "numFmt")):
        yield "number_format", "", k, {"id": e.get("numFmtId"), "code": e.get("formatCode")}
    for k, e in enumerate(kids(kid(root, "fonts"), "font")):
        yield "font", "", k, {"id": k, "bold": bit("1" if (b := kid(e, "b")) is not None and (b.get("val") or "1") not in ("0", "false") else "0"), "italic": bit("1" if (b := kid(e, "i")) is not None and (b.get("val") or "1") not in ("0", "false") else "0"), "size": attr(kid(e, "sz"), "val"), "font": attr(kid(e, "name"), "val"), "colour": _colour(kid(e, "color"))}
    for k, e in enumerate(kids(kid(root, "fills"), "fill")):
        pattern = kid(e, "patternFill")
        yield "fill", "", k, {"id": k, "pattern": attr(pattern, "patternType"), "colour": _colour(kid(pattern, "fgColor"))}
    for k, e in enumerate(kids(kid(root, "borders"), "border")):
        yield "border", "", k, {"id": k, **{side: attr(kid(e, side), "style") for side in ("left", "right", "top", "bottom")}}
    for k, e in enumerate(kids(kid(root, "cellXfs"), "xf")):
        align = kid(e, "alignment")
        yield "xf", "", k, {"id": k, "number_format": e.get("numFmtId") or 0, "font": e.get("fontId") or 0, "fill": e.get("fillId") or 0, "border": e.get("borderId") or 0, "align": attr(align, "horizontal"), "wrap": bit(attr(align, "wrapText"))}
    for k, e in enumerate(kids(kid(root, "dxfs"), "dxf")):
        yield "dxf", "", k, {"id": k, "bold": bit("1" if kid(e, "font", "b") is not None else "0"), "colour": _colour(kid(e, "font", "color")), "fill": _colour(next(iter(every(kid(e, "fill"), "bgColor", "fgColor")), None))}


def theme_colours(root: ET.Element | None, first: tuple[str, ...]) -> Iterator[Record]:
    """A theme's colours by slot: `first`, then the accents and links. Books and other files number the first four differently."""
    scheme = next(iter(every(root, "clrScheme")), None)
    for k, name in enumerate((*first, "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")):
        e = next(iter(kids(kid(scheme, name))), None)
        if e is not None:
            yield "theme", "", k, {"slot": k, "name": name, "rgb": (attr(e, "lastClr") or attr(e, "val") or "").lower()}


def read_ods(data: bytes) -> Iterator[Record]:
    """Sheets and cells. Repeated rows and cells take their place; only the first of repeated cells has the value. Covered cells count."""
    content = Package(data).xml("content.xml")
    if content is None:
        raise ValueError("no content part")
    for index, table in enumerate(every(content, "table")):
        yield "sheet", str(index), index, {"name": attr(table, "name"), "index": index, "state": "visible"}
        r, n = 1, 0
        for row in every(table, "table-row"):
            repeat, c = min(int(attr(row, "number-rows-repeated") or 1), MAX_ROW_REPEAT), 1
            for cell in kids(row, "table-cell", "covered-table-cell"):
                wide = min(int(attr(cell, "number-columns-repeated") or 1), MAX_COLUMN_REPEAT)
                kind, text = attr(cell, "value-type"), "\n".join(odf_text(x) for x in kids(cell, "p"))
                value = attr(cell, "value") or attr(cell, "date-value") or attr(cell, "boolean-value") or text
                if local(cell.tag) == "table-cell" and (value or text):
                    yield "cell", str(index), n, {"r": r, "c": c, "t": {"float": "n", "percentage": "n", "currency": "n", "boolean": "b"}.get(kind or "", "str"), "v": value, "text": text}
                    n += 1
                    rows, cols = int(attr(cell, "number-rows-spanned") or 1), int(attr(cell, "number-columns-spanned") or 1)
                    if rows * cols > 1:
                        yield "merge", str(index), n, {"id": n, "r1": r, "c1": c, "r2": r + rows - 1, "c2": c + cols - 1}
                c += wide
            r += repeat


def odf_text(p: ET.Element) -> str:
    """A paragraph's text: white space collapsed, spaces and tabs of their own elements kept, notes of readers left out."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = local(e.tag)
        if name in ("annotation", "annotation-end"):
            return
        if name == "s":
            out.append("\x00" * min(int(attr(e, "c") or 1), 200))
        elif name in ("tab", "line-break"):
            out.append("\x01" if name == "tab" else "\x02")
        out.append(e.text or "")
        for x in e:
            walk(x)
            out.append(x.tail or "")

    walk(p)
    text = re.sub(r"[ \t\r\n]+", " ", "".join(out)).strip(" ")
    return text.replace("\x00", " ").replace("\x01", "\t").replace("\x02", "\n")
