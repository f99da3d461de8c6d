"""Documents as records: blocks in document order with their runs, notes, comments, styles and lists; open documents, RTF, Word 97."""

from __future__ import annotations

import json
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

from gridloom.functions.symbols import symbol
from gridloom.sources.packages import Package, Record, attr, every, kid, kids, local, on
from gridloom.sources.sheets import odf_text, theme_colours

MAX_DEPTH, MAX_BLOCKS = 12, 50_000
_TRANSPARENT = ("ins", "smartTag", "sdt", "sdtContent", "customXml", "moveTo", "dir", "bdo")


def linear_math(e: ET.Element | None) -> str:
    """A formula on one line: a/b, x^y, x_y, roots, sums with their bounds, matrices by rows."""
    if e is None:
        return ""
    name, of = local(e.tag), lambda x: "".join(linear_math(c) for c in kids(kid(e, x)))
    group = lambda s: s if len(s) < 2 or s.isalnum() else f"({s})"
    if name == "t":
        return e.text or ""
    if name == "f":
        return f"{group(of('num'))}/{group(of('den'))}"
    if name == "sSup":
        return f"{of('e')}^{group(of('sup'))}"
    if name == "sSub":
        return f"{of('e')}_{group(of('sub'))}"
    if name == "sSubSup":
        return f"{of('e')}_{group(of('sub'))}^{group(of('sup'))}"
    if name == "rad":
        return f"√[{of('deg')}]({of('e')})" if of("deg") else f"√({of('e')})"
    if name == "nary":
        low, high = of("sub"), of("sup")
        return (attr(kid(e, "naryPr", "chr"), "val") or "∫") + (f"_{group(low)}" if low else "") + (f"^{group(high)}" if high else "") + " " + of("e")
    if name == "d":
        pr = kid(e, "dPr")
        return (attr(kid(pr, "begChr"), "val") or "(") + ", ".join("".join(map(linear_math, x)) for x in kids(e, "e")) + (attr(kid(pr, "endChr"), "val") or ")")
    if name == "m":
        return "[" + "; ".join(", ".join("".join(map(linear_math, x)) for x in kids(r, "e")) for r in kids(e, "mr")) + "]"
    return "".join(map(linear_math, e))


def _run_props(pr: ET.Element | None) -> dict:
    out = {}
    for tag, key in (("b", "bold"), ("i", "italic"), ("strike", "strike"), ("caps", "caps")):
        if (x := kid(pr, tag)) is not None:
            out[key] = on(x)
    for tag, key in (("sz", "size"), ("color", "colour"), ("u", "underline"), ("highlight", "highlight"), ("vertAlign", "vertical"), ("rStyle", "style")):
        if (x := kid(pr, tag)) is not None:
            out[key] = attr(x, "val")
    if (x := kid(pr, "rFonts")) is not None:
        out["font"] = attr(x, "ascii") or attr(x, "hAnsi")
    if (x := kid(pr, "lang")) is not None:
        out["lang"] = attr(x, "val")
    return out


def _para_props(pr: ET.Element | None) -> dict:
    out = {}
    for tag, key in (("keepNext", "keep_next"), ("keepLines", "keep_lines"), ("pageBreakBefore", "page_break")):
        if (x := kid(pr, tag)) is not None:
            out[key] = on(x)
    for tag, key in (("jc", "align"), ("outlineLvl", "outline")):
        if (x := kid(pr, tag)) is not None:
            out[key] = attr(x, "val")
    if (x := kid(pr, "spacing")) is not None:
        line = int(attr(x, "line") or 240)
        out["line"] = line / 240 if (attr(x, "lineRule") or "auto") == "auto" else line / 20
        out |= {k: int(attr(x, k)) for k in ("before", "after") if (attr(x, k) or "").isdigit()}
    if (x := kid(pr, "ind")) is not None:
        out |= {f"indent_{k}": int(v) for k in ("left", "right", "firstLine", "hanging") if (v := attr(x, k) or "").lstrip("-").isdigit()}
    return out


class _Story:
    """Blocks and runs of one story (the body, a note, a header), in document order."""

    def __init__(self, scope: str, rels: dict[str, dict]):
        self.scope, self.rels, self.n, self.out, self.section = scope, rels, 0, [], 0

    def blocks(self, parent: ET.Element, up: int, depth: int, place: dict) -> None:
        for e in kids(parent):
            name = local(e.tag)
            if name in _TRANSPARENT:
                self.blocks(e, up, depth, place)
            elif name == "AlternateContent":
                for branch in kids(e):
                    before = self.n
                    self.blocks(branch, up, depth, place)
                    if self.n > before:
                        break
            elif name in ("p", "tbl") and depth <= MAX_DEPTH and self.n < MAX_BLOCKS:
                (self.paragraph if name == "p" else self.table)(e, up, depth, place)

    def record(self, kind: str, up: int, depth: int, a: dict) -> int:
        me, self.n = self.n, self.n + 1
        self.out.append(("block", self.scope, me, {"ord": me, "type": kind, "parent": up, "depth": depth, "section": self.section, **a}))
        return me

    def paragraph(self, p: ET.Element, up: int, depth: int, place: dict) -> None:
        pr, runs = kid(p, "pPr"), []
        self.runs(p, runs, {})
        text = "".join(r["text"] for r in runs if not r.get("deleted"))
        num = kid(pr, "numPr")
        own = _para_props(pr)
        breaks = kid(pr, "sectPr") is not None
        me = self.record("p", up, depth, {"style": attr(kid(pr, "pStyle"), "val"), "num_id": attr(kid(num, "numId"), "val"), "level": attr(kid(num, "ilvl"), "val") or (0 if num is not None else None), "outline": own.get("outline"), "props": json.dumps(own, sort_keys=True), "text": text, "section_break": int(breaks), **place})
        for k, r in enumerate(runs):
            self.out.append(("run", self.scope, me * 1000 + k, {"block": me, "at": k, **r}))
        self.section += breaks

    def table(self, t: ET.Element, up: int, depth: int, place: dict) -> None:
        me = self.record("tbl", up, depth, {"style": attr(kid(t, "tblPr", "tblStyle"), "val"), "grid": len(every(kid(t, "tblGrid"), "gridCol")), **place})
        rows = [r for e in kids(t) for r in ([e] if local(e.tag) == "tr" else every(e, "tr") if local(e.tag) in _TRANSPARENT else [])]
        for r, row in enumerate(rows):
            for c, cell in enumerate(x for e in kids(row) for x in ([e] if local(e.tag) == "tc" else kids(kid(e, "sdtContent"), "tc") if local(e.tag) == "sdt" else [])):
                pr = kid(cell, "tcPr")
                merge = kid(pr, "vMerge")
                at = self.record("cell", me, depth, {"table": me, "row": r, "cell": c, "span": attr(kid(pr, "gridSpan"), "val") or 1, "merge": None if merge is None else attr(merge, "val") or "continue"})
                self.blocks(cell, at, depth + 1, {"table": me, "row": r, "cell": c})

    def runs(self, parent: ET.Element, out: list[dict], more: dict) -> None:
        for e in kids(parent):
            name = local(e.tag)
            if name == "r":
                self.run(e, out, more)
            elif name == "hyperlink":
                link = self.rels.get(attr(e, "id") or "", {})
                self.runs(e, out, more | {"link": link.get("target") if link.get("mode") == "External" else None, "anchor": attr(e, "anchor")})
            elif name in ("del", "moveFrom"):
                self.runs(e, out, more | {"deleted": attr(e, "author") or "?"})
            elif name in ("ins", "moveTo"):
                self.runs(e, out, more | {"inserted": attr(e, "author")})
            elif name == "fldSimple":
                self.runs(e, out, more | {"field": (attr(e, "instr") or "").split()[:1] and attr(e, "instr").split()[0]})
            elif name in ("oMath", "oMathPara"):
                out.append({"kind": "math", "text": linear_math(e), **more})
            elif name in _TRANSPARENT:
                self.runs(e, out, more)

    def run(self, e: ET.Element, out: list[dict], more: dict) -> None:
        pr = _run_props(kid(e, "rPr"))
        base = {**more, **({"props": json.dumps(pr, sort_keys=True)} if pr else {})}
        for x in kids(e):
            name = local(x.tag)
            if name in ("t", "delText"):
                out.append({"kind": "text", "text": x.text or "", **base})
            elif name in ("tab", "br", "cr", "noBreakHyphen"):
                page = name == "br" and attr(x, "type") == "page"
                out.append({"kind": "page" if page else "break" if name in ("br", "cr") else "tab", "text": {"tab": "\t", "noBreakHyphen": "-"}.get(name, "\n"), **base})
            elif name == "sym":
                out.append({"kind": "symbol", "text": symbol(attr(x, "font") or "", attr(x, "char") or ""), **base})
            elif name in ("footnoteReference", "endnoteReference", "commentReference"):
                out.append({"kind": name.removesuffix("Reference"), "id": attr(x, "id"), "text": "", **base})
            elif name == "instrText":
                out.append({"kind": "instruction", "field": (x.text or "").strip().split(" ")[0], "text": "", **base})
            elif name in ("drawing", "pict"):
                for blip in every(x, "blip", "imagedata"):
                    out.append({"kind": "image", "text": "", "target": self.rels.get(attr(blip, "embed") or attr(blip, "id") or "", {}).get("target"), **base})


def read_docx(data: bytes) -> Iterator[Record]:
    """Blocks (type p, tbl or cell) and runs of the body and of notes, headers and footers; scope names the story."""
    p = Package(data)
    main = p.main("word/document.xml")
    body = kid(p.xml(main), "body")
    if body is None:
        raise ValueError("no document part")
    story = _Story("body", p.rels(main))
    story.blocks(body, -1, 0, {})
    yield from story.out
    breaks = len(kids(body, "sectPr")) + sum(kid(x, "pPr", "sectPr") is not None for x in kids(body, "p"))
    for k, s in enumerate([x for x in every(body, "sectPr") if x in kids(body) or any(kid(q, "pPr", "sectPr") is x for q in kids(body, "p"))] or [None]):
        size, margin = kid(s, "pgSz"), kid(s, "pgMar")
        yield "section", "body", k, {"index": k, "width": attr(size, "w") or 11906, "height": attr(size, "h") or 16838, "top": attr(margin, "top") or 1440, "bottom": attr(margin, "bottom") or 1440, "left": attr(margin, "left") or 1440, "right": attr(margin, "right") or 1440}
    yield "document", "", 0, {"sections": 1 + breaks}
    for kind in ("footnotes", "endnotes", "comments"):
        for part in p.related(main, kind):
            notes = [e for e in kids(p.xml(part), kind[:-1]) if kind == "comments" or (attr(e, "id") not in ("-1", "0") and (attr(e, "type") or "normal") == "normal")]
            for k, e in enumerate(notes):
                own = _Story(f"{kind[:-1]}:{attr(e, 'id')}", p.rels(part))
                own.blocks(e, -1, 0, {})
                text = "\n".join(b[3]["text"] for b in own.out if b[0] == "block" and b[3]["type"] == "p")
                yield kind[:-1], "", k, {"id": attr(e, "id"), "author": attr(e, "author"), "date": attr(e, "date"), "text": text}
                yield from own.out
    for kind in ("header", "footer"):
        for k, part in enumerate(p.related(main, kind)):
            own = _Story(f"{kind}:{k}", p.rels(part))
            own.blocks(p.xml(part), -1, 0, {})
            yield from own.out
    for n, e in enumerate(every(body, "ins", "del", "moveFrom", "moveTo")):
        yield "change", "", n, {"author": attr(e, "author"), "change": local(e.tag)}
    for part in p.related(main, "styles"):
        yield from _docx_styles(p.xml(part))
    for part in p.related(main, "numbering"):
        yield from _numbering(p.xml(part))
    for part in p.related(main, "theme"):
        yield from theme_colours(p.xml(part), ("dk1", "lt1", "dk2", "lt2"))
    for part in p.related(main, "settings"):
        root = p.xml(part)
        guard = kid(root, "documentProtection")
        yield "setting", "", 0, {"track": int(on(kid(root, "trackRevisions"))), "protection": attr(guard, "edit"), "enforced": attr(guard, "enforcement") or "0", "lang": attr(kid(root, "themeFontLang"), "val")}


def _docx_styles(root: ET.Element | None) -> Iterator[Record]:
    usual = kid(root, "docDefaults")
    yield "style", "", 0, {"id": "", "type": "defaults", "para": json.dumps(_para_props(kid(usual, "pPrDefault", "pPr"))), "run": json.dumps(_run_props(kid(usual, "rPrDefault", "rPr")))}
    for k, e in enumerate(kids(root, "style"), 1):
        yield "style", "", k, {"id": attr(e, "styleId"), "type": attr(e, "type"), "name": attr(kid(e, "name"), "val"), "based_on": attr(kid(e, "basedOn"), "val"), "usual": attr(e, "default") or "0", "para": json.dumps(_para_props(kid(e, "pPr"))), "run": json.dumps(_run_props(kid(e, "rPr")))}


def _numbering(root: ET.Element | None) -> Iterator[Record]:
    n = 0
    for e in kids(root, "abstractNum"):
        yield "list", "", n, {"abstract": attr(e, "abstractNumId"), "style_link": attr(kid(e, "numStyleLink"), "val"), "is_style": attr(kid(e, "styleLink"), "val")}
        for lvl in kids(e, "lvl"):
            n += 1
            yield "level", "", n, {"abstract": attr(e, "abstractNumId"), "level": attr(lvl, "ilvl"), "start": attr(kid(lvl, "start"), "val") or 1, "format": attr(kid(lvl, "numFmt"), "val") or "decimal", "text": attr(kid(lvl, "lvlText"), "val") or ""}
    for e in kids(root, "num"):
        n += 1
        yield "num", "", n, {"num_id": attr(e, "numId"), "abstract": attr(kid(e, "abstractNumId"), "val")}
        for o in kids(e, "lvlOverride"):
            n += 1
            yield "override", "", n, {"num_id": attr(e, "numId"), "level": attr(o, "ilvl"), "start": attr(kid(o, "startOverride"), "val")}


class _Outline(_Story):
    """Blocks of a story in the same order, paragraphs with their numbers alone: no runs, texts or properties."""

    def paragraph(self, p: ET.Element, up: int, depth: int, place: dict) -> None:
        num = kid(p, "pPr", "numPr")
        self.record("p", up, depth, {} if num is None else {"num_id": attr(kid(num, "numId"), "val"), "level": attr(kid(num, "ilvl"), "val") or 0})


def _books(recs: Iterable[Record]) -> dict[str, dict[int, dict]]:
    """The levels of each number by their records: of its list or the one that it links to by style, with the number's own starts."""
    of: dict[str, list[dict]] = {"list": [], "level": [], "num": [], "override": []}
    for kind, _, _, a in recs:
        of[kind].append(a)
    whole = lambda x: int(x) if re.fullmatch(r"\s*[-+]?[0-9]+\s*", str(x)) else None
    styled, real, levels, books = {}, {}, {}, {}
    for a in of["list"]:
        if a["is_style"] is not None:
            styled.setdefault(a["is_style"], a["abstract"])
    for a in of["list"]:
        real.setdefault(a["abstract"], styled.get(a["style_link"], a["abstract"]))
    for a in of["level"]:
        levels.setdefault(a["abstract"], {}).setdefault(whole(a["level"]), {"start": whole(a["start"]), "format": a["format"], "text": a["text"]})
    starts = {(a["num_id"], whole(a["level"])): whole(a["start"]) for a in of["override"]}
    for a in of["num"]:
        if a["abstract"] in real and a["num_id"] not in books:
            found = levels.get(real[a["abstract"]], {})
            books[a["num_id"]] = {k: {"abstract": a["abstract"], **v, "start": v["start"] if (own := starts.get((a["num_id"], k))) is None else own} for k, v in found.items() if k is not None}
    return books


def read_list_items(data: bytes) -> Iterator[Record]:
    """The numbered paragraphs of the body alone, each beside its level and, as JSON, the starts and formats of its list."""
    p = Package(data)
    main = p.main("word/document.xml")
    body = kid(p.xml(main), "body")
    if body is None:
        raise ValueError("no document part")
    story = _Outline("body", p.rels(main))
    story.blocks(body, -1, 0, {})
    books = _books(r for part in p.related(main, "numbering") for r in _numbering(p.xml(part)))
    shown = {n: json.dumps({k: {"start": v["start"], "format": v["format"]} for k, v in book.items()}) for n, book in books.items()}
    for kind, scope, n, a in story.out:
        num = a.get("num_id") if kind == "block" else None
        level = books[num].get(int(a["level"])) if num in books and num != "0" and str(a["level"]).strip().isdecimal() else None
        if level:
            yield "item", scope, n, {"num_id": num, "level": int(a["level"]), **level, "book": shown[num]}


def read_odt(data: bytes) -> Iterator[Record]:
    """Paragraphs, headings (outline from 0) and table cells of an open document, and its styles with their parents."""
    p = Package(data)
    content = p.xml("content.xml")
    if content is None:
        raise ValueError("no content part")
    n, k = 0, 0
    for part in ("styles.xml", "content.xml"):
        for s in every(p.xml(part), "style", "default-style"):
            a = {"id": attr(s, "name") or "", "family": attr(s, "family"), "parent": attr(s, "parent-style-name"), "part": part, "usual": int(local(s.tag) == "default-style")}
            yield "style", "", k, a | {"props": json.dumps({local(key): v for x in kids(s, "text-properties", "paragraph-properties") for key, v in x.attrib.items()}, sort_keys=True)}
            k += 1

    def walk(parent: ET.Element | None, place: dict) -> Iterator[Record]:
        nonlocal n
        for e in kids(parent):
            name = local(e.tag)
            if name in ("p", "h"):
                outline = int(attr(e, "outline-level") or 1) - 1 if name == "h" else None
                yield "block", "body", n, {"ord": n, "type": "p", "style": attr(e, "style-name"), "outline": outline, "text": odf_text(e), **place}
                n += 1
            elif name == "table":
                me, n = n, n + 1
                yield "block", "body", me, {"ord": me, "type": "tbl", **place}
                for r, row in enumerate(every(e, "table-row")):
                    for c, cell in enumerate(kids(row, "table-cell")):
                        yield from walk(cell, {"table": me, "row": r, "cell": c})
            elif name in ("list", "list-item", "list-header", "section", "text", "body", "index-body", "table-of-content"):
                yield from walk(e, place)

    yield from walk(kid(content, "body"), {})


#: Destinations of RTF whose text is not the document's.
_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "headerl", "headerr", "footerl", "footerr", "footnote", "listtable", "listoverridetable", "rsidtbl", "generator", "themedata", "colorschememapping", "latentstyles", "datastore", "xmlnstbl", "fldinst", "bkmkstart", "bkmkend", "nonshppict"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_RTF_TEXT = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def read_rtf(data: bytes) -> Iterator[Record]:
    """Paragraphs that are not blank, and table rows with their cells. Escaped braces are text, what `\\*` marks is left out, and
    so is the stand-in after a `\\u` character."""
    text = data.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise ValueError("not RTF")
    stack, now, line, cells, n, drop = [], {"skip": False, "uc": 1, "bold": False, "start": False}, [], None, 0, 0

    def add(s: str) -> None:
        nonlocal drop
        if drop:
            cut = min(drop, len(s))
            drop, s = drop - cut, s[cut:]
        if s and not now["skip"]:
            line.append((s, now["bold"]))

    for m in _RTF.finditer(text):
        word, number, hexa, mark, brace, plain = m.groups()
        if brace == "{":
            stack.append(dict(now))
            now["start"] = True
            continue
        if brace == "}":
            now = stack.pop() if stack else now
            drop = 0
            continue
        first, now["start"] = now["start"], False
        if mark == "*":
            now["skip"] = True
        elif mark is not None:
            add({"~": "\u00a0", "_": "‑", "-": ""}.get(mark, mark))
        elif hexa:
            add(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif plain is not None:
            add(plain)
        elif word in _SKIPPED and first:
            now["skip"] = True
        elif word == "u":
            drop = 0
            add(chr(int(number or 0) % 65536))
            drop = now["uc"]
        elif word == "uc":
            now["uc"] = int(number or 1)
        elif word == "b":
            now["bold"] = number != "0"
        elif word in _RTF_TEXT:
            add(_RTF_TEXT[word])
        elif word == "trowd" and not now["skip"]:
            cells = []
        elif word in ("par", "cell", "row", "sect", "page") and not now["skip"]:
            whole = "".join(s for s, _ in line)
            if word == "cell" and cells is not None:
                cells.append(whole)
                line = []
            elif word == "row" and cells is not None:
                for c, t in enumerate(cells):
                    yield "block", "body", n, {"ord": n, "type": "cell", "cell": c, "text": t}
                    n += 1
                cells, line = None, []
            elif cells is not None:
                add("\n")
            else:
                if whole.strip():
                    yield "block", "body", n, {"ord": n, "type": "p", "text": whole, "bold": int(all(b for s, b in line if s.strip()))}
                    n += 1
                line = []
    if "".join(s for s, _ in line).strip():
        yield "block", "body", n, {"ord": n, "type": "p", "text": "".join(s for s, _ in line), "bold": int(all(b for s, b in line if s.strip()))}


MAX_STREAM = 256 << 20
_FREE = 0xFFFFFFFA


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name. Chains that loop or leave the file are refused."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
        raise ValueError("not a compound file")
    big, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda k: data[big * (k + 1) : big * (k + 2)]
    tables = [x for x in struct.unpack_from("<109I", data, 76) if x < _FREE]
    for _ in range(n_more):
        if first_more >= _FREE:
            break
        more = struct.unpack(f"<{big // 4}I", sector(first_more))
        tables += [x for x in more[:-1] if x < _FREE]
        first_more = more[-1]
    fat = [x for t in tables for x in struct.unpack(f"<{len(sector(t)) // 4}I", sector(t))]

    def chain(start: int, table: list[int], limit: int) -> list[int]:
        out, seen = [], set()
        while start < _FREE:
            if start in seen or start >= len(table) or len(out) > limit:
                raise ValueError("broken chain of sectors")
            seen.add(start)
            out.append(start)
            start = table[start]
        return out

    whole = lambda start: b"".join(map(sector, chain(start, fat, MAX_STREAM // big)))
    mini_fat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := whole(first_mini) if first_mini < _FREE else b"") else []
    out, mini, directory = {}, b"", whole(first_dir)
    for k in range(0, len(directory) - 127, 128):
        entry = directory[k : k + 128]
        n, kind = struct.unpack_from("<HB", entry, 64)
        start, size = struct.unpack_from("<II", entry, 116)
        name = entry[: max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            mini = whole(start) if start < _FREE else b""
        elif kind == 2 and size <= MAX_STREAM:
            if size < cutoff:
                out[name] = b"".join(mini[small * s : small * (s + 1)] for s in chain(start, mini_fat, MAX_STREAM // small))[:size]
            else:
                out[name] = whole(start)[:size]
    return out


def cleaned(raw: str) -> str:
    """Text without field instructions and controls: paragraph and cell marks are new lines, three or more of which are two."""
    raw = re.sub(r"\x13[^\x13\x14\x15]*\x14?", "", raw).replace("\x15", "").replace("\x14", "")
    raw = raw.translate({7: "\t", 11: "\n", 12: "\n", 13: "\n", 30: "-", 31: None, 160: " "})
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", raw)).strip()


def read_doc(data: bytes) -> Iterator[Record]:
    """The text of a Word 97 file, as paragraphs: contiguous, or by its table of pieces (one byte or two a character)."""
    s = streams(data)
    word = s.get("WordDocument")
    if word is None or struct.unpack_from("<H", word, 0)[0] != 0xA5EC:
        raise ValueError("no Word document in the file")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise ValueError("encrypted document")
    table = s.get("1Table" if flags & 0x200 else "0Table", b"")
    at, size = struct.unpack_from("<II", word, 0x1A2) if len(word) >= 0x1AA else (0, 0)
    clx, text = table[at : at + size], None
    k = 0
    while k < len(clx):
        if clx[k] == 1:
            k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
            continue
        n = struct.unpack_from("<I", clx, k + 1)[0]
        pieces = (n - 4) // 12
        ends = struct.unpack_from(f"<{pieces + 1}I", clx, k + 5)
        text = ""
        for i in range(pieces):
            place = struct.unpack_from("<I", clx, k + 5 + 4 * (pieces + 1) + 8 * i + 2)[0]
            chars = ends[i + 1] - ends[i]
            if place & 0x40000000:
                start = (place & 0x3FFFFFFF) // 2
                text += word[start : start + chars].decode("cp1252", "replace")
            else:
                text += word[place : place + 2 * chars].decode("utf-16-le", "replace")
        break
    if text is None:
        first, last = struct.unpack_from("<II", word, 24)
        text = word[first:last].decode("cp1252", "replace")
    for k, line in enumerate(cleaned(text).split("\n")):
        yield "block", "body", k, {"ord": k, "type": "p", "text": line}
