"""Decks as records: slides, shapes in reading order, placeholders of layouts and masters, themes; also open-document decks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from gridloom.sources.packages import Package, Record, attr, every, kid, kids, local
from gridloom.sources.sheets import odf_text, theme_colours

#: What a deck may hold at most.
MAX_SLIDES, MAX_SHAPES, MAX_DEPTH = 2000, 5000, 16
_KINDS = {"sp": "shape", "pic": "picture", "grpSp": "group", "graphicFrame": "frame", "cxnSp": "connector"}


def paragraphs(body: ET.Element | None) -> list[dict]:
    """The paragraphs of a text body: level, bullet and text (breaks are new lines, fields their shown text)."""
    out = []
    for p in kids(body, "p"):
        pr = kid(p, "pPr")
        text = "".join("\n" if local(e.tag) == "br" else "".join(t.text or "" for t in kids(e, "t")) for e in kids(p, "r", "br", "fld"))
        bullet = next((local(b.tag) + ":" + (attr(b, "type") or attr(b, "char") or "") + ":" + (attr(b, "startAt") or "1") for b in kids(pr, "buAutoNum", "buChar", "buNone")), None)
        out.append({"level": int(attr(pr, "lvl") or 0), "bullet": bullet, "text": text, "fields": ",".join(attr(e, "type") or "" for e in kids(p, "fld"))})
    return out


def _shapes(tree: ET.Element | None) -> Iterator[dict]:
    n = 0

    def walk(parent: ET.Element | None, up: int, depth: int) -> Iterator[dict]:
        nonlocal n
        for e in kids(parent, *_KINDS, "AlternateContent"):
            if local(e.tag) == "AlternateContent":
                yield from walk(kid(e, "Choice") if kids(kid(e, "Choice"), *_KINDS) else kid(e, "Fallback"), up, depth)
                continue
            if n >= MAX_SHAPES or depth > MAX_DEPTH:
                return
            me, n = n, n + 1
            kind, own = _KINDS[local(e.tag)], next((x for x in e if local(x.tag).startswith("nv")), None)
            ph, name = next(iter(every(own, "ph")), None), next(iter(every(own, "cNvPr")), None)
            pr = kid(e, "spPr") if kid(e, "spPr") is not None else kid(e, "grpSpPr")
            xfrm = kid(pr, "xfrm") if kid(pr, "xfrm") is not None else kid(e, "xfrm")
            off, ext = kid(xfrm, "off"), kid(xfrm, "ext")
            table, chart = next(iter(every(kid(e, "graphic"), "tbl")), None), next(iter(every(kid(e, "graphic"), "chart")), None)
            if table is not None:
                kind = "table"
            elif chart is not None:
                kind = "chart"
            texts = paragraphs(kid(e, "txBody")) if kind == "shape" else [x for b in every(table, "txBody") for x in paragraphs(b)]
            yield {
                "id": me, "parent": up, "depth": depth, "kind": kind, "name": attr(name, "name"), "ph_type": None if ph is None else attr(ph, "type") or "body", "ph_idx": None if ph is None else attr(ph, "idx") or "0",
                "x": attr(off, "x"), "y": attr(off, "y"), "cx": attr(ext, "cx"), "cy": attr(ext, "cy"), "geometry": attr(kid(pr, "prstGeom"), "prst"), "fill": attr(kid(pr, "solidFill", "srgbClr"), "val") or attr(kid(pr, "solidFill", "schemeClr"), "val"),
                "text": "\n".join(t["text"] for t in texts), "paragraphs": texts,
            }
            if kind == "group":
                yield from walk(e, me, depth + 1)

    yield from walk(tree, -1, 0)


def read_deck(data: bytes) -> Iterator[Record]:
    """Slides in the order of the deck. Scope is a slide's index, or the part of a layout or master."""
    p = Package(data)
    main = p.main("ppt/presentation.xml")
    root, rels = p.xml(main), p.rels(main)
    if root is None:
        raise ValueError("no presentation part")
    size = kid(root, "sldSz")
    yield "deck", "", 0, {"cx": attr(size, "cx"), "cy": attr(size, "cy")}
    for part in [*p.related(main, "theme")]:
        yield from theme_colours(p.xml(part), ("dk1", "lt1", "dk2", "lt2"))
    seen: set[str] = set()

    def prototype(part: str, kind: str) -> Iterator[Record]:
        if part in seen:
            return
        seen.add(part)
        yield kind, part, 0, {"part": part, "name": attr(kid(p.xml(part), "cSld"), "name"), "master": next(iter(p.related(part, "slideMaster")), None)}
        for s in _shapes(kid(p.xml(part), "cSld", "spTree")):
            yield "prototype", part, s["id"], {k: v for k, v in s.items() if k != "paragraphs"}

    for index, e in enumerate(kids(kid(root, "sldIdLst"), "sldId")[:MAX_SLIDES]):
        part = rels.get(next((v for k, v in e.attrib.items() if k.startswith("{") and local(k) == "id"), ""), {}).get("target")
        slide = p.xml(part)
        if slide is None:
            continue
        scope, shapes = str(index), list(_shapes(kid(slide, "cSld", "spTree")))
        layout = next(iter(p.related(part, "slideLayout")), None)
        notes = next(iter(p.related(part, "notesSlide")), None)
        spoken = [s["text"] for s in _shapes(kid(p.xml(notes), "cSld", "spTree")) if s["ph_type"] == "body"]
        title = next((s["text"] for s in shapes if s["ph_type"] in ("title", "ctrTitle")), None)
        yield "slide", scope, index, {"index": index, "part": part, "layout": layout, "hidden": "1" if attr(slide, "show") == "0" else "0", "title": title, "notes": "\n".join(spoken) or None}
        for r in p.rels(part).items():
            yield "rel", part, 0, {"id": r[0], **r[1]}
        for s in shapes:
            yield "shape", scope, s["id"], {k: v for k, v in s.items() if k != "paragraphs"}
            for k, t in enumerate(s["paragraphs"]):
                yield "paragraph", scope, s["id"] * 1000 + k, {"shape": s["id"], "at": k, **t}
        if layout:
            yield from prototype(layout, "layout")
            for master in p.related(layout, "slideMaster"):
                yield from prototype(master, "master")


def read_odp(data: bytes) -> Iterator[Record]:
    """Slides and their frames; the first text is the title."""
    content = Package(data).xml("content.xml")
    if content is None:
        raise ValueError("no content part")
    for index, page in enumerate(every(content, "page")):
        frames = [(f, "\n".join(odf_text(x) for x in every(f, "p", "h"))) for f in kids(page, "frame")]
        title = next((t for _, t in frames if t), None)
        yield "slide", str(index), index, {"index": index, "part": attr(page, "name"), "hidden": "0", "title": title}
        for k, (f, text) in enumerate(frames):
            kind = "picture" if kid(f, "image") is not None else "table" if kid(f, "table") is not None else "shape"
            yield "shape", str(index), k, {"id": k, "parent": -1, "depth": 0, "kind": kind, "name": attr(f, "name"), "text": text, "x": _emu(attr(f, "x")), "y": _emu(attr(f, "y")), "cx": _emu(attr(f, "width")), "cy": _emu(attr(f, "height"))}


def _emu(length: str | None) -> int | None:
    m = re.fullmatch(r"(-?[\d.]+)(cm|mm|in|pt)", length or "")
    return round(float(m[1]) * {"cm": 360000, "mm": 36000, "in": 914400, "pt": 12700}[m[2]]) if m else None
