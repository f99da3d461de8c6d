"""Small packages made from rows, for queries and tests that read them back."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files that a worker hands on at once; Arrow batches hold about so many bytes unless the session says otherwise.
FILES, BATCH_BYTES, BATCH_SETTING = 100, 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def relationships(targets: Sequence[tuple[str, str]], external: Sequence[str] = ()) -> str:
    rows = [f'<Relationship Id="r{k}" Type="{_REL}/{kind}" Target={quoteattr(to)}/>' for k, (kind, to) in enumerate(targets, 1)]
    rows += [f'<Relationship Id="x{k}" Type="{_REL}/hyperlink" Target={quoteattr(to)} TargetMode="External"/>' for k, to in enumerate(external, 1)]
    return f"<Relationships>{''.join(rows)}</Relationships>"


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def workbook(sheets: Sequence[tuple[str, Sequence[Sequence], str]], states: Sequence[str] = (), styles: str = "", more: dict | None = None) -> bytes:
    """A workbook of (name, rows, elements before|after the cells); a cell is a number, a text (shared), or (value, style). A row
    may be a pair of its attributes and its cells."""
    texts: dict[str, int] = {}
    parts: dict[str, str | bytes] = {"_rels/.rels": relationships([("officeDocument", "xl/workbook.xml")])}
    for k, (_, rows, extra) in enumerate(sheets, 1):
        out = []
        for r, row in enumerate(rows, 1):
            cells = []
            attrs, row = (row[0], row[1]) if len(row) == 2 and isinstance(row[1], list) else ("", row)
            for c, v in enumerate(row, 1):
                v, style = v if isinstance(v, tuple) else (v, None)
                s = "" if style is None else f' s="{style}"'
                if isinstance(v, str):
                    cells.append(f'<c r="{letters(c)}{r}" t="s"{s}><v>{texts.setdefault(v, len(texts))}</v></c>')
                elif v is not None:
                    cells.append(f'<c r="{letters(c)}{r}"{s}><v>{v!r}</v></c>')
            out.append(f'<row r="{r}"{attrs}>{"".join(cells)}</row>')
        before, _, after = extra.partition("|")
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns:r="{_REL}">{before}<sheetData>{"".join(out)}</sheetData>{after}</worksheet>'
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"' + (f' state="{states[k - 1]}"' if k <= len(states) and states[k - 1] else "") + "/>" for k, (n, _, _) in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = relationships([*(("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")])
    parts["xl/sharedStrings.xml"] = f"<sst>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>"
    parts["xl/styles.xml"] = f"<styleSheet>{styles}</styleSheet>"
    return zipped(parts | (more or {}))


def paragraph(text: str, props: str = "") -> str:
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def document(body: str, external: Sequence[str] = (), **parts: str) -> bytes:
    """A document of body XML; further parts by kind: styles, numbering, comments, footnotes, settings."""
    ns = f'xmlns:w="w" xmlns:r="{_REL}" xmlns:m="m" xmlns:a="a"'
    out: dict[str, str | bytes] = {"_rels/.rels": relationships([("officeDocument", "word/document.xml")]), "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>"}
    out["word/_rels/document.xml.rels"] = relationships([(k, f"{k}.xml") for k in parts], external)
    return zipped(out | {f"word/{k}.xml": f"<w:{k} {ns}>{x}</w:{k}>" for k, x in parts.items()})


def shape(text: str, ph: str = "", idx: str = "", box: Sequence[int] = (), name: str = "s") -> str:
    place = f"<p:nvPr><p:ph{f' type={quoteattr(ph)}' if ph else ''}{f' idx={quoteattr(idx)}' if idx else ''}/></p:nvPr>" if ph or idx else "<p:nvPr/>"
    xfrm = f'<a:xfrm><a:off x="{box[0]}" y="{box[1]}"/><a:ext cx="{box[2]}" cy="{box[3]}"/></a:xfrm>' if box else ""
    lines = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split("\n"))
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name={quoteattr(name)}/>{place}</p:nvSpPr><p:spPr>{xfrm}</p:spPr><p:txBody>{lines}</p:txBody></p:sp>'


def picture() -> str:
    return '<p:pic><p:nvPicPr><p:cNvPr id="2" name="p"/></p:nvPicPr><p:spPr/></p:pic>'


def deck(slides: Sequence[str], layout: str = "", master: str = "", hidden: Sequence[int] = (), notes: dict[int, str] | None = None) -> bytes:
    """A deck of shape trees; each slide has one layout, and that one master."""
    ns = f'xmlns:p="p" xmlns:a="a" xmlns:r="{_REL}"'
    tree = lambda tag, shapes, more="": f"<p:{tag} {ns}{more}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{tag}>"
    out: dict[str, str | bytes] = {"_rels/.rels": relationships([("officeDocument", "ppt/presentation.xml")])}
    out["ppt/presentation.xml"] = f'<p:presentation {ns}><p:sldIdLst>{"".join(f"""<p:sldId id="{255 + k}" r:id="r{k}"/>""" for k in range(1, len(slides) + 1))}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>'
    out["ppt/_rels/presentation.xml.rels"] = relationships([("slide", f"slides/slide{k}.xml") for k in range(1, len(slides) + 1)])
    for k, s in enumerate(slides, 1):
        out[f"ppt/slides/slide{k}.xml"] = tree("sld", s, ' show="0"' if k in hidden else "")
        own = [("slideLayout", "../slideLayouts/slideLayout1.xml")] + ([("notesSlide", f"../notesSlides/notesSlide{k}.xml")] if notes and k in notes else [])
        out[f"ppt/slides/_rels/slide{k}.xml.rels"] = relationships(own)
        if notes and k in notes:
            out[f"ppt/notesSlides/notesSlide{k}.xml"] = tree("notes", shape(notes[k], "body", "1"))
    out["ppt/slideLayouts/slideLayout1.xml"] = tree("sldLayout", layout)
    out["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = relationships([("slideMaster", "../slideMasters/slideMaster1.xml")])
    out["ppt/slideMasters/slideMaster1.xml"] = tree("sldMaster", master)
    return zipped(out)


def odf(body: str, styles: str = "") -> bytes:
    ns = 'xmlns:office="office" xmlns:text="text" xmlns:table="table" xmlns:draw="draw" xmlns:style="style" xmlns:fo="fo" xmlns:svg="svg"'
    return zipped({"mimetype": "application/vnd.oasis.opendocument", "content.xml": f"<office:document-content {ns}><office:body>{body}</office:body></office:document-content>", "styles.xml": f"<office:document-styles {ns}><office:styles>{styles}</office:styles></office:document-styles>"})


def rtf(paragraphs: Sequence[str]) -> bytes:
    esc = lambda s: "".join(c if c.isascii() and c not in "\\{}" else f"\\{c}" if c in "\\{}" else f"\\u{(ord(c) + 32768) % 65536 - 32768}?" for c in s)
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}" + "".join(esc(p) + "\\par\n" for p in paragraphs) + "}").encode("latin-1")


def compound(entries: dict[str, bytes]) -> bytes:
    """A compound file of sectors of 512 bytes, every stream padded to the size that needs no small sectors."""
    padded = {k: v.ljust(max(4096, -(-len(v) // 512) * 512), b"\0") for k, v in entries.items()}
    starts, chain, at = {}, [], 0
    for k, v in padded.items():
        n = len(v) // 512
        starts[k] = at
        chain += [*range(at + 1, at + n), 0xFFFFFFFE]
        at += n
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)
    rows = [entry("Root Entry", 5, 0xFFFFFFFE, 0)] + [entry(k, 2, starts[k], len(padded[k])) for k in padded]
    directory = b"".join(rows).ljust(-(-128 * len(rows) // 512) * 512, b"\0")
    first_dir = at
    chain += [*range(at + 1, at + len(directory) // 512), 0xFFFFFFFE]
    n_fat = -(-(len(chain) + 1) // 127)
    fat_at = len(chain)
    chain += [0xFFFFFFFD] * n_fat
    fat = struct.pack(f"<{len(chain)}I", *chain).ljust(512 * n_fat, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", n_fat, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(fat_at, fat_at + n_fat), *[0xFFFFFFFF] * (109 - n_fat))
    return head + b"".join(padded.values()) + directory + fat


def word97(text: str) -> bytes:
    """A Word 97 file of two pieces: the first half in one byte a character, the rest in two."""
    half = len(text) // 2
    a, b = text[:half].encode("cp1252", "replace"), text[half:].encode("utf-16-le")
    body = 1024
    pieces = struct.pack("<III", 0, half, len(text)) + struct.pack("<HIH", 0, 2 * body | 0x40000000, 0) + struct.pack("<HIH", 0, body + len(a), 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    fib = bytearray(body)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<II", fib, 24, body, body + len(a) + len(b))
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(fib) + a + b, "1Table": clx})


def files_of(df: DataFrame, key: str, order: Sequence[str], ext: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(path, content): one file `<key>.<ext>` from the rows of each key, in order. A key's rows go to Python as one array: a group
    of rows each would cost more than to make its file."""

    def one(rows: pa.StructArray) -> tuple[str, bytes]:
        pdf = pa.Table.from_struct_array(rows).to_pandas()
        if len(order) > 1 or not pdf[order[0]].is_monotonic_increasing:
            pdf = pdf.sort_values(list(order), ignore_index=True)
        return f"{pdf[key].iloc[0]}.{ext}", make(pdf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, FILES):
                made = [one(rows.values) for rows in b.column(0).slice(k, FILES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.binary()))], names=["path", "content"])

    session = df.sparkSession
    if not session._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        session.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    by = df.groupBy(key).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    return by.select("rows").mapInArrow(run, "path string, content binary")
