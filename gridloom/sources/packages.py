"""Packages as rows: the parts of an archive, its kind, content types, relationships and properties.

A reader is a generator that gets one package and yields records (kind, scope, ord, attributes); `records` runs it over the
files, many tasks at a time, and each kind of record becomes a DataFrame by `of_kind`. A refused file is one `error` record.
"""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import extension
from gridloom.sources.containers import MAX_PART, open_zip, part_xml, signature

Record = tuple[str, str, int, dict]
#: Media types by extension where a package declares none.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "mp4": "video/mp4", "mp3": "audio/mpeg", "bin": "application/octet-stream"}
#: The kind that an extension names where the signature says only that a file is an archive or text.
KINDS = {"docx": "document", "docm": "document", "odt": "document", "rtf": "document", "doc": "document", "dot": "document", "pptx": "presentation", "pptm": "presentation", "odp": "presentation", "xlsx": "spreadsheet", "xlsm": "spreadsheet", "ods": "spreadsheet", "csv": "delimited", "tsv": "delimited"}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e if not names or local(x.tag) in names]


def kid(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next(iter(kids(e, name)), None)
    return e


def every(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e.iter() if local(x.tag) in names]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def on(e: ET.Element | None, name: str = "val") -> bool:
    """Whether a flag element is there and not switched off."""
    return e is not None and (attr(e, name) or "1").lower() in ("1", "true", "on")


def bit(text: str | None) -> str:
    return "1" if (text or "").lower() in ("1", "true", "on") else "0"


class Package:
    """One archive: parts are inflated when they are asked for."""

    def __init__(self, data: bytes):
        self.zip = open_zip(data)
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}
        self._rels: dict[str, dict[str, dict]] = {}

    def xml(self, name: str | None) -> ET.Element | None:
        return part_xml(self.zip, self.names[name]) if name in self.names else None

    def rels(self, part: str) -> dict[str, dict]:
        """Relationships of a part by id: type, target (resolved if internal) and mode."""
        if part not in self._rels:
            folder, name = posixpath.split(part)
            out = {}
            for e in kids(self.xml(posixpath.join(folder, "_rels", name + ".rels")), "Relationship"):
                target, external = e.get("Target", ""), e.get("TargetMode") == "External"
                out[e.get("Id", "")] = {"type": e.get("Type", "").rpartition("/")[2], "target": target if external else resolved(folder, target), "mode": "External" if external else "Internal"}
            self._rels[part] = out
        return self._rels[part]

    def related(self, part: str, kind: str) -> list[str]:
        return [r["target"] for r in self.rels(part).values() if r["type"] == kind and r["target"] in self.names]

    def main(self, default: str) -> str:
        return next(iter(self.related("", "officeDocument")), default)


def resolved(folder: str, target: str) -> str:
    out: list[str] = []
    for step in (target if target.startswith("/") else f"{folder}/{target}").split("/"):
        if step == "..":
            out = out[:-1]
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def records(files: DataFrame, reader: Callable[[bytes], Iterator[Record]]) -> DataFrame:
    """(path, kind, scope, ord, a) of files (path, content): a maps attribute names to text."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("scope", pa.string()), ("ord", pa.int32()), ("a", pa.map_(pa.string(), pa.string()))])

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for kind, scope, ord_, a in reader(content or b""):
                yield path, kind, scope, ord_, [(k, str(v)) for k, v in a.items() if v is not None]
        except (ValueError, KeyError, IndexError, ET.ParseError, zipfile.BadZipFile) as e:
            yield path, "error", "", 0, [("reason", str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                for r in rows(path, content.as_py()):
                    out.append(r)
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, kind string, scope string, ord int, a map<string,string>")


def of_kind(recs: DataFrame, kind: str, fields: str, *keep: str) -> DataFrame:
    """The records of one kind with typed columns: fields is like "r int, text string"; keep are some of path, scope and ord."""
    typed = [f.strip().split(" ") for f in fields.split(",")]
    return recs.filter(F.col("kind") == kind).select("path", *keep, *(F.col("a")[n].try_cast(t).alias(n) for n, t in typed))


def _parts(wanted: str):
    def read(data: bytes) -> Iterator[Record]:
        z = open_zip(data)
        for k, p in enumerate(sorted(z.infolist(), key=lambda p: p.filename)):
            a = {"part": p.filename.lstrip("/"), "size": p.file_size, "packed": p.compress_size, "crc": p.CRC, "method": p.compress_type}
            if re.search(wanted, p.filename) and p.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and p.file_size <= MAX_PART:
                raw = z.read(p)
                a["text"] = None if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw else raw.decode("utf-8", "replace")
            yield "part", "", k, a

    return read


def parts(files: DataFrame, wanted: str = r"\.(?:xml|rels|vml)$") -> DataFrame:
    """(path, ord, part, size, packed, method, crc, text) in the order of their names; only parts whose name matches `wanted`
    are inflated. Text that declares a DTD or entities is null."""
    return of_kind(records(files, _parts(wanted)), "part", "part string, size long, packed long, method int, crc long, text string", "ord")


def with_content_types(p: DataFrame) -> DataFrame:
    """parts() with `media_type`: the override, else the default of the extension, else the known one, else octet-stream."""
    tag = lambda name: F.regexp_extract_all("text", F.lit(rf"<{name}\s([^>]*?)/?>"), 1)
    get = lambda x, name: F.regexp_extract(x, rf'{name}="([^"]*)"', 1)
    types = p.filter("part = '[Content_Types].xml'")
    own = types.select("path", F.explode(F.transform(tag("Override"), lambda x: F.struct(F.regexp_replace(get(x, "PartName"), "^/", "").alias("part"), get(x, "ContentType").alias("over")))).alias("o")).select("path", "o.*")
    by = types.select("path", F.explode(F.transform(tag("Default"), lambda x: F.struct(F.lower(get(x, "Extension")).alias("ext"), get(x, "ContentType").alias("usual")))).alias("o")).select("path", "o.*")
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    out = p.withColumn("ext", extension(F.col("part"))).join(own, ["path", "part"], "left").join(by, ["path", "ext"], "left")
    return out.withColumn("media_type", F.coalesce("over", "usual", known[F.col("ext")], F.lit("application/octet-stream"))).drop("over", "usual")


def detected(files: DataFrame) -> DataFrame:
    """(path, format): by signature first, an archive by its parts (word, then ppt, xl, open document), then by extension."""
    ext = extension(F.col("path"))
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    names = parts(files, "^$").groupBy("path").agg(*(F.max(F.col("part").startswith(x)).alias(x) for x in ("word/", "ppt/", "xl/", "content.xml")))
    odf = F.when(ext == "odt", "document").when(ext == "odp", "presentation").otherwise("spreadsheet")
    by_part = F.when(F.col("word/"), "document").when(F.col("ppt/"), "presentation").when(F.col("xl/"), "spreadsheet").when(F.col("`content.xml`"), odf)
    sig = signature(F.col("content"))
    out = files.select("path", sig.alias("sig")).join(names, "path", "left")
    kind = F.when(F.col("sig") == "zip", by_part).when(F.col("sig") == "ole", F.when(ext.isin("doc", "dot"), "document")).when(F.col("sig") == "rtf", "document").when(F.col("sig").isin("png", "pdf"), F.lit(None)).otherwise(known[ext])
    return out.select("path", F.coalesce(kind, F.lit("unknown")).alias("format"))


def leaf_tags(text: Column) -> Column:
    """Array of (tag, value) of the elements of a part that hold text alone, in order."""
    found = F.regexp_extract_all(text, F.lit(r"<((?:\w+:)?\w+)(?:\s[^>]*)?>[^<]*[^<\s][^<]*</\1>"), 0)
    one = lambda x: F.struct(F.regexp_extract(x, r"^<(?:\w+:)?(\w+)", 1).alias("tag"), plain(F.trim(F.regexp_extract(x, r">([^<]*)</", 1))).alias("value"))
    return F.transform(found, one)


def plain(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Labels of core and application properties, in the order in which they are shown.
LABELS = [("title", "Title"), ("subject", "Subject"), ("creator", "Author"), ("keywords", "Keywords"), ("description", "Description"), ("lastModifiedBy", "Last modified by"), ("revision", "Revision"), ("created", "Created"), ("modified", "Modified"), ("category", "Category"), ("language", "Language"), ("Application", "Application"), ("AppVersion", "Application version"), ("Company", "Company"), ("Manager", "Manager"), ("Template", "Template"), ("Pages", "Pages"), ("Words", "Words"), ("Slides", "Slides"), ("TotalTime", "Editing time")]


def properties(p: DataFrame) -> DataFrame:
    """(path, tag, value) of core and application properties; malformed parts have none."""
    own = p.filter(F.col("part").isin("docProps/core.xml", "docProps/app.xml"))
    tags = own.select("path", F.explode(leaf_tags(F.col("text"))).alias("x")).select("path", "x.*").filter(F.col("tag").isin([k for k, _ in LABELS]))
    return tags.groupBy("path", "tag").agg(F.first("value").alias("value"))


def custom_properties(p: DataFrame) -> DataFrame:
    """(path, ord, name, value) of the custom properties."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)<property\s.*?</property>"), 0)
    own = p.filter("part = 'docProps/custom.xml'").select("path", F.posexplode(found).alias("ord", "x"))
    return own.select("path", "ord", plain(F.regexp_extract("x", r'\sname="([^"]*)"', 1)).alias("name"), plain(F.regexp_extract("x", r">([^<>]*)</(?:\w+:)?\w+>\s*</property>", 1)).alias("value"))


#: Labels of counted parts, by pattern; the first that matches holds.
COUNTED = [("Media parts", r"/media/|^Pictures/"), ("Charts", r"/charts/chart\d*\.xml$"), ("Slides", r"^ppt/slides/slide\d+\.xml$"), ("Worksheets", r"^xl/worksheets/"), ("Headers and footers", r"^word/(?:header|footer)\d*\.xml$"), ("Themes", r"/theme/theme\d*\.xml$"), ("Layouts", r"^ppt/slideLayouts/slideLayout\d+\.xml$"), ("Masters", r"^ppt/slideMasters/slideMaster\d+\.xml$")]


def counted_parts(p: DataFrame) -> DataFrame:
    """(path, label, n, bytes) of the kinds of parts that a package has."""
    label = F.lit(None).cast("string")
    for name, pattern in reversed(COUNTED):
        label = F.when(F.col("part").rlike(pattern), name).otherwise(label)
    return p.withColumn("label", label).filter("label is not null").groupBy("path", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def media(p: DataFrame) -> DataFrame:
    """(path, ext, n, bytes) of media parts, by extension; `first` orders them."""
    m = p.filter(F.col("part").rlike(r"/media/|^Pictures/")).withColumn("ext", extension(F.col("part")))
    return m.groupBy("path", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("ord").alias("first"))


def described(p: DataFrame) -> DataFrame:
    """(path, section, ord, label, value): what is known of each package; empty values are left out."""
    order = F.create_map(*(F.lit(x) for k, (tag, label) in enumerate(LABELS) for x in (tag, f"{k:02}{label}")))
    core = properties(p).select("path", F.lit("Document properties").alias("section"), F.substring(order[F.col("tag")], 1, 2).cast("int").alias("ord"), F.substring(order[F.col("tag")], 3, 99).alias("label"), "value")
    own = custom_properties(p).select("path", F.lit("Custom properties").alias("section"), "ord", F.col("name").alias("label"), "value")
    rank = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(COUNTED) for x in (name, k)))
    count = counted_parts(p).select("path", F.lit("Package").alias("section"), rank[F.col("label")].alias("ord"), "label", F.col("n").cast("string").alias("value"))
    return core.unionByName(own).unionByName(count).filter("value is not null and value <> ''")


def described_text(sections: DataFrame) -> DataFrame:
    """(path, text): each section's title, its lines as `  label: value`, an empty line between sections."""
    line = F.struct("ord", F.concat(F.lit("  "), "label", F.lit(": "), "value").alias("line"))
    by = sections.groupBy("path", "section").agg(F.sort_array(F.collect_list(line)).alias("l"))
    rank = F.when(F.col("section") == "Document properties", 0).when(F.col("section") == "Custom properties", 1).otherwise(2)
    block = F.concat_ws("\n", "section", F.transform("l", lambda x: x["line"]))
    return by.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(rank.alias("k"), block.alias("b")))).alias("s")).select("path", F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("text"))
