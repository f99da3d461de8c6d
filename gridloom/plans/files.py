"""Queries over files: packages are built from the test tables, read back, and compared by SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import colours as K
from gridloom.functions import formats as N
from gridloom.functions import scalars as S
from gridloom.operators import documents as D
from gridloom.plans.catalog import query, t
from gridloom.sources import build as B
from gridloom.sources import decks, packages, sheets, texts


def _books(spark, d):
    """A workbook a region, a sheet a nation; every third sheet is hidden."""

    def make(p):
        return B.workbook([(n, [[int(k), n]], "") for k, n in zip(p.n_nationkey, p.n_name)], ["hidden" if k % 3 == 0 else "" for k in p.n_nationkey])

    return packages.records(B.files_of(t(spark, d, "nation"), "n_regionkey", ["n_nationkey"], "xlsx", make), sheets.read_workbook)


_SHEETS = "SELECT n_regionkey || '.xlsx' AS path, n_name AS name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS index, CASE WHEN n_nationkey % 3 = 0 THEN 'hidden' ELSE 'visible' END AS state FROM nation"


@query(_SHEETS)
def s10_workbook_scan(spark, d):
    return D.sheets(_books(spark, d)).select("path", "name", "index", "state")


@query(f"SELECT path, name, index FROM ({_SHEETS}) WHERE state = 'visible'")
def f7_visible_sheets(spark, d):
    return D.sheets(_books(spark, d), visible=True).select("path", "name", "index")


@query("SELECT n_regionkey || '.xlsx' AS path, n_name AS name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS index FROM nation UNION ALL SELECT r_regionkey || '.xlsx', 'nowhere', -1 FROM region")
def j14_sheet_by_name(spark, d):
    names = t(spark, d, "nation").select(F.concat("n_regionkey", F.lit(".xlsx")).alias("path"), F.col("n_name").alias("name"))
    none = t(spark, d, "region").select(F.concat("r_regionkey", F.lit(".xlsx")).alias("path"), F.lit("nowhere").alias("name"))
    return D.sheet_index(_books(spark, d), names.unionByName(none))


_STYLES = """<numFmts><numFmt numFmtId="164" formatCode="#,##0.00&quot; EUR&quot;"/></numFmts>
<fonts><font><name val="A"/></font><font><b/><color rgb="FFFF0000"/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders>
<cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="4" fontId="1"/><xf numFmtId="164" fontId="0"/><xf numFmtId="9" fontId="0"/></cellXfs>"""
_SHEET = """<cols><col min="1" max="1" style="3"/><col min="5" max="6" hidden="1"/></cols>|<autoFilter ref="A1:C100000"><filterColumn colId="1"><customFilters and="1"><customFilter operator="notEqual" val="Supplier#000000003"/></customFilters></filterColumn><filterColumn colId="2"><customFilters><customFilter operator="greaterThan" val="1000"/><customFilter operator="lessThan" val="0"/></customFilters></filterColumn></autoFilter>
<mergeCells><mergeCell ref="B2:A2"/></mergeCells><conditionalFormatting sqref="C2:C4 C6:C9"><cfRule type="cellIs" operator="greaterThan" priority="1" dxfId="0"><formula>5000</formula></cfRule></conditionalFormatting><conditionalFormatting sqref="B1:D3"><cfRule type="cellIs" operator="greaterThan" priority="2" dxfId="1"><formula>0</formula></cfRule></conditionalFormatting>
<hyperlinks><hyperlink ref="A1:B2" location="first"/><hyperlink ref="B2:B3" location="second"/></hyperlinks>"""


def _supplier_books(spark, d):
    """A workbook a nation of its suppliers: a header row and a row each; negative balances are bold, those over 5000 have a code of their own."""

    def make(p):
        rows = [["key", "name", "balance"]]
        for k, n, b in zip(p.s_suppkey, p.s_name, p.s_acctbal):
            cells = [int(k), n, (float(b), 1) if b < 0 else (float(b), 2) if b > 5000 else float(b)]
            rows.append((' hidden="1"', cells) if k % 5 == 0 else cells)
        return B.workbook([("suppliers", rows, _SHEET)], styles=_STYLES)

    return packages.records(B.files_of(t(spark, d, "supplier"), "s_nationkey", ["s_suppkey"], "xlsx", make), sheets.read_workbook)


_SUP = "SELECT s_nationkey || '.xlsx' AS path, s_suppkey, s_name, s_acctbal, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1)::INTEGER AS r FROM supplier"
_SUP_CELLS = f"SELECT path, r, 1 AS c, NULL AS text, s_suppkey::DOUBLE AS num FROM ({_SUP}) UNION ALL SELECT path, r, 2, s_name, NULL FROM ({_SUP}) UNION ALL SELECT path, r, 3, NULL, s_acctbal FROM ({_SUP}) UNION ALL SELECT DISTINCT path, 1, unnest([1, 2, 3]), unnest(['key', 'name', 'balance']), NULL FROM ({_SUP})"


@query(_SUP_CELLS)
def s11_worksheet_scan(spark, d):
    return D.cells(_supplier_books(spark, d)).select("path", "r", "c", F.when(F.col("t") == "s", F.col("text")).alias("text"), "num")


@query(f"SELECT path, count(DISTINCT text) AS n FROM ({_SUP_CELLS}) GROUP BY path")
def s12_shared_strings(spark, d):
    return packages.of_kind(_supplier_books(spark, d), "string", "i int, text string").groupBy("path").agg(F.count("*").alias("n"))


@query(f"SELECT path, r, 1 AS c, 0 AS bold, '0%' AS code FROM ({_SUP}) UNION ALL SELECT path, r, 2, 0, 'General' FROM ({_SUP}) UNION ALL SELECT path, r, 3, (s_acctbal < 0)::INTEGER, CASE WHEN s_acctbal < 0 THEN '#,##0.00' WHEN s_acctbal > 5000 THEN '#,##0.00\" EUR\"' ELSE 'General' END FROM ({_SUP})")
def s24_style_lookup(spark, d):
    recs = _supplier_books(spark, d)
    return D.styled(recs, D.cells(recs)).filter("r > 1").select("path", "r", "c", "bold", "code")


@query(f"SELECT path, r, CASE WHEN s_acctbal < 0 THEN '-' || format('{{:,.2f}}', -s_acctbal) ELSE format('{{:,.2f}}', s_acctbal) || ' EUR' END AS shown FROM ({_SUP}) WHERE s_acctbal < 0 OR s_acctbal > 5000")
def n1_formats_by_row(spark, d):
    recs = _supplier_books(spark, d)
    own = D.styled(recs, D.cells(recs)).filter("c = 3 and r > 1 and code <> 'General'")
    return N.format_rows(own, "num", "code", "shown").select("path", "r", "shown")


@query(f"SELECT path, r FROM ({_SUP}) WHERE NOT (s_name <> 'Supplier#000000003' AND (s_acctbal > 1000 OR s_acctbal < 0))")
def f4_declared_filters(spark, d):
    recs = _supplier_books(spark, d)
    return D.filtered_out(recs, D.cells(recs)).select("path", "r")


@query(f"SELECT path, 'row' AS kind, r AS place FROM ({_SUP}) WHERE s_suppkey % 5 = 0 UNION ALL SELECT DISTINCT path, 'column', unnest([5, 6]) FROM ({_SUP})")
def f5_hidden_rows_and_columns(spark, d):
    recs = _supplier_books(spark, d)
    rows = D.hidden_rows(recs).select("path", F.lit("row").alias("kind"), F.col("r").alias("place"))
    return rows.unionByName(D.hidden_columns(recs).select("path", F.lit("column").alias("kind"), F.col("c").alias("place")))


@query(f"SELECT path, r, 3 AS c, CASE WHEN (r BETWEEN 2 AND 4 OR r BETWEEN 6 AND 9) AND s_acctbal > 5000 THEN 0 ELSE 1 END AS block FROM ({_SUP}) WHERE (r BETWEEN 2 AND 4 OR r BETWEEN 6 AND 9) AND s_acctbal > 5000 OR r <= 3 AND s_acctbal > 0")
def j5_format_blocks(spark, d):
    recs = _supplier_books(spark, d)
    rules = D.format_rules(recs, D.cells(recs).select("path", "scope", "r", "c", "num"))
    hit = F.coalesce(F.col("num") > F.get_json_object("formulas", "$[0]").cast("double"), F.lit(False))
    return D.first_rule(rules.withColumn("hit", hit)).select("path", "r", "c", "block")


@query("SELECT DISTINCT s_nationkey || '.xlsx' AS path, unnest([1, 1, 2, 2, 3]) AS r, unnest([1, 2, 1, 2, 2]) AS c, unnest(['#first', '#first', '#first', '#second', '#second']) AS target FROM supplier")
def j6_link_ranges(spark, d):
    return D.linked_cells(_supplier_books(spark, d)).select("path", "r", "c", "target")


@query("SELECT s_nationkey || '.xlsx' AS path, 1 AS sheets, 1 AS visible_sheets, 3 * (count(*) + 1) AS n_cells, (count(*) + 1)::INTEGER AS rows, 3 AS columns, 2 AS filters FROM supplier GROUP BY 1")
def a10_workbook_facts(spark, d):
    return D.workbook_facts(_supplier_books(spark, d))


@query("SELECT DISTINCT s_nationkey || '.xlsx' AS path, unnest([2, 3]) AS col, unnest([1, 2]) AS tests FROM supplier")
def k5_filter_state(spark, d):
    specs = packages.of_kind(_supplier_books(spark, d), "filter", "col int, spec string", "scope")
    back = D.filter_specs(D.filter_state(specs))
    return back.select("path", "col", F.size(F.from_json("spec", "custom array<array<string>>")["custom"]).alias("tests"))


@query(f"SELECT path, '<table>' || string_agg('<tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr>', '' ORDER BY r) || '</table>' AS html FROM ({_SUP}) GROUP BY path")
def k2_html_export(spark, d):
    own = D.cells(_supplier_books(spark, d)).filter("r > 1 and c < 3")
    return D.html_table(own, "path")


@query("SELECT p_partkey % 8 AS place, arg_max(style, w) AS style FROM (SELECT p_partkey, style, (CASE style WHEN 'hair' THEN 1 WHEN 'thin' THEN 6 WHEN 'medium' THEN 11 WHEN 'thick' THEN 13 ELSE 0 END) * 1000000 - p_partkey AS w FROM (SELECT p_partkey, ['hair', 'thin', 'medium', 'none'][(p_size % 4 + 1)::INT] AS style FROM part)) GROUP BY 1")
def a20_stronger_border(spark, d):
    style = F.element_at(F.array(*map(F.lit, ("hair", "thin", "medium", "none"))), (F.col("p_size") % 4 + 1).cast("int"))
    return D.stronger_border(t(spark, d, "part").select((F.col("p_partkey") % 8).alias("place"), F.col("p_partkey").alias("ord"), style.alias("style")), ["place"])


@query("SELECT s_nationkey || '.ods' AS path, (3 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 2)::INTEGER AS r, 1 AS c, s_suppkey::DOUBLE AS num, NULL AS text FROM supplier UNION ALL SELECT s_nationkey || '.ods', (3 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 2)::INTEGER, 4, NULL, s_name FROM supplier")
def s13_ods_scan(spark, d):
    def make(p):
        rows = "".join(f'<table:table-row><table:table-cell office:value-type="float" office:value="{k}"><text:p>{k}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string"><text:p>{n}</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell/></table:table-row>' for k, n in zip(p.s_suppkey, p.s_name))
        return B.odf(f'<office:spreadsheet><table:table table:name="x">{rows}</table:table></office:spreadsheet>')

    recs = packages.records(B.files_of(t(spark, d, "supplier"), "s_nationkey", ["s_suppkey"], "ods", make), sheets.read_ods)
    own = D.cells(recs)
    return own.select("path", "r", "c", "num", F.when(F.col("num").isNull(), F.col("v")).alias("text"))


def _doc_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))


_CLEAN = r"regexp_replace({}, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')"
_LINES = f"SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split({_CLEAN.format("coalesce(text, '')")}, chr(10)) AS l FROM documents)"


def _docx_files(spark, d):
    """A document a row of documents: a paragraph a line; the first is a heading of level at 1, list items follow by length."""
    lines = _doc_lines(spark, d).withColumn("line", F.regexp_replace("line", r"[\x00-\x08\x0b-\x1f\x7f]", ""))

    def make(p):
        out = []
        for k, x in zip(p["at"], p["line"]):
            props = '<w:outlineLvl w:val="0"/>' if k == 0 else f'<w:numPr><w:ilvl w:val="{len(x) % 3}"/><w:numId w:val="1"/></w:numPr>' if len(x) % 2 else ""
            out.append(B.paragraph(x, props))
        note = '<w:p><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:commentReference w:id="0"/></w:r></w:p>'
        levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{x}"/></w:lvl>' for k, (f, x) in enumerate((("decimal", "%1."), ("upperLetter", "%1.%2"), ("lowerRoman", "%3)"))))
        doc = int(p.doc_id.iloc[0])
        return B.document(
            "".join(out) + note,
            numbering=f'<w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>',
            footnotes=f'<w:footnote w:id="0"/><w:footnote w:id="2">{B.paragraph(f"note of {doc}")}</w:footnote>',
            comments="".join(f'<w:comment w:id="{k}" w:author="author {(doc + k) % 3}">{B.paragraph("c")}</w:comment>' for k in range(doc % 4 + 1)),
        )

    return B.files_of(lines, "doc_id", ["at"], "docx", make)


def _docx(spark, d):
    return packages.records(_docx_files(spark, d), texts.read_docx)


@query(f"SELECT doc_id || '.docx' AS path, pos::INTEGER AS ord, line AS text FROM ({_LINES})")
def s14_docx_scan(spark, d):
    last = F.max("ord").over(Window.partitionBy("path"))
    return D.blocks(_docx(spark, d)).withColumn("last", last).filter("ord < last").select("path", "ord", "text")


_WORDS_OF = r"CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"


@query(f"SELECT doc_id || '.docx' AS path, sum(length(line))::BIGINT AS chars, 1::BIGINT AS headings, count(*) + 1 AS paragraphs, 1::BIGINT AS notes, 1 AS sections FROM ({_LINES}) GROUP BY doc_id")
def a8_document_facts(spark, d):
    return D.document_facts(_docx(spark, d)).select("path", "chars", "headings", "paragraphs", "notes", "sections")


@query("SELECT doc_id || '.docx' AS path, doc_id % 4 + 1 AS n, 'author ' || (doc_id % 3) AS first, least(doc_id % 4 + 1, 3)::INTEGER AS authors FROM documents")
def a14_comment_authors(spark, d):
    return D.authors(_docx(spark, d), "comment").select("path", "n", F.col("authors")[0].alias("first"), F.size("authors").alias("authors"))


@query("SELECT doc_id || '.docx' AS path, 'note of ' || doc_id AS text FROM documents")
def j13_note_references(spark, d):
    return D.note_references(_docx(spark, d), "footnote").select("path", "text")


_ITEMS = f"SELECT doc_id, pos, length(line) % 3 AS level FROM ({_LINES}) WHERE pos > 0 AND length(line) % 2 = 1"


@query(f"""WITH i AS (SELECT *, sum((level < 1)::INT) OVER w AS e1, sum((level < 2)::INT) OVER w AS e2 FROM ({_ITEMS}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, CASE level WHEN 0 THEN 0 WHEN 1 THEN e1 ELSE e2 END ORDER BY pos) AS value FROM i)
SELECT doc_id || '.docx' AS path, pos::INTEGER AS ord, level::INTEGER AS level, value::INTEGER AS value FROM n""")
def w12_list_counters(spark, d):
    recs = packages.records(_docx_files(spark, d), texts.read_list_items)
    return D.list_items(recs).select("path", "ord", "level", "value")


@query("SELECT n_regionkey || '.docx' AS path, n_nationkey::INTEGER AS row, 0 AS column, 1::BIGINT AS rows FROM nation WHERE n_nationkey < 0 UNION ALL SELECT n_regionkey || '.docx', 0, 0, count(*) FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey || '.docx', (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER, 2, 1 FROM nation")
def j12_row_spans(spark, d):
    """A table a region: its first cell, two columns wide, goes on through all rows; the second holds a nation."""

    def make(p):
        rows = "".join(f'<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge{" w:val=" + chr(34) + "restart" + chr(34) if k == 0 else ""}/></w:tcPr><w:p/></w:tc><w:tc>{B.paragraph(n)}</w:tc></w:tr>' for k, n in enumerate(p.n_name))
        return B.document(f"<w:tbl>{rows}</w:tbl>")

    recs = packages.records(B.files_of(t(spark, d, "nation"), "n_regionkey", ["n_nationkey"], "docx", make), texts.read_docx)
    own = D.blocks(recs).filter("type = 'cell'")
    return D.row_spans(own).select("path", "row", F.col("column").cast("int").alias("column"), "rows")


@query("WITH RECURSIVE c(n, chain) AS (SELECT n_nationkey, 's' || n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT x.n_nationkey, c.chain || '/s' || x.n_nationkey FROM nation x JOIN c ON (x.n_nationkey - 1) // 2 = c.n AND x.n_nationkey >= 3) SELECT 's' || n AS id, chain, (CASE WHEN n = 0 THEN 10 WHEN n % 2 = 1 THEN n ELSE coalesce(nullif(list_last(list_filter(list_transform(string_split(chain, '/'), lambda x: substr(x, 2)::INT), lambda x: x % 2 = 1)), NULL), CASE WHEN n IN (0) THEN 10 END) END)::VARCHAR AS size FROM c")
def j10_style_cascade(spark, d):
    """Styles of one document, each based on that of half its number; odd ones and the first say a size."""

    def make(p):
        one = lambda k: f'<w:style w:type="paragraph" w:styleId="s{k}">{f"""<w:basedOn w:val="s{(k - 1) // 2}"/>""" if k >= 3 else ""}<w:rPr>{f"""<w:sz w:val="{k or 10}"/>""" if k % 2 or not k else ""}<w:b/></w:rPr></w:style>'
        return B.document("<w:p/>", styles="".join(one(int(k)) for k in p.n_nationkey))

    files = B.files_of(t(spark, d, "nation").withColumn("one", F.lit(1)), "one", ["n_nationkey"], "docx", make)
    styles = packages.of_kind(packages.records(files, texts.read_docx), "style", "id string, type string, based_on string, run string").filter("type = 'paragraph'")
    chains = D.style_chains(styles)
    props = D.cascaded(styles, chains, "run")
    return chains.join(props, ["path", "id"]).select("id", F.array_join("chain", "/").alias("chain"), F.col("run")["size"].alias("size"))


@query("SELECT conv_id || '.odt' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ord, CASE WHEN role = 'user' THEN 1 END AS outline, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM conversations")
def s16_odt_scan(spark, d):
    def make(p):
        tag = lambda r, x: f'<text:h text:outline-level="2">{x}</text:h>' if r == "user" else f"<text:p>{x}</text:p>"
        return B.odf("<office:text>" + "".join(tag(r, B.escape(x)) for r, x in zip(p["role"], p["text"])) + "</office:text>")

    turns = t(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    recs = packages.records(B.files_of(turns, "conv_id", ["turn"], "odt", make), texts.read_odt)
    return packages.of_kind(recs, "block", "outline int, text string", "ord").select("path", "ord", "outline", "text")


@query(f"SELECT doc_id || '.rtf' AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS ord, line AS text FROM ({_LINES}) WHERE regexp_matches(line, '\\S')")
def s17_rtf_scan(spark, d):
    lines = _doc_lines(spark, d).withColumn("line", F.regexp_replace("line", r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    recs = packages.records(B.files_of(lines, "doc_id", ["at"], "rtf", lambda p: B.rtf(list(p["line"]))), texts.read_rtf)
    return packages.of_kind(recs, "block", "text string", "ord").select("path", "ord", "text")


@query("SELECT n_regionkey || '.doc' AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS ord, n_name AS text FROM nation")
def s18_word97_scan(spark, d):
    recs = packages.records(B.files_of(t(spark, d, "nation"), "n_regionkey", ["n_nationkey"], "doc", lambda p: B.word97("\r".join(p.n_name) + "\r\x13 PAGE \x14\x15")), texts.read_doc)
    return packages.of_kind(recs, "block", "text string", "ord").select("path", "ord", "text")


def _deck_files(spark, d):
    """A deck a conversation, a slide a turn: a title without a place of its own, a body, and a picture for the user's turns."""

    def make(p):
        slides = [B.shape(r + " " + str(k), "title") + B.shape(x, "body", "1", (1, 2, 3, 4)) + (B.picture() if r == "user" else "") for k, r, x in zip(p["turn"], p["role"], p["text"])]
        return B.deck(slides, B.shape("", "title", "", (10, 20, 30, 40)), B.shape("", "body", "1", (5, 6, 7, 8)), [k for k in range(1, len(slides) + 1) if k % 4 == 0], {1: "spoken"})

    turns = t(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    return B.files_of(turns, "conv_id", ["turn"], "pptx", make)


def _decks(spark, d):
    return packages.records(_deck_files(spark, d), decks.read_deck)


_SLIDES = "SELECT conv_id || '.pptx' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS index, role || ' ' || turn AS title, role, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g') AS text FROM conversations"


@query(f"SELECT path, index, title, ((index + 1) % 4 = 0)::INTEGER AS hidden, CASE WHEN index = 0 THEN 'spoken' END AS notes FROM ({_SLIDES})")
def s20_pptx_scan(spark, d):
    return D.slides(_decks(spark, d)).select("path", "index", "title", "hidden", "notes")


@query(f"SELECT path, count(*) AS slides, count(*) FILTER ((index + 1) % 4 = 0) AS hidden, 1::BIGINT AS with_notes, 2 * count(*) + count(*) FILTER (role = 'user') AS shapes, count(*) FILTER (role = 'user') AS pictures, 0::BIGINT AS tables, 0::BIGINT AS charts FROM ({_SLIDES}) GROUP BY path")
def a9_deck_facts(spark, d):
    return D.deck_facts(_decks(spark, d))


@query(f"SELECT path, index, trim(regexp_replace(title || ' ' || text, '\\s+', ' ', 'g')) AS text FROM ({_SLIDES})")
def a11_slide_text(spark, d):
    return D.slide_texts(_decks(spark, d)).select("path", F.col("scope").cast("int").alias("index"), "text")


@query(f"SELECT path, count(*) FILTER (role = 'user') AS images FROM ({_SLIDES}) GROUP BY path")
def a12_image_count(spark, d):
    return D.shapes(_decks(spark, d)).groupBy("path").agg(F.count_if(F.col("kind") == "picture").alias("images"))


@query(f"SELECT path, string_agg(title, ' / ' ORDER BY index) AS titles FROM ({_SLIDES}) WHERE index < 3 GROUP BY path")
def o7_first_titles(spark, d):
    return D.first_titles(_decks(spark, d))


@query(f"SELECT path, index, ph_type, x::BIGINT AS x, cx::BIGINT AS cx FROM (SELECT path, index, unnest(['title', 'body']) AS ph_type, unnest([10, 1]) AS x, unnest([30, 3]) AS cx FROM ({_SLIDES}))")
def j9_placeholder_boxes(spark, d):
    return D.placed_shapes(_decks(spark, d)).select("path", F.col("scope").cast("int").alias("index"), "ph_type", "x", "cx")


@query(f"SELECT path, 'ppt/slides/slide' || (index + 1) || '.xml' AS part, 'ppt/slideLayouts/slideLayout1.xml' AS layout FROM ({_SLIDES})")
def j7_relationships(spark, d):
    rels = packages.of_kind(_decks(spark, d), "rel", "id string, type string, target string", "scope")
    slides = D.slides(_decks(spark, d)).select("path", F.col("part").alias("scope"))
    return slides.join(rels.filter("type = 'slideLayout'"), ["path", "scope"]).select("path", F.col("scope").alias("part"), F.col("target").alias("layout"))


@query("SELECT conv_id || '.odp' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS index, role || ' ' || turn AS title FROM conversations")
def s21_odp_scan(spark, d):
    def make(p):
        page = lambda r, k: f'<draw:page><draw:frame svg:x="1cm"><draw:text-box><text:p/></draw:text-box></draw:frame><draw:frame><draw:text-box><text:p>{r} {k}</text:p></draw:text-box></draw:frame></draw:page>'
        return B.odf("<office:presentation>" + "".join(page(r, k) for r, k in zip(p["role"], p["turn"])) + "</office:presentation>")

    recs = packages.records(B.files_of(t(spark, d, "conversations"), "conv_id", ["turn"], "odp", make), decks.read_odp)
    return D.slides(recs).select("path", "index", "title")


def _described_files(spark, d):
    """A package a nation: core, application and custom properties, content types, and media by the nation's number."""

    def make(p):
        k, n, r = int(p.n_nationkey.iloc[0]), p.n_name.iloc[0], int(p.n_regionkey.iloc[0])
        return B.zipped({
            "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/docProps/core.xml" ContentType="core"/></Types>',
            "docProps/core.xml": f"<cp:coreProperties><dc:title>{n} &amp; co</dc:title><dc:creator>author {r}</dc:creator><dc:subject></dc:subject></cp:coreProperties>",
            "docProps/app.xml": f"<Properties><Application>Words</Application><Words>{k}</Words></Properties>",
            "docProps/custom.xml": f'<Properties><property name="region"><vt:i4>{r}</vt:i4></property></Properties>',
            **{f"word/media/image{j}.{'png' if j % 2 else 'jpeg'}": b"x" * (10 * j) for j in range(1, k % 4 + 1)},
            "word/document.xml": "<w/>",
        })

    return B.files_of(t(spark, d, "nation"), "n_nationkey", ["n_nationkey"], "docx", make)


@query("SELECT n_nationkey || '.docx' AS path, unnest(['title', 'creator', 'Application', 'Words']) AS tag, unnest([n_name || ' & co', 'author ' || n_regionkey, 'Words', n_nationkey::VARCHAR]) AS value FROM nation")
def s28_properties(spark, d):
    return packages.properties(packages.parts(_described_files(spark, d)))


@query("SELECT n_nationkey || '.docx' AS path, 'region' AS name, n_regionkey::VARCHAR AS value FROM nation")
def t17_custom_properties(spark, d):
    return packages.custom_properties(packages.parts(_described_files(spark, d))).select("path", "name", "value")


_DESCRIBED = "'Document properties' || chr(10) || '  Title: ' || n_name || ' & co' || chr(10) || '  Author: author ' || n_regionkey || chr(10) || '  Application: Words' || chr(10) || '  Words: ' || n_nationkey || chr(10) || chr(10) || 'Custom properties' || chr(10) || '  region: ' || n_regionkey || CASE WHEN n_nationkey % 4 > 0 THEN chr(10) || chr(10) || 'Package' || chr(10) || '  Media parts: ' || (n_nationkey % 4) ELSE '' END"


@query(f"SELECT n_nationkey || '.docx' AS path, {_DESCRIBED} AS text FROM nation")
def s29_description(spark, d):
    return packages.described_text(packages.described(packages.parts(_described_files(spark, d))))


@query("SELECT n_nationkey || '.docx' AS path, ext, count(*) AS n, sum(10 * j)::BIGINT AS bytes FROM (SELECT n_nationkey, unnest(range(1, n_nationkey % 4 + 1)) AS j, unnest(list_transform(range(1, n_nationkey % 4 + 1), lambda j: CASE WHEN j % 2 = 1 THEN 'png' ELSE 'jpeg' END)) AS ext FROM nation) GROUP BY ALL")
def a17_media_histogram(spark, d):
    return packages.media(packages.parts(_described_files(spark, d))).select("path", "ext", "n", "bytes")


@query("SELECT n_nationkey || '.docx' AS path, 'Media parts' AS label, n_nationkey % 4 AS n, (5 * (n_nationkey % 4) * (n_nationkey % 4 + 1))::BIGINT AS bytes FROM nation WHERE n_nationkey % 4 > 0")
def a16_part_histogram(spark, d):
    return packages.counted_parts(packages.parts(_described_files(spark, d)))


@query("SELECT n_nationkey || '.docx' AS path, unnest(['docProps/core.xml', 'docProps/app.xml', 'word/document.xml'] || CASE WHEN n_nationkey % 4 > 0 THEN ['word/media/image1.png'] ELSE [] END) AS part, unnest(['core', 'application/xml', 'application/xml'] || CASE WHEN n_nationkey % 4 > 0 THEN ['image/png'] ELSE [] END) AS media_type FROM nation")
def s23_content_types(spark, d):
    own = packages.with_content_types(packages.parts(_described_files(spark, d)))
    return own.filter(F.col("part").isin("docProps/core.xml", "docProps/app.xml", "word/document.xml", "word/media/image1.png")).select("path", "part", "media_type")


@query("SELECT n_nationkey || '.docx' AS path, (6 + n_nationkey % 4 - 1)::INTEGER AS last, '[Content_Types].xml' AS first FROM nation")
def o6_part_listing(spark, d):
    p = packages.parts(_described_files(spark, d), "^$")
    return p.groupBy("path").agg((F.max("ord") + 1).alias("last"), F.min_by("part", "ord").alias("first")).withColumn("last", F.col("last").cast("int"))


@query("SELECT n_nationkey AS id, ['document', 'presentation', 'document', 'spreadsheet', 'document', 'delimited', 'unknown'][(n_nationkey % 7 + 1)::INT] AS format FROM nation")
def s1_format_detection(spark, d):
    """Files whose names mislead: a document named .xlsx, a deck without an extension, OLE, ODS, RTF, text and a picture."""
    made = [(".xlsx", B.document("<w:p/>")), (".bin", B.deck([""])), (".doc", B.word97("x\ry")), (".zip", B.odf("<office:spreadsheet/>")), (".txt", b"{\\rtf1 x}"), (".csv", b"a,b"), (".png", b"\x89PNG\r\n\x1a\n")]
    ext = F.element_at(F.array(*(F.lit(e) for e, _ in made)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    body = F.element_at(F.array(*(F.lit(b) for _, b in made)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    files = t(spark, d, "nation").select(F.concat("n_nationkey", ext).alias("path"), body.alias("content"))
    return packages.detected(files).select(F.split("path", r"\.")[0].cast("int").alias("id"), "format")


@query("SELECT p_partkey, '#' || lower(lpad(to_hex((p_partkey * 7919) % 16777216), 6, '0')) AS six, CASE WHEN p_partkey % 3 = 0 THEN '#000000' ELSE '#ffffff' END AS system FROM part")
def n12_colour_resolution(spark, d):
    k = F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    theme = F.array(F.concat(F.lit("#"), k), F.lit("#ffffff"))
    spec = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"rgb": "FF'), k, F.lit('"}'))).otherwise('{"theme": 0}')
    system = F.when(F.col("p_partkey") % 3 == 0, '{"indexed": 64}').otherwise('{"indexed": 65}')
    return t(spark, d, "part").select("p_partkey", K.resolved(spec, theme, F.lit("none")).alias("six"), K.resolved(system, theme, F.lit("none")).alias("system"))


_GREY = "('#' || repeat(lower(lpad(to_hex(floor({} + 0.5)::BIGINT), 2, '0')), 3))"


@query(f"SELECT p_partkey, {_GREY.format('g * 0.5')} AS half, {_GREY.format('g + (255 - g) * 0.4')} AS tint, '#' || repeat(lower(lpad(to_hex(g), 2, '0')), 3) AS same FROM (SELECT p_partkey, (p_size * 5)::BIGINT AS g FROM part)")
def n11_colour_transforms(spark, d):
    g = S.to_hex(F.col("p_size") * 5, F.col("p_size") * 5, F.col("p_size") * 5)
    show = lambda *steps: K.transformed(g, K.steps_of(steps))
    return t(spark, d, "part").select("p_partkey", show(("lumMod", 0.5)).alias("half"), show(("tint", 0.4)).alias("tint"), show(("comp", 1), ("hueOff", 180), ("alpha", 0.5)).alias("same"))


@query("SELECT page_id, replace(replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title FROM pages")
def t16_leaf_tags(spark, d):
    tags = t(spark, d, "pages").select("page_id", F.filter(packages.leaf_tags(F.col("html")), lambda x: x["tag"] == "title").alias("l"))
    return tags.select("page_id", F.coalesce(F.get("l", F.lit(0))["value"], F.lit("")).alias("title"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, format('{:,}', event_id) || CASE WHEN event_id = 1 THEN ' word' ELSE ' words' END AS label FROM events")
def n8_iso_display_and_labels(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t(spark, d, "events").select("event_id", S.iso_shown(iso).alias("shown"), S.count_label(F.col("event_id"), "word").alias("label"))


@query("SELECT p_partkey, 'it''s ' || p_brand AS sheet, least(p_partkey, p_size) AS r1, 1::BIGINT AS c1, greatest(p_partkey, p_size) AS r2, 28::BIGINT AS c2, p_name AS stem FROM part")
def t2_ranges_and_stems(spark, d):
    ref = F.concat(F.lit("'it''s "), "p_brand", F.lit("'!$AB"), "p_partkey", F.lit(":A$"), "p_size")
    p = t(spark, d, "part").withColumn("x", S.cell_range(ref))
    return p.select("p_partkey", "x.*", S.stem(F.concat(F.lit("a.b/"), "p_name", F.lit(".tar"))).alias("stem"))


@query("SELECT turn, conv_id, CASE turn % 4 WHEN 0 THEN turn WHEN 1 THEN 9 WHEN 2 THEN turn + 1 END AS shown FROM conversations")
def t18_fields(spark, d):
    code = F.element_at(F.array(*map(F.lit, (" PAGE \\* MERGEFORMAT", "NUMPAGES", "slidenum", "DATE"))), (F.col("turn") % 4 + 1).cast("int"))
    return t(spark, d, "conversations").select("turn", "conv_id", S.field_shown(code, F.col("turn"), F.lit(9).cast("long"), F.col("turn")).alias("shown"))


@query("SELECT conv_id, turn, (sum(1) OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS page FROM conversations")
def w15_page_planning(spark, d):
    items = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.lit(10.0).alias("height"), F.lit(False).alias("break_before"), F.lit(False).alias("keep_next"))
    return D.pages(items, 35.0, "conv_id").select("conv_id", F.col("ord").alias("turn"), F.col("page").cast("long").alias("page"))


@query("WITH i AS (SELECT conv_id, turn, (role = 'user') AS top FROM conversations), e AS (SELECT *, sum(top::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS era FROM i) SELECT conv_id, turn, CASE WHEN top THEN row_number() OVER (PARTITION BY conv_id, top ORDER BY turn) || ')' ELSE (row_number() OVER (PARTITION BY conv_id, top, era ORDER BY turn) + 1) || '.' END AS marker FROM e")
def w13_auto_bullets(spark, d):
    p = t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.lit("0").alias("scope"), F.lit(0).alias("shape"), F.col("turn").alias("at"), F.when(F.col("role") == "user", 0).otherwise(1).alias("level"), F.when(F.col("role") == "user", "buAutoNum:arabicParenR:1").otherwise("buAutoNum:arabicPeriod:2").alias("bullet"))
    return D.auto_bullets(p).select(F.col("path").alias("conv_id"), F.col("at").alias("turn"), "marker")


@query("SELECT n_nationkey || '.docx' AS path, CASE n_nationkey % 3 WHEN 0 THEN '(a+' || n_nationkey || ')/b' WHEN 1 THEN 'x^' || n_nationkey ELSE '√(' || n_nationkey || ')' END AS math, '✓' AS sym, 'https://x.org/' || n_nationkey AS target, 2 AS sections, 'p' || (n_nationkey % 2) AS author FROM nation")
def t9_math_symbols_links(spark, d):
    def make(p):
        k = int(p.n_nationkey.iloc[0])
        run = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
        math = [f"<m:f><m:num>{run(f'a+{k}')}</m:num><m:den>{run('b')}</m:den></m:f>", f"<m:sSup><m:e>{run('x')}</m:e><m:sup>{run(k)}</m:sup></m:sSup>", f"<m:rad><m:deg/><m:e>{run(k)}</m:e></m:rad>"][k % 3]
        body = f'<w:p><m:oMath>{math}</m:oMath><w:r><w:sym w:font="Wingdings" w:char="F0FC"/></w:r><w:hyperlink r:id="x1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins w:author="p{k % 2}"><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:sdt><w:sdtContent><w:p/></w:sdtContent></w:sdt>'
        return B.document(body, [f"https://x.org/{k}"])

    recs = packages.records(B.files_of(t(spark, d, "nation"), "n_nationkey", ["n_nationkey"], "docx", make), texts.read_docx)
    runs = packages.of_kind(recs, "run", "kind string, text string, link string").groupBy("path").agg(F.max(F.when(F.col("kind") == "math", F.col("text"))).alias("math"), F.max(F.when(F.col("kind") == "symbol", F.col("text"))).alias("sym"), F.max("link").alias("target"))
    out = runs.join(packages.of_kind(recs, "document", "sections int"), "path").join(D.authors(recs, "change"), "path")
    return out.select("path", "math", "sym", "target", "sections", F.col("authors")[0].alias("author"))


@query("SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'red' ELSE 'blue' END AS colour, (12 + n_nationkey)::VARCHAR AS size FROM nation WHERE n_nationkey > 0")
def j16_odf_styles(spark, d):
    """Each style has a root as its parent; the root's colour holds where a style names none, and content.xml wins over styles.xml."""
    def make(p):
        one = lambda k: f'<style:style style:name="n{k}" style:family="paragraph" style:parent-style-name="root"><style:text-properties fo:font-size="{12 + k}"{"" if k % 2 else chr(32) + "fo:color=" + chr(34) + "red" + chr(34)}/></style:style>'
        root = '<style:style style:name="root"><style:text-properties fo:color="blue" fo:font-size="9"/></style:style>'
        return B.odf("<office:text/>", root + "".join(one(int(k)) for k in p.n_nationkey if k > 0))

    files = B.files_of(t(spark, d, "nation").withColumn("one", F.lit(1)), "one", ["n_nationkey"], "odt", make)
    styles = packages.of_kind(packages.records(files, texts.read_odt), "style", "id string, parent string, props string", "ord")
    styles = styles.groupBy("path", "id").agg(F.max_by(F.struct("parent", "props"), "ord").alias("s")).select("path", "id", "s.*")
    out = D.cascaded(styles, D.style_chains(styles, "id", "parent"), "props")
    return out.filter("id like 'n%'").select("id", F.col("props")["color"].alias("colour"), F.col("props")["font-size"].alias("size"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'near' ELSE 'far' END AS font, CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'dot' END AS bullet FROM conversations")
def c2_list_styles(spark, d):
    c = t(spark, d, "conversations")
    near = F.create_map(F.lit("font"), F.when(F.col("turn") % 2 == 0, "near"), F.lit("bullet"), F.when(F.col("turn") % 3 == 0, "none"))
    far = F.create_map(F.lit("font"), F.lit("far"), F.lit("bullet"), F.lit("dot"))
    rows = [c.select(F.col("conv_id").alias("path"), F.lit(0).alias("shape"), F.col("turn").alias("level"), F.lit(k).alias("rank"), m.alias("props")) for k, m in ((0, near), (1, far))]
    out = D.merged_list_styles(rows[0].unionByName(rows[1]))
    return out.select(F.col("path").alias("conv_id"), F.col("level").alias("turn"), F.col("props")["font"].alias("font"), F.col("props")["bullet"].alias("bullet"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size < 27 THEN chr((64 + p_size)::INT) ELSE chr((64 + (p_size - 1) // 26)::INT) || chr((65 + (p_size - 1) % 26)::INT) END AS marker FROM part")
def t5_counter_formats(spark, d):
    style = F.when(F.col("p_size") % 7 == 0, "bullet").otherwise("upperLetter")
    return t(spark, d, "part").select("p_partkey", S.counter(F.col("p_size"), style).alias("marker"))

