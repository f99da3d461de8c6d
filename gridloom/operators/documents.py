"""Operators over what the readers yield: styles, lists, tables, placeholders, links, declared filters, facts and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import counter, escape_html, js_number
from gridloom.sources.packages import of_kind

MAX_CHAIN = 30
#: Rows of a bucket by which cells meet rectangles.
BUCKET = 1024


# Sheets


def cells(recs: DataFrame) -> DataFrame:
    """(path, scope, r, c, t, v, s, f, text, num, flag): shared strings are joined in by index, a missing one is empty."""
    own = of_kind(recs, "cell", "r int, c int, t string, v string, s int, f string", "scope")
    strings = of_kind(recs, "string", "i string, text string").withColumnRenamed("i", "v")
    out = own.join(strings, ["path", "v"], "left")
    text = F.when(F.col("t") == "s", F.coalesce("text", F.lit(""))).when(F.col("t") == "b", F.when(F.lower("v").isin("1", "true"), "TRUE").otherwise("FALSE")).otherwise(F.col("v"))
    return out.withColumn("text", text).withColumn("num", F.when(F.col("t") == "n", F.col("v").try_cast("double"))).withColumn("flag", F.when(F.col("t") == "b", F.lower("v").isin("1", "true")))


def sheets(recs: DataFrame, visible: bool = False) -> DataFrame:
    """(path, name, index, state, sheet_id, part) of the sheets, or of the visible ones."""
    out = of_kind(recs, "sheet", "name string, index int, state string, sheet_id int, part string")
    return out.filter("state = 'visible'") if visible else out


def sheet_index(recs: DataFrame, names: DataFrame) -> DataFrame:
    """names (path, name) with `index`: the first sheet of that very name, or -1."""
    first = sheets(recs).groupBy("path", "name").agg(F.min("index").alias("index"))
    return names.join(first, ["path", "name"], "left").withColumn("index", F.coalesce("index", F.lit(-1)))


def columns(recs: DataFrame) -> DataFrame:
    """(path, scope, c, style, hidden, width): column definitions, one row a column; the later one holds."""
    own = of_kind(recs, "col", "min int, max int, width double, hidden int, style int, outline int", "scope", "ord").filter("max >= min")
    each = own.select("path", "scope", "ord", F.explode(F.sequence("min", "max")).alias("c"), "style", "hidden", "width")
    return each.groupBy("path", "scope", "c").agg(F.max_by(F.struct("style", "hidden", "width"), "ord").alias("d")).select("path", "scope", "c", "d.*")


def styled(recs: DataFrame, own: DataFrame) -> DataFrame:
    """cells() with bold, italic, colour, pattern, fill_colour, border_top, align and code: a cell's own style, else its row's,
    else its column's, else the first; a style that is missing counts as the first."""
    rows = of_kind(recs, "row", "r int, s int", "scope").withColumnRenamed("s", "row_style")
    cols = columns(recs).select("path", "scope", "c", F.col("style").alias("col_style"))
    xf = of_kind(recs, "xf", "id int, number_format int, font int, fill int, border int, align string")
    font = of_kind(recs, "font", "id int, bold int, italic int, colour string").withColumnRenamed("id", "font")
    fill = of_kind(recs, "fill", "id int, pattern string, colour string").withColumnsRenamed({"id": "fill", "colour": "fill_colour"})
    border = of_kind(recs, "border", "id int, top string").withColumnsRenamed({"id": "border", "top": "border_top"})
    code = of_kind(recs, "number_format", "id int, code string").withColumnRenamed("id", "number_format")
    out = own.join(rows, ["path", "scope", "r"], "left").join(cols, ["path", "scope", "c"], "left")
    out = out.withColumn("style", F.coalesce("s", "row_style", "col_style", F.lit(0))).join(xf.select("path", F.col("id").alias("style"), F.lit(True).alias("known")), ["path", "style"], "left")
    out = out.withColumn("style", F.when(F.col("known"), F.col("style")).otherwise(0)).drop("known", "row_style", "col_style")
    out = out.join(xf.withColumnRenamed("id", "style"), ["path", "style"], "left")
    for d, k in ((font, "font"), (fill, "fill"), (border, "border"), (code, "number_format")):
        out = out.join(d, ["path", k], "left")
    usual = F.create_map(*(F.lit(x) for kv in BUILTIN_FORMATS.items() for x in kv))
    return out.withColumn("code", F.coalesce("code", usual[F.col("number_format")], F.lit("General")))


#: Number formats that workbooks name by id alone.
BUILTIN_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@"}


def hidden_rows(recs: DataFrame) -> DataFrame:
    return of_kind(recs, "row", "r int, hidden int", "scope").filter("hidden = 1").select("path", "scope", "r")


def hidden_columns(recs: DataFrame) -> DataFrame:
    return columns(recs).filter("hidden = 1").select("path", "scope", "c")


def filtered_out(recs: DataFrame, own: DataFrame) -> DataFrame:
    """(path, scope, r): rows that a sheet's declared filters reject, by the text of own (path, scope, r, c, text). The range's
    first row is its header and always stays; a cell that is missing counts as blank text."""
    area = of_kind(recs, "filter_range", "r1 int, c1 int, r2 int, c2 int", "scope")
    specs = of_kind(recs, "filter", "col int, spec string", "scope").withColumn("j", F.from_json("spec", "values array<string>, custom array<array<string>>, `and` boolean"))
    inside = own.join(area, ["path", "scope"]).filter("r > r1 and r <= r2")
    rows = inside.select("path", "scope", "r").distinct().join(specs, ["path", "scope"])
    text = own.select("path", "scope", "r", F.col("c").alias("col"), "text")
    pairs = rows.join(text, ["path", "scope", "r", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    num = js_number(F.col("text"))

    def test(x: Column) -> Column:
        op, v = x[0], x[1]
        want = v.try_cast("double")
        ok = F.when(op == "greaterThan", num > want).when(op == "greaterThanOrEqual", num >= want).when(op == "lessThan", num < want).when(op == "lessThanOrEqual", num <= want).when(op == "equal", F.col("text") == v).when(op == "notEqual", F.col("text") != v).otherwise(F.lit(True))
        return F.coalesce(ok, F.lit(False))

    tests = F.transform("j.custom", test)
    custom = F.when(F.size(tests) == 0, True).when(F.col("j.and"), F.forall(tests, lambda x: x)).otherwise(F.exists(tests, lambda x: x))
    passes = F.when(F.col("j.values").isNotNull(), F.array_contains("j.values", F.col("text"))).when(F.col("j.custom").isNotNull(), custom).otherwise(F.lit(True))
    return pairs.filter(~passes).select("path", "scope", "r").distinct()


def filter_state(specs: DataFrame) -> DataFrame:
    """(path, scope, state): the declared filters of each sheet as one JSON text, by column."""
    one = F.struct(F.col("col"), F.col("spec"))
    by = specs.groupBy("path", "scope").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return by.select("path", "scope", F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["col"].cast("string"), x["spec"])))).alias("state"))


def filter_specs(states: DataFrame) -> DataFrame:
    """filter_state() undone."""
    return states.select("path", "scope", F.explode(F.from_json("state", "map<string,string>")).alias("col", "spec")).withColumn("col", F.col("col").cast("int"))


def in_rectangles(own: DataFrame, rects: DataFrame, keep: Sequence[str]) -> DataFrame:
    """own (path, scope, r, c, ...) beside every rectangle (path, scope, r1, c1, r2, c2, keep) that covers the cell."""
    b = rects.select("path", "scope", "r1", "c1", "r2", "c2", *keep, F.explode(F.sequence(F.floor(F.col("r1") / BUCKET), F.floor(F.col("r2") / BUCKET))).alias("rb"))
    hit = own.withColumn("rb", F.floor(F.col("r") / BUCKET)).join(b, ["path", "scope", "rb"]).filter("r between r1 and r2 and c between c1 and c2")
    return hit.drop("rb", "r1", "c1", "r2", "c2")


def format_rules(recs: DataFrame, own: DataFrame) -> DataFrame:
    """own cells beside the conditional rules of the blocks that cover them: block, rule, type, operator, text, formulas, stop."""
    ranges = of_kind(recs, "cf_range", "block int, r1 int, c1 int, r2 int, c2 int", "scope")
    hit = in_rectangles(own, ranges, ["block"]).dropDuplicates(["path", "scope", "r", "c", "block"])
    rules = of_kind(recs, "cf_rule", "block int, rule int, type string, operator string, text string, formulas string, stop int, dxf int", "scope").withColumnRenamed("text", "rule_text")
    return hit.join(rules, ["path", "scope", "block"])


def first_rule(matches: DataFrame) -> DataFrame:
    """(path, scope, r, c, block, rule, dxf): of format_rules() rows with a boolean `hit` the first block, and its first rule, that hits."""
    best = F.min_by(F.struct("block", "rule", "dxf"), F.struct("block", "rule"))
    return matches.filter("hit").groupBy("path", "scope", "r", "c").agg(best.alias("b")).select("path", "scope", "r", "c", "b.*")


def linked_cells(recs: DataFrame) -> DataFrame:
    """(path, scope, r, c, target): the link of each cell of linked ranges; the last one written holds."""
    own = of_kind(recs, "link", "r1 int, c1 int, r2 int, c2 int, target string, location string", "scope", "ord")
    each = own.select("path", "scope", "ord", F.coalesce("target", F.concat(F.lit("#"), "location")).alias("target"), F.explode(F.sequence("r1", "r2")).alias("r"), "c1", "c2")
    each = each.select("path", "scope", "ord", "target", "r", F.explode(F.sequence("c1", "c2")).alias("c"))
    return each.groupBy("path", "scope", "r", "c").agg(F.max_by("target", "ord").alias("target"))


def workbook_facts(recs: DataFrame) -> DataFrame:
    """(path, sheets, visible_sheets, n_cells, rows, columns, filters)."""
    book = sheets(recs).groupBy("path").agg(F.count("*").alias("sheets"), F.count_if(F.col("state") == "visible").alias("visible_sheets"))
    used = of_kind(recs, "cell", "r int, c int").groupBy("path").agg(F.count("*").alias("n_cells"), F.max("r").alias("rows"), F.max("c").alias("columns"))
    filters = of_kind(recs, "filter", "col int").groupBy("path").agg(F.count("*").alias("filters"))
    return book.join(used, "path", "left").join(filters, "path", "left").fillna(0, ["n_cells", "rows", "columns", "filters"])


#: How strong a border is where two cells meet.
BORDER_WEIGHTS = {"hair": 1, "dotted": 2, "dashDotDot": 3, "dashDot": 4, "dashed": 5, "thin": 6, "mediumDashDotDot": 7, "slantDashDot": 8, "mediumDashDot": 9, "mediumDashed": 10, "medium": 11, "double": 12, "thick": 13}


def stronger_border(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of edges (by, ord, style) the style of most weight at each place; the first of equals. `none` and nulls have no weight."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in BORDER_WEIGHTS.items() for x in kv))[F.col("style")], F.lit(0))
    return edges.groupBy(*by).agg(F.max_by("style", F.struct(weight, -F.col("ord"))).alias("style"))


def html_table(own: DataFrame, key: str) -> DataFrame:
    """(key, html): cells (key, r, c, text) as a table, rows and columns in order."""
    cell = F.concat(F.lit("<td>"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</td>"))
    rows = own.groupBy(key, "r").agg(F.sort_array(F.collect_list(F.struct("c", cell.alias("x")))).alias("l"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</tr>"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("r", row.alias("x")))).alias("l")).select(key, F.concat(F.lit("<table>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</table>")).alias("html"))


# Documents


def blocks(recs: DataFrame, story: str = "body") -> DataFrame:
    """Paragraphs, tables and cells of one story, in order of `ord`."""
    fields = "type string, parent int, depth int, style string, num_id string, level int, outline int, text string, section int, section_break int, table int, row int, cell int, span int, merge string, grid int, props string"
    return of_kind(recs.filter(F.col("scope") == story), "block", fields, "ord")


def is_heading(outline: Column) -> Column:
    return F.coalesce(outline.between(0, 8), F.lit(False))


def merged(maps: Column) -> Column:
    """One map of an array of maps<string,string>: later ones override, but never by null."""
    keys = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    last = F.transform(keys, lambda k: F.element_at(F.filter(F.transform(maps, lambda m: m[k]), lambda v: v.isNotNull()), -1))
    return F.map_filter(F.map_from_arrays(keys, last), lambda _, v: v.isNotNull())


def style_chains(styles: DataFrame, ident: str = "id", parent: str = "based_on") -> DataFrame:
    """(path, id, chain): each style's ancestors, root first, itself last; at most MAX_CHAIN of them, and none twice."""
    book = styles.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(ident, parent))).alias("up"))

    def step(chain: Column, _: Column) -> Column:
        above = chain["up"][F.element_at(chain["ids"], -1)]
        goes = above.isNotNull() & F.map_contains_key(chain["up"], F.coalesce(above, F.lit(""))) & ~F.array_contains(chain["ids"], F.coalesce(above, F.lit("")))
        return F.struct(F.when(goes, F.concat(chain["ids"], F.array(above))).otherwise(chain["ids"]).alias("ids"), chain["up"].alias("up"))

    own = styles.select("path", F.col(ident).alias("id")).join(book, "path")
    end = F.aggregate(F.sequence(F.lit(2), F.lit(MAX_CHAIN)), F.struct(F.array("id").alias("ids"), F.col("up")), step)
    return own.select("path", "id", F.reverse(end["ids"]).alias("chain"))


def cascaded(styles: DataFrame, chains: DataFrame, props: str) -> DataFrame:
    """(path, id, props): the properties along each chain, JSON objects of `props`, merged from the root on."""
    each = chains.select("path", "id", F.posexplode("chain").alias("at", "link"))
    own = styles.select("path", F.col("id").alias("link"), F.from_json(props, "map<string,string>").alias("m"))
    by = each.join(own, ["path", "link"]).groupBy("path", "id").agg(F.sort_array(F.collect_list(F.struct("at", F.to_json("m").alias("j")))).alias("l"))
    return by.select("path", "id", merged(F.transform("l", lambda x: F.from_json(x["j"], "map<string,string>"))).alias(props))


def list_levels(recs: DataFrame) -> DataFrame:
    """(path, num_id, abstract, level, start, format, text): numbers joined to their lists, through style links, with overrides."""
    lists = of_kind(recs, "list", "abstract string, style_link string, is_style string")
    linked = lists.select("path", F.col("is_style").alias("style_link"), F.col("abstract").alias("real")).filter("style_link is not null")
    real = lists.join(linked, ["path", "style_link"], "left").select("path", "abstract", F.coalesce("real", "abstract").alias("real"))
    levels = of_kind(recs, "level", "abstract string, level int, start int, format string, text string").withColumnRenamed("abstract", "real")
    over = of_kind(recs, "override", "num_id string, level int, start int").withColumnRenamed("start", "own_start")
    out = of_kind(recs, "num", "num_id string, abstract string").join(real, ["path", "abstract"]).join(levels, ["path", "real"])
    return out.join(over, ["path", "num_id", "level"], "left").select("path", "num_id", "abstract", "level", F.coalesce("own_start", "start").alias("start"), "format", "text")


def list_markers(paras: DataFrame, levels: DataFrame) -> DataFrame:
    """Paragraphs (path, ord, num_id, level) of lists with `value`, their counter, and `marker`, the level's text with %n
    replaced by the counter of level n in its own format. A paragraph resets the deeper counters of its list."""
    own = paras.filter("num_id is not null and num_id <> '0'").join(levels, ["path", "num_id", "level"])
    starts = levels.groupBy("path", "num_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("start", "format")))).alias("book"))
    return _marked(own.join(starts, ["path", "num_id"]))


def list_items(recs: DataFrame) -> DataFrame:
    """list_markers() of the records of texts.read_list_items(), which have each paragraph beside its level: the files are read
    once, and nothing is joined."""
    own = of_kind(recs, "item", "num_id string, level int, abstract string, start int, format string, text string, book string", "ord")
    book = F.transform_keys(F.from_json("book", "map<string,struct<start:int,format:string>>"), lambda k, _: k.cast("int"))
    return _marked(own.withColumn("book", book))


def _marked(own: DataFrame) -> DataFrame:
    """Paragraphs with their level's start, format and text, and their list's book of starts and formats, as list_markers() gives them."""
    order = Window.partitionBy("path", "num_id").orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    shallower = lambda k: F.sum(F.when(F.col("level") < k, 1).otherwise(0)).over(upto)
    own = own.withColumn("era", F.coalesce(F.element_at(F.array(*(F.coalesce(shallower(k), F.lit(0)) for k in range(9))), F.col("level") + 1), F.lit(0)))
    own = own.withColumn("value", F.row_number().over(Window.partitionBy("path", "num_id", "level", "era").orderBy("ord")) + F.col("start") - 1)
    own = own.withColumnRenamed("text", "text_of_level")
    for k in range(9):
        # The counter of a shallower level that stands, or its start where a still shallower paragraph has reset it.
        last = F.last(F.when(F.col("level") == k, F.col("value")).when(F.col("level") < k, F.lit(-1)), ignorenulls=True).over(before)
        found = F.when(F.col("level") == k, F.col("value")).when((last > 0) & (F.col("level") > k), last).otherwise(F.col("book")[k]["start"])
        own = own.withColumn(f"v{k}", found)
    shown = F.transform(F.array(*(F.struct(F.col(f"v{k}").alias("v"), F.col("book")[k]["format"].alias("f")) for k in range(9))), lambda x: F.coalesce(counter(x["v"], x["f"]), F.lit("")))
    marker = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.col("text_of_level"), lambda m, k: F.replace(m, F.concat(F.lit("%"), k.cast("string")), F.get(F.col("shown"), k - 1)))
    own = own.withColumn("shown", shown).withColumn("marker", F.when(F.col("format") == "none", "").otherwise(marker))
    return own.drop("era", "book", "start", "shown", *(f"v{k}" for k in range(9)))


def auto_bullets(paras: DataFrame) -> DataFrame:
    """Paragraphs (path, scope, shape, at, level, bullet) with `marker`: automatic numbers by text body and level, deeper ones
    started anew by a shallower automatic one; other bullets show their character."""
    kind, of = F.split("bullet", ":")[0], F.split("bullet", ":")
    auto = kind == "buAutoNum"
    body = Window.partitionBy("path", "scope", "shape").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    era = F.element_at(F.array(*(F.coalesce(F.sum(F.when(auto & (F.col("level") < k), 1).otherwise(0)).over(body), F.lit(0)) for k in range(9))), F.col("level") + 1)
    own = paras.withColumn("era", era).withColumn("auto", F.coalesce(auto, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("path", "scope", "shape", "level", "era", "auto").orderBy("at")) + of[2].cast("int") - 1
    style = F.regexp_replace(of[1], "(Period|ParenR|ParenBoth|Paren|Plain)$", "")
    shown = counter(n, F.create_map(*(F.lit(x) for x in ("romanUc", "upperRoman", "romanLc", "lowerRoman", "alphaUc", "upperLetter", "alphaLc", "lowerLetter")))[style])
    return own.withColumn("marker", F.when(F.col("auto"), F.concat(shown, F.when(of[1].contains("Paren"), ")").otherwise("."))).when(kind == "buChar", of[1])).drop("era", "auto")


def grid_columns(table_cells: DataFrame) -> DataFrame:
    """Table cells (path, table, row, cell, span, merge) with `column`, their first grid column."""
    w = Window.partitionBy("path", "table", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return table_cells.withColumn("column", F.coalesce(F.sum("span").over(w), F.lit(0)))


def row_spans(table_cells: DataFrame) -> DataFrame:
    """grid_columns() with `rows`: how many rows a cell covers; cells that only go on with one above are left out."""
    own = grid_columns(table_cells)
    w = Window.partitionBy("path", "table", "column").orderBy("row")
    # A run breaks where a cell starts one, or where a row has no cell at the column.
    new = F.coalesce(F.col("merge"), F.lit("")) != "continue"
    own = own.withColumn("run", F.sum((new | (F.lag("row").over(w) != F.col("row") - 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = own.groupBy("path", "table", "column", "run").agg(F.count("*").alias("rows"))
    return own.filter(new).join(span, ["path", "table", "column", "run"]).drop("run")


def column_counts(table_cells: DataFrame) -> DataFrame:
    """(path, table, columns): the widest row's sum of spans."""
    return table_cells.groupBy("path", "table", "row").agg(F.sum("span").alias("n")).groupBy("path", "table").agg(F.max("n").alias("columns"))


def authors(recs: DataFrame, kind: str) -> DataFrame:
    """(path, authors, n): distinct authors of comments or changes in the order in which they are first met, and the number of all."""
    own = of_kind(recs, kind, "author string", "ord")
    n = own.groupBy("path").agg(F.count("*").alias("n"))
    first = own.filter("author is not null").groupBy("path", "author").agg(F.min("ord").alias("at"))
    names = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "author"))).alias("l")).select("path", F.transform("l", lambda x: x["author"]).alias("authors"))
    return n.join(names, "path", "left")


def note_references(recs: DataFrame, kind: str) -> DataFrame:
    """(path, id, block, text): references in the body beside their notes; a note that is missing has no text."""
    refs = of_kind(recs.filter("scope = 'body'"), "run", "kind string, id string, block int").filter(F.col("kind") == kind).drop("kind")
    return refs.join(of_kind(recs, kind, "id string, text string"), ["path", "id"], "left")


def document_facts(recs: DataFrame) -> DataFrame:
    """(path, words, chars, headings, paragraphs, tables, notes, sections) of the body."""
    p = blocks(recs)
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    facts = p.groupBy("path").agg(
        F.sum(F.when(F.col("type") == "p", F.when(t == "", 0).otherwise(F.size(F.split(t, " "))))).alias("words"),
        F.sum(F.when(F.col("type") == "p", F.length("text"))).alias("chars"),
        F.count_if((F.col("type") == "p") & is_heading(F.col("outline"))).alias("headings"),
        F.count_if(F.col("type") == "p").alias("paragraphs"),
        F.count_if(F.col("type") == "tbl").alias("tables"),
    )
    notes = recs.filter(F.col("kind").isin("footnote", "endnote")).groupBy("path").agg(F.count("*").alias("notes"))
    return facts.join(notes, "path", "left").join(of_kind(recs, "document", "sections int"), "path", "left").fillna(0, ["notes"])


def pages(items: DataFrame, capacity: float, key: str = "path") -> DataFrame:
    """Items (key, ord, height, break_before, keep_next) with `page` from 0: an item that does not fit starts a page, and so does
    one to be kept with the next if both do not fit. Each document is one fold over its ordered items."""
    w = Window.partitionBy(key).orderBy("ord")
    need = F.col("height") + F.when(F.col("keep_next"), F.coalesce(F.lead("height").over(w), F.lit(0.0))).otherwise(0.0)
    by = items.withColumn("need", need).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "height", "need", F.coalesce("break_before", F.lit(False)).alias("cut")))).alias("l"))

    def step(a: Column, x: Column) -> Column:
        over = (a["used"] > 0) & (x["cut"] | (a["used"] + F.when(x["need"] <= capacity, x["need"]).otherwise(x["height"]) > capacity))
        page = F.when(over, a["page"] + 1).otherwise(a["page"])
        return F.struct(page.alias("page"), (F.when(over, 0.0).otherwise(a["used"]) + x["height"]).alias("used"), F.concat(a["out"], F.array(F.struct(x["ord"].alias("ord"), page.alias("page")))).alias("out"))

    kind = dict(items.dtypes)["ord"]
    start = F.struct(F.lit(0).alias("page"), F.lit(0.0).alias("used"), F.array().cast(f"array<struct<ord:{kind},page:int>>").alias("out"))
    placed = by.select(key, F.explode(F.aggregate("l", start, step)["out"]).alias("o")).select(key, "o.ord", "o.page")
    return items.join(placed, [key, "ord"])


# Decks


def shapes(recs: DataFrame, kind: str = "shape") -> DataFrame:
    """Shapes of slides, or prototypes of layouts and masters: scope is the slide's index, or the part."""
    fields = "id int, parent int, depth int, kind string, name string, ph_type string, ph_idx string, x long, y long, cx long, cy long, fill string, text string"
    return of_kind(recs, kind, fields, "scope")


def slides(recs: DataFrame) -> DataFrame:
    return of_kind(recs, "slide", "index int, part string, layout string, hidden int, title string, notes string", "scope")


def slide_texts(recs: DataFrame) -> DataFrame:
    """(path, scope, text): the text of a slide's shapes in order, white space collapsed."""
    own = shapes(recs).filter("text is not null and text <> ''")
    by = own.groupBy("path", "scope").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("l"))
    return by.select("path", "scope", F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), " "), r"\s+", " ")).alias("text"))


def deck_facts(recs: DataFrame) -> DataFrame:
    """(path, slides, hidden, with_notes, shapes, pictures, tables, charts); groups are no shapes."""
    own = slides(recs).groupBy("path").agg(F.count("*").alias("slides"), F.sum("hidden").alias("hidden"), F.count("notes").alias("with_notes"))
    count = shapes(recs).groupBy("path").agg(F.count_if(F.col("kind") != "group").alias("shapes"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("picture", "table", "chart")))
    return own.join(count, "path", "left").fillna(0)


def first_titles(recs: DataFrame, n: int = 3, chars: int = 50) -> DataFrame:
    """(path, titles): the first n titles that are not empty, collapsed and cut, joined by ` / `."""
    t = F.substring(F.trim(F.regexp_replace("title", r"\s+", " ")), 1, chars)
    by = slides(recs).withColumn("t", t).filter("t <> ''").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("index", "t"))).alias("l"))
    return by.select("path", F.array_join(F.transform(F.slice("l", 1, n), lambda x: x["t"]), " / ").alias("titles"))


def placed_shapes(recs: DataFrame) -> DataFrame:
    """Placeholders of slides with x, y, cx and cy, each from the shape itself, else from the layout's like placeholder, else
    the master's: the first of the same type, or of the same index unless a body is wanted."""
    own = shapes(recs).filter("ph_type is not null")
    layouts = slides(recs).select("path", "scope", F.col("layout").alias("near"))
    masters = of_kind(recs, "layout", "part string, master string").select("path", F.col("part").alias("near"), F.col("master").alias("far"))
    own = own.join(layouts, ["path", "scope"]).join(masters, ["path", "near"], "left")
    proto = shapes(recs, "prototype").filter("ph_type is not null")
    for where in ("near", "far"):
        p = proto.select("path", F.col("scope").alias(where), F.col("id").alias("pid"), F.col("ph_type").alias("pt"), F.col("ph_idx").alias("pi"), F.struct("x", "y", "cx", "cy").alias("box"))
        hit = own.select("path", "scope", "id", where, "ph_type", "ph_idx").join(p, ["path", where]).filter("pt = ph_type or (pi = ph_idx and ph_type <> 'body')")
        own = own.join(hit.groupBy("path", "scope", "id").agg(F.min_by("box", "pid").alias(f"{where}_box")), ["path", "scope", "id"], "left")
    return own.select("path", "scope", "id", "ph_type", "text", *(F.coalesce(k, f"near_box.{k}", f"far_box.{k}").alias(k) for k in ("x", "y", "cx", "cy")))


def merged_list_styles(levels: DataFrame) -> DataFrame:
    """(path, shape, level, props): list properties (path, shape, level, rank, props map), where rank 0 is nearest. The nearest
    source of a key wins and null is skipped, but for `bullet`, whose null is the word `none` and wins."""
    by = levels.groupBy("path", "shape", "level").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("k"), F.to_json("props").alias("j")))).alias("l"))
    return by.select("path", "shape", "level", merged(F.transform("l", lambda x: F.from_json(x["j"], "map<string,string>"))).alias("props"))
