import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents as D
from gridloom.sources import build as B
from gridloom.sources import packages, texts


def _item(num, level):
    return B.paragraph("x", f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def _level(k, start, form, text):
    return f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/></w:lvl>'


def test_lists_read_once(spark):
    """lists of a document need its file once, and are as by joins: starts, overrides, links by style, tables, unknown lists."""
    numbering = (
        f'<w:abstractNum w:abstractNumId="7">{_level(0, 3, "decimal", "%1.")}{_level(1, 1, "upperLetter", "%1.%2")}{_level(2, 1, "lowerRoman", "%3)")}</w:abstractNum>'
        f'<w:abstractNum w:abstractNumId="8"><w:numStyleLink w:val="L"/></w:abstractNum><w:abstractNum w:abstractNumId="9"><w:styleLink w:val="L"/>{_level(0, 1, "lowerLetter", "(%1)")}{_level(1, 1, "bullet", "-")}</w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>'
        '<w:num w:numId="3"><w:abstractNumId w:val="8"/></w:num><w:num w:numId="4"><w:abstractNumId w:val="77"/></w:num>'
    )
    cell = f"<w:tbl><w:tr><w:tc>{_item(2, 0)}{_item(2, 1)}</w:tc></w:tr></w:tbl>"
    body = "".join(_item(*x) for x in [(1, 0), (1, 1), (1, 2), (1, 1), (1, 0), (1, 2), (2, 0), (3, 0), (0, 0), (4, 0), (1, 7), (3, 1), (3, 0)]) + B.paragraph("y") + cell + _item(2, 1)
    files = spark.createDataFrame([("a", bytearray(B.document(body, numbering=numbering))), ("b", bytearray(B.document(_item(1, 0)))), ("c", bytearray(b"PK"))], "path string, content binary")
    recs = packages.records(files, texts.read_docx)
    paras = D.blocks(recs).select("path", "ord", "num_id", "level")
    shown = ["path", "ord", "num_id", "level", "abstract", "format", "text_of_level", "value", "marker"]
    rows = lambda df: sorted(map(tuple, df.select(shown).collect()))
    got = rows(D.list_items(packages.records(files, texts.read_list_items)))
    assert got == rows(D.list_markers(paras, D.list_levels(recs)))
    assert [x[-1] for x in got if x[2] == "1"] == ["3.", "3.A", "i)", "3.B", "4.", "i)"] and [x[-1] for x in got if x[2] == "3"] == ["(a)", "-", "(b)"] and [x[-1] for x in got if x[2] == "2"] == ["5.", "6.", "6.A", "6.B"]

    from gridloom.plans import catalog

    plan = catalog.queries()["w12_list_counters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


def test_files_of_groups(spark):
    """Files of rows in any order, several to a batch, each from its own rows alone."""
    rows = spark.createDataFrame([(k, n, float(n)) for n in (3, 1, 2) for k in range(250)], "k int, n int, v double")
    files = B.files_of(rows.repartition(3), "k", ["n"], "txt", lambda p: f"{p.k.iloc[0]}:{list(p.n)}:{list(p.v)}".encode())
    assert {x["path"]: bytes(x["content"]).decode() for x in files.collect()} == {f"{k}.txt": f"{k}:[1, 2, 3]:[1.0, 2.0, 3.0]" for k in range(250)}


#: Numbers whose text depends on the sign of zero, on halves, or on what is no number.
ODD = [-0.0, 0.0, None, 0.125, -0.125, 0.375, 0.005, -0.005, -0.001, 2.675, 1e15, float("nan"), float("inf"), float("-inf"), 40250.0, -40250.0, 1234567.891]


def _by_sql(spark, tmp_path, table, name, schema, rows):
    """A query's rows over a table of rows, beside those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from gridloom.plans import catalog

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    return sorted(map(tuple, got)), sorted(want.fetchall())


def test_format_sections_print(spark, tmp_path):
    """numbers print as in the query's SQL, whatever they are."""
    got, want = _by_sql(spark, tmp_path, "customer", "n3_format_sections", "c_custkey long, c_acctbal double", list(enumerate(ODD)))
    assert got == want and got[:4] == [(0, "$-0.00 ", None), (1, "$0.00 ", None), (2, None, None), (3, "$0.12 ", None)]


def test_fixed_formats_print(spark, tmp_path):
    """exact halves go to the even digit, as in the query's SQL; the operator's own rule is the spreadsheet's."""
    from gridloom.functions import formats as N

    rows = [(k, 1, v, d) for k, (v, d) in enumerate(zip(ODD, [0.05, -0.0, 0.125, None, 0.005, 0.015, 0.025, -0.005, float("nan"), 0.07, 0.285, 1.0, float("inf"), 0.1, 0.06, 0.0, 0.29]))]
    got, want = _by_sql(spark, tmp_path, "lineitem", "n5_fixed_formats", "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double", rows)
    assert got == want and [x[4] for x in got if x[0] in (14, 15)] == ["40.2K", "-40.2K"]
    assert spark.range(1).select(N.format_value(F.lit(40250.0), '0.0,"K"')).first()[0] == "40.3K"
