import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import conditional as C
from gridloom.operators import grid as G
from gridloom.sources import containers, delimited


def test_filters(spark):
    df = spark.createDataFrame([(2, "A", "90"), (3, "B", "70"), (4, "A", "85"), (5, "B", "60"), (6, "A", "95")], "r int, g string, score string")
    rows = lambda c: [x["r"] for x in df.filter(c).orderBy("r").collect()]
    assert rows(G.in_values(F.col("g"), ["A"])) == [2, 4, 6]
    assert rows(G.in_values(F.col("g"), [])) == []
    assert rows(G.in_values(F.col("g"), ["A"]) & G.custom(F.col("score"), [("greaterThan", "88")])) == [2, 6]
    assert rows(G.custom(F.col("score"), [("lessThan", "80")])) == [3, 5]
    hidden = spark.createDataFrame([(3,), (3,), (9,)], "r int")
    shown = lambda *a: [x["r"] for x in G.visible(df, "r", hidden, *a).orderBy("r").collect()]
    assert shown() == [2, 4, 5, 6] and shown(4) == [2, 4] and shown(1) == []


def test_conditional_formats(spark):
    df = spark.createDataFrame([(i, float(10 * i)) for i in range(1, 6)], "r int, v double")
    hits = lambda **k: [x["r"] for x in C.top_n(df, "v", **k).filter("hit").orderBy("r").collect()]
    assert hits(rank=2) == [4, 5] and hits(rank=40, percent=True) == [4, 5] and hits(rank=60, percent=True) == [3, 4, 5] and hits(rank=20, percent=True, bottom=True) == [1]
    s = C.with_stats(df, "v").orderBy("r")
    three = [x[0] for x in s.select(C.scale(F.col("v"), F.col("min"), F.col("max"), ["#ffffff", "#ffeb84", "#63be7b"])).collect()]
    assert three[1] == "#fff5c2"
    assert [x[0] for x in s.select(C.scale(F.col("v"), F.col("min"), F.col("max"), ["#000000", "#ffffff"])).collect()][2] == "#808080"


def test_serials(spark):
    got = spark.createDataFrame([(float(x),) for x in (1, 2, 59, 60, 61, 45000)], "s double").select(S.serial_date_text(F.col("s"))).collect()
    assert [x[0] for x in got] == ["1900-01-01", "1900-01-02", "1900-02-28", "1900-02-29", "1900-03-01", "2023-03-15"]


def test_delimited(spark):
    assert delimited.parse('a,"b ""x"""y,c\r\n1,2\n\n') == [["a", 'b "x"y', "c"], ["1", "2"]]
    heads = ["a;b\n1;2\n", "a,b;c\r\n1,2\r\n", "plain", "", "x\ty|z\n1\t2|3", "a|b\n\nc|d\ne"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in heads], "t string").select(delimited.sniffed(F.col("t"))).collect()] == [";", ",", ",", ",", "\t", "|"]
    got = delimited.cells(spark.createDataFrame([("x.tsv", "n\t1,234\n\t5d")], "path string, text string")).orderBy("r", "c").collect()
    assert [(x["r"], x["c"], x["num"]) for x in got] == [(1, 1, None), (1, 2, 1234.0), (2, 2, None)]


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_workbook(spark):
    book = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>hi</t><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/a.xml": '<worksheet><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c><v>4</v></c></row></sheetData></worksheet>',
    })
    files = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(book[:-40])), ("c", bytearray(_zip({"../e.xml": "x"}))), ("d", bytearray(_zip({"big": b"\0" * (80 << 20)})))], "path string, content binary")
    got = containers.read_workbooks(files).collect()
    assert [(x["sheet"], x["r"], x["c"], x["text"]) for x in got if x["path"] == "a"] == [("S", 1, 2, "hi"), ("S", 1, 3, "4")]
    errors = {x["path"]: x["error"] for x in got if x["error"]}
    assert set(errors) == {"b", "c", "d"} and "unsafe" in errors["c"] and "bomb" in errors["d"]
    assert {x[0] for x in files.select(containers.signature(F.col("content"))).collect()} == {"zip"}


def test_catalogue_columns(spark):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.sql(f"create view {name} as select * from '{d}/{name}.parquet'")
    sql = e.oracle_sql()
    for name, f in e.queries().items():
        if name in sql and not name.startswith("op"):
            df = f(spark, d)
            rel = c.sql(sql[name])
            assert sorted(df.columns) == sorted(rel.columns), name
            assert df.count() == len(rel.fetchall()), name


#: Formats and what they show.
FORMATS = [
    (1, "yyyy-mm-dd", "1900-01-01"), (59, "yyyy-mm-dd", "1900-02-28"), (60, "yyyy-mm-dd", "1900-02-29"), (61, "yyyy-mm-dd", "1900-03-01"), (45000, "yyyy-mm-dd", "2023-03-15"),
    (61, "ddd", "Thu"), (0.5, "hh:mm:ss", "12:00:00"), (0.25, "hh:mm", "06:00"), (1.5, "[h]:mm", "36:00"), (0.75, "h:mm AM/PM", "6:00 PM"), (42, "General", "42"), (0.1, "General", "0.1"),
    (1234567, "#,##0", "1,234,567"), (3.14159, "0.00", "3.14"), (0.125, "0.00", "0.13"), (2.5, "0", "3"), (0.25, "0%", "25%"), (12.5, '"$"#,##0.00', "$12.50"), (-5, "0;[Red]-0", "-5"), (-5, "0;(0)", "(5)"), (-5, "0.0", "-5.0"),
    (0, "#", ""), (7, "000", "007"), (12345, "0.00E+00", "1.23E+04"), (0.00012, "0.0E-0", "1.2E-4"), (1.5, "# ?/?", "1 1/2"), (0.5, "?/8", "4/8"), (-3.5, "$#,##0.00_);[Red]($#,##0.00)", "($3.50)"), (3.5, "$#,##0.00_);[Red]($#,##0.00)", "$3.50 "),
    (5, '[>=10]"big";"small"', "small"), (12, '[>=10]"big";"small"', "big"), (1500000, '0.0,,"M"', "1.5M"), (1.5e15 + 0.5, "General", "1.5E+15"), (1e-5, "General", "1E-5"),
]


def test_number_formats(spark):
    from gridloom.functions import formats as N

    one = spark.range(1)
    got = one.select(*(N.format_value(F.lit(float(v)), code).alias(f"c{k}") for k, (v, code, _) in enumerate(FORMATS))).first()
    assert [(*FORMATS[k][:2], x) for k, x in enumerate(got)] == FORMATS
    row = one.select(N.format_text(F.lit("note"), "0;0;0;@"), N.format_text(F.lit("note"), '0;0;0;"<"@">"'), N.format_value(F.lit(None).cast("double"), "0"), N.format_colour(F.lit(-5.0), "0;[Red]-0"), N.format_value(F.lit(1.0), "yyyy-mm-dd", date1904=True)).first()
    assert list(row) == ["note", "<note>", "", "red", "1904-01-02"]


def test_plans(spark):
    """Filters reach the scan, and nothing is sorted or windowed in one task."""
    from gridloom.plans import catalog

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    d, q = "/root/testdata/sf0.001", catalog.queries()
    pushed = plan(q["f2_custom_filter"](spark, d))
    assert "GreaterThanOrEqual(p_size,10)" in pushed and "LessThan(p_size,20)" in pushed
    assert "Window" not in plan(q["w3_duplicates"](spark, d))
    assert "SinglePartition" not in plan(q["w9_outline_groups"](spark, d))
    assert "collect_list" not in plan(q["w4_thresholds"](spark, d))
    assert plan(q["flagship"](spark, d)).count("Scan parquet") <= 3
    assert plan(q["n5_fixed_formats"](spark, d)).count("format_number") <= 12


def test_ranked_values(spark, monkeypatch):
    monkeypatch.setattr(C, "SORTED", 50)
    for values in ([float(x * 7 % 1000) for x in range(1000)], [1.0] * 600 + [2.0] * 400, [float(x % 3) for x in range(500)], [5.0]):
        num = spark.createDataFrame([(v,) for v in values], "v double").cache()
        for k in {1, len(values) // 2 + 1, len(values)}:
            assert C.ranked_value(num, k, len(values)) == sorted(values)[k - 1]


def test_outline_runs_across_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(r, rng.choice([0, 1, 1, 2, 3])) for r in range(200) if rng.random() > 0.05]
    want = set()
    for level in (1, 2, 3):
        have = sorted(r for r, o in rows if o >= level)
        for r in have:
            if r - 1 not in have:
                e = r
                while e + 1 in have:
                    e += 1
                want.add((level, r, e))
    got = G.outline_groups(spark.createDataFrame(rows, "r long, outline int"), 3, run_rows=8)
    assert {(x["level"], x["first"], x["last"]) for x in got.collect()} == want


def test_large_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,"a ""b"", c",3\n,x,"1,200"\n')
    got = delimited.large_cells(spark, str(tmp_path / "a.csv")).orderBy("line", "c").collect()
    assert [(x["c"], x["text"], x["num"]) for x in got] == [(1, "n", None), (2, 'a "b", c', None), (3, "3", 3.0), (2, "x", None), (3, "1,200", 1200.0)]


def test_files_as_they_arrive(spark, tmp_path):
    from gridloom.sources import build, packages, sheets
    from gridloom.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(build.workbook([("S", [[1.5, "x"]], "")]))
    (tmp_path / "in" / "b.xlsx").write_bytes(b"PK\x03\x04 broken")
    recs = files.arriving(spark, str(tmp_path / "in"), sheets.read_workbook)
    recs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert packages.of_kind(out, "cell", "v string").count() == 2 and out.filter("kind = 'error'").count() == 1
