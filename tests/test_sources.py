"""Files: dialects, encodings, workbooks, sinks, streams."""

import csv
import io
import random
import uuid
import zipfile
from datetime import datetime

import pytest

from lodeline.operators import cleaning
from lodeline.sources import csv_shape, memo, tabular, xlsx
from lodeline.sources import workbook as books
from lodeline.streaming.trends import run_to_end, windowed_trend

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        strings = []
        for k, rows in enumerate(sheets.values(), 1):
            out = []
            for i, row in enumerate(rows, 1):
                cells = ""
                for j, v in enumerate(row):
                    at = f"{chr(65 + j)}{i}"
                    if v is None:
                        continue
                    if isinstance(v, datetime):
                        cells += f'<c r="{at}" s="1"><v>{(v - datetime(1899, 12, 30)).days}</v></c>'
                    elif isinstance(v, str):
                        strings.append(v)
                        cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
                    else:
                        cells += f'<c r="{at}"><v>{v}</v></c>'
                out.append(f'<row r="{i}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData>{''.join(out)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
    return str(path)


@pytest.mark.parametrize("raw", [
    b"Region,Revenue\nWest,1200\nEast,900\n",
    b"Region;Revenue\nWest;1200\nEast;900\n",
    b"Region\tRevenue\nWest\t1200\nEast\t900\n",
    "﻿Region,Revenue\nWest,1200\nEast,900\n".encode(),
    b'Region,Revenue\n"West",1200\n"East",900\n',
])
def test_csv_dialects(spark, tmp_path, raw):
    path = tmp_path / "t.csv"
    path.write_bytes(raw)
    df, _ = cleaning.clean(tabular.read_table(spark, str(path)))
    assert df.columns[:2] == ["Region", "Revenue"]
    assert sum(r["Revenue"] for r in df.collect()) == 2100


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('name,code,note\nJosé,01234,"two\nlines, ""quoted"""\nNA,null,x\n'.encode("latin-1"))
    rows = tabular.read_table(spark, str(path)).orderBy("_ord").drop("_ord").collect()
    assert tuple(rows[0]) == ("José", "01234", 'two\nlines, "quoted"') and tuple(rows[1]) == (None, None, "x")


@pytest.mark.parametrize("encoding", ["latin-1", "utf-8"])
def test_csv_encoding_is_decided_over_the_whole_file(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(("name,code\n" + "plain words,1\n" * 100_000 + "José,2\nMüller,3\n").encode(encoding))
    assert path.stat().st_size > 1 << 20
    rows = tabular.read_table(spark, str(path)).where("code <> '1'").collect()
    assert sorted(r["name"] for r in rows) == ["José", "Müller"]


@pytest.mark.parametrize("raw", [b"ok", "ü漢😀".encode(), b"\xc3", b"a\xc3\nb", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe9\r\n", b"\xef\xbb\xbfx"])
def test_encoding_equals_a_whole_decode(spark, tmp_path, raw):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a,b\n" + raw)
    try:
        (b"a,b\n" + raw).decode("utf-8")
        want = "UTF-8"
    except UnicodeDecodeError:
        want = "ISO-8859-1"
    assert tabular.encoding_of(spark, str(path)) == want


@pytest.mark.parametrize("raw,words", [
    (b"a,b\n1,2\n3,4,5\n", "line 3 has 3 cells, and the header has 2"),
    (b"a,b\n3,4,5\n6,7,8\n", "line 2 has 3 cells"),
    (b'a,b\n1,"x\ny"\n"3,4\n5,6\n', "quote opened in line 4 is never closed"),
    (b'a,b\n\n"x\n\ny",2\n"u\nv",1,2\n', "line 6 has 3 cells"),
    (b'a,b\n"u\nv,w",1,2\n', "line 2 has 3 cells"),
    (b'a;b\n1;"x;y";3\n', "line 2 has 3 cells"),
    (b'a,b\n\xe9,"\n', "quote opened in line 2"),
])
def test_csv_malformed(spark, tmp_path, raw, words):
    path = tmp_path / "t.csv"
    path.write_bytes(raw)
    with pytest.raises(ValueError, match=words):
        tabular.read_table(spark, str(path))


@pytest.mark.parametrize("raw,rows", [
    (b"a,b,c\n1\n2,3\n4,5,6\n", [("1", None, None), ("2", "3", None), ("4", "5", "6")]),
    (b'a,b\n"x ""q"", z",3\n5" pipe,4\n', [('x "q", z', "3"), ('5" pipe', "4")]),
    (b'"a","b"\n"",""\n"""",2\n\n"1,2",3\n', [(None, None), ('"', "2"), ("1,2", "3")]),
    (b'a,b\n"x\ny, z\n""w""",2\n', [('x\ny, z\n"w"', "2")]),
])
def test_csv_well_formed(spark, tmp_path, raw, rows):
    path = tmp_path / "t.csv"
    path.write_bytes(raw)
    assert [tuple(r) for r in tabular.read_table(spark, str(path)).orderBy("_ord").drop("_ord").collect()] == rows


@pytest.mark.parametrize("seed", range(6))
def test_csv_shape_over_splits(spark, tmp_path, seed):
    """Against the standard reader, with the file cut into parts of some 30 bytes, so that cells reach over several."""
    draw, out = random.Random(seed), io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    cell = lambda: "".join(draw.choices(["a", "b", ",", '"', "\n", " "], [6, 6, 1, 1, 2, 1], k=draw.randrange(12)))
    write.writerow(["k", "v"])
    for _ in range(40):
        write.writerow(["x" + cell(), cell()])
    text = out.getvalue()
    broken = {1: text + 'end,"never\nclosed', 2: text + 'one,"two\n\n",three\n' + text[4:]}.get(seed, text)
    path = tmp_path / "t.csv"
    path.write_text(broken)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if seed in (1, 2):
            line = text.count("\n") + 1
            with pytest.raises(ValueError, match=f"line {line} " + ("is never closed" if seed == 1 else "has 3 cells")):
                csv_shape.shape_of(spark, str(path), ",", 2)
        else:
            assert csv_shape.shape_of(spark, str(path), ",", 2) == csv_shape.Shape("UTF-8", any("\n" in c for r in csv.reader(io.StringIO(text)) for c in r))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_workbook_source(spark, tmp_path):
    rows = [["Team", "Count"], *[[f"T{k} <&>", k / 2] for k in range(1234)]]
    path = workbook(tmp_path / "b.xlsx", {"First": [["only"], ["one"]], "Long": [[str(x).replace("&", "&amp;").replace("<", "&lt;") if isinstance(x, str) else x for x in r] for r in rows]})
    reader = lambda **o: books.register(spark).read.format("workbook").options(path=path, **o).load()
    assert reader().columns == ["_ord", "only"]
    long = reader(sheet="Long", rows=100)
    assert [(r["Team"], float(r["Count"])) for r in long.orderBy("_ord").collect()] == [tuple(r) for r in rows[1:]]
    every = reader(sheet="*").collect()
    assert {(r["sheet"], r["row"]): r["cells"] for r in every if r["row"] < 2} == {("First", 0): ["only"], ("First", 1): ["one"], ("Long", 0): ["Team", "Count"], ("Long", 1): ["T0 <&>", "0.0"]}
    assert len(every) == 2 + len(rows)
    with pytest.raises(Exception, match="no sheet named"):
        reader(sheet="Other")


def test_workbook_is_written_and_read_in_parts(spark, tmp_path):
    table = spark.range(950).selectExpr("id AS k", "concat('a <b> & \"', id, '\" ') AS t", "CASE WHEN id % 3 = 0 THEN NULL ELSE id / 7 END AS v")
    path = str(tmp_path / "w.xlsx")
    tabular.write_workbook(table, path, "A & B")
    assert tabular.list_sheets(spark, path) == ["A & B"]
    got = books.register(spark).read.format("workbook").options(path=path, rows=100).load()
    assert got.rdd.getNumPartitions() == 10
    assert [(int(r["k"]), r["t"], r["v"] and float(r["v"])) for r in got.orderBy("_ord").collect()] == [(r["k"], r["t"], r["v"]) for r in table.collect()]


def test_rows_of_sheets_in_any_dialect():
    """Prefixes, own name spaces, empty rows, tags cut by blocks of every size."""
    sheet = b'<?xml version="1.0"?><x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:y="urn:y"><x:rowBreaks/><x:sheetData><x:row r="1" y:z="1"><x:c><x:v>1</x:v></x:c></x:row><x:row/><x:row r="3"><x:c r="B3" t="inlineStr"><x:is><x:t>a &gt; b</x:t></x:is></x:c></x:row ></x:sheetData></x:worksheet>'
    for size in range(1, 90):
        found = [x for _, x in xlsx.row_elements(io.BytesIO(sheet), 0, size)]
        assert len(found) == 3 and found[1] == b"<x:row/>" and [x for _, x in xlsx.row_elements(io.BytesIO(sheet), 2, size)] == found[2:]
    with io.BytesIO() as raw:
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("s.xml", sheet)
        with zipfile.ZipFile(raw) as book:
            assert list(xlsx.sheet_rows(book, "s.xml")) == [["1"], [], [None, "a > b"]]


def jobs_of(spark, run):
    """What a call gives, and how many Spark jobs it took."""
    sc, group = spark.sparkContext, f"test-{uuid.uuid4()}"
    sc.setJobGroup(group, "counted")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_memo_parses_equal_content_once(spark, tmp_path):
    one, two, other = (tmp_path / f"{n}.csv" for n in ("one", "two", "other"))
    one.write_text("a,b\n1,x\n2,y\n")
    two.write_text("a,b\n1,x\n2,y\n")
    other.write_text("a,b\n2,y\n1,x\n")  # the same lines in another order
    scans = memo.ScanMemo(spark)
    key, table = scans.read(str(one))
    path = scans.path(key).removeprefix("file://")
    (again, same), jobs = jobs_of(spark, lambda: scans.read(str(two)))
    # One aggregate, which adaptive execution runs as a job for each of its two stages.
    assert again == key and same is table and jobs <= 2 and scans.references(key) == 2
    assert [tuple(r) for r in table.orderBy("_ord").drop("_ord").collect()] == [("1", "x"), ("2", "y")]
    assert scans.read(str(other))[0] != key
    scans.release(key)
    assert (tmp_path / path).exists() and scans.references(key) == 1
    scans.release(key)
    assert not (tmp_path / path).exists() and scans.references(key) == 0
    book = workbook(tmp_path / "b.xlsx", {"A": [["x"], ["1"]], "B": [["y"], ["2"]]})
    keys = {scans.read(book, s)[0] for s in ("A", "B", "A")}
    assert len(keys) == 2


def test_memo_keeps_nothing_of_a_failed_read(spark, tmp_path):
    bad = tmp_path / "t.csv"
    bad.write_text("a\n1,2\n")
    scans = memo.ScanMemo(spark)
    for _ in range(2):
        with pytest.raises(ValueError, match="line 2"):
            scans.read(str(bad))
    assert not scans.tables


def test_workbooks(spark, tmp_path):
    one = workbook(tmp_path / "two.xlsx", {"Sales": [["Region", "Revenue", "Order Date"], ["West", 1200, datetime(2024, 1, 2)], ["East", 900.5, None]], "Operations": [["Team", "Tickets"], ["A", 3]]})
    assert tabular.list_sheets(spark, one) == ["Sales", "Operations"]
    df, _ = cleaning.clean(tabular.read_table(spark, one))
    rows = df.orderBy("_ord").collect()
    assert rows[0]["Order Date"] == datetime(2024, 1, 2) and rows[1]["Revenue"] == 900.5 and rows[1]["Order Date"] is None
    assert tabular.read_table(spark, one, "Operations").first()["Team"] == "A"


def test_rejects(spark, tmp_path):
    for name, raw, words in (("a.xlsx", b"no zip", "not a valid Excel workbook"), ("b.csv", b"", "empty"), ("c.json", b"{}", "supports")):
        path = tmp_path / name
        path.write_bytes(raw)
        with pytest.raises(Exception, match=words):
            tabular.read_table(spark, str(path)).count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "x long, y string")
    tabular.write_csv(tabular.with_order(df), str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0].asDict() == {"x": "1", "y": "a,b"}
    tabular.write_text(spark, "# Brief\n", str(tmp_path / "brief.md"))
    assert (tmp_path / "brief.md").read_text() == "# Brief\n"
    assert tabular.preview(df, 5).collect() == df.collect()


def test_stream_drops_what_is_late(spark, tmp_path):
    schema = "ts timestamp_ntz, value double"
    source = str(tmp_path / "in")
    at = lambda d, h=0: datetime(2024, 1, d, h)
    for batch in ([(at(1), 1.0), (at(1, 5), 2.0), (at(5), 4.0)], [(at(1, 6), 100.0), (at(9), 8.0)], [(at(20), 1.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        trend = windowed_trend(spark.readStream.schema(schema).parquet(source), "ts", "value")
        run_to_end(trend, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = {r["period"].day: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1] == 3.0 and rows[5] == 4.0
