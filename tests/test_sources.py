import json
import zipfile

import pytest

from assayframe.sources import inspect, readers, sinks
from conftest import rows


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("line,mark", [("a,b;c;d", ";"), ("a,b;c", ","), ("a\tb\tc,d", "\t"), ("a|b", "|"), ("plain", ",")])
def test_delimiter_of_the_first_line(spark, tmp_path, line, mark):
    path = put(tmp_path / "f.csv", f"{line}\n1|2|3|4|5|6\n")
    assert inspect.detect_delimiters(spark, path).first()["delimiter"] == mark


@pytest.mark.parametrize("encoding,found", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp1252", "cp1252"), ("utf-16", "utf-16")])
def test_encodings_round_trip(spark, tmp_path, encoding, found):
    path = put(tmp_path / "f.csv", "name;price\nCafé “x” €;5\nÉtoile – z;7\n", encoding)
    loaded = readers.read_delimited(spark, path)
    assert (loaded.encoding, loaded.delimiter) == (found, ";")
    assert sorted(rows(loaded.df)) == [("Café “x” €", 5), ("Étoile – z", 7)]


def test_latin_1_by_undefined_bytes(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b"a,b\n\x81\xe9,1\n")
    assert inspect.inspect_text(spark, str(path)).first()["encoding"] == "latin-1"


def test_non_ascii_after_the_head_is_seen(spark, tmp_path):
    path = put(tmp_path / "f.csv", "a,b\n" + "x,1\n" * 60_000 + "é,2\n", "cp1252")
    assert inspect.inspect_text(spark, path).first()["encoding"] == "cp1252"


def test_missing_tokens_and_types(spark, tmp_path):
    path = put(tmp_path / "f.csv", "i,x,b,s,m\n1,1.5,True,a,1\n2,NaN,False,N/A,x\nNA,2e3,True,null,\n")
    df = readers.load_dataset(spark, path).df
    assert dict(df.dtypes) == {"i": "bigint", "x": "double", "b": "boolean", "s": "string", "m": "string"}
    assert rows(df) == [(1, 1.5, True, "a", "1"), (2, None, False, None, "x"), (None, 2000.0, True, None, None)]


def test_quoted_newlines_and_delimiters(spark, tmp_path):
    path = put(tmp_path / "f.csv", 'a,b\n"one\ntwo","x, ""y"""\nplain,z\n')
    assert rows(readers.load_dataset(spark, path).df) == [("one\ntwo", 'x, "y"'), ("plain", "z")]


def test_folder_with_mixed_files(spark, tmp_path):
    put(tmp_path / "d" / "one.csv", "a,b\n1,x\n")
    put(tmp_path / "d" / "two.csv", "a;b\n2;y\n")
    loaded = readers.load_dataset(spark, str(tmp_path / "d"))
    assert sorted(rows(loaded.df)) == [(1, "x"), (2, "y")] and loaded.files == 2 and loaded.delimiter is None


def test_row_ids_follow_the_file(spark, tmp_path):
    path = put(tmp_path / "f.csv", "a\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    loaded = readers.read_delimited(spark, path, with_row_id=True)
    assert [r["a"] for r in loaded.df.orderBy(readers.ROW_ID).limit(3).collect()] == [0, 1, 2]


def test_row_limit_and_metadata(spark, tmp_path):
    path = put(tmp_path / "f.tsv", "a\tb\n" + "1\t2\n" * 20)
    loaded = readers.load_dataset(spark, path, max_rows=5)
    meta = loaded.metadata().first()
    assert (meta["rows_loaded"], meta["truncated"], meta["delimiter"], meta["type"]) == (5, True, "\t", "csv")
    assert readers.load_dataset(spark, path, max_rows=20).truncated is False


@pytest.mark.parametrize("layout", ["records", "lines", "columns"])
def test_json_layouts(spark, tmp_path, layout):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    text = {
        "records": json.dumps(data, indent=1), "lines": "\n".join(json.dumps(r) for r in data),
        "columns": json.dumps({c: {str(i): r[c] for i, r in enumerate(data)} for c in ("a", "b")}),
    }[layout]
    path = put(tmp_path / "f.json", text)
    assert readers.json_layout(spark, path) == layout
    assert rows(readers.load_dataset(spark, path).df.select("a", "b")) == [(1, "x"), (2, "y")]


def test_workbook_first_sheet(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="first" sheetId="1" r:id="r1"/><sheet name="second" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>day</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row>'
                      '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="C3"><v>8</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    loaded = readers.load_dataset(spark, str(path))
    assert rows(loaded.df) == [("ab", "2024-01-01 00:00:00", 7), (None, None, 8)]
    assert loaded.messages == ("Workbook has sheets: first, second",)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q "x", y'), (2, None)], "a int, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(rows(readers.load_dataset(spark, str(tmp_path / "csv")).df)) == [(1, 'q "x", y'), (2, None)]
    sinks.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    sinks.write_log(df, str(tmp_path / "log"))
    sinks.write_report(df.selectExpr("'x' AS section", "a AS seq", "s AS payload"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 2
