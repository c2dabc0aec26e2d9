"""Discovery, readers and type inference."""

import bz2
import gzip
import io
import lzma
import zipfile

import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tessera
from tessera.errors import DuplicateColumnError, DuplicateTableError, EmptyDataError, InvalidDataError, NotFoundError, TesseraError, UnsupportedFormatError
from tessera.sources import formats, infer
from tessera.sources.formats import Codec, FileType, Format
from tessera.sources.infer import Kind
from tessera.sources.xlsx import Workbook, write_workbook


def rows(db, text, args=None):
    return [tuple(r) for r in db.sql(text, args).collect()]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a.csv", FileType(Format.CSV)), ("x/A.TSV.GZ", FileType(Format.TSV, Codec.GZIP)), ("l.ltsv.xz", FileType(Format.LTSV, Codec.XZ)), ("p.parquet", FileType(Format.PARQUET)), ("w.xlsx.zst", FileType(Format.XLSX, Codec.ZSTD)), ("b.csv.bz2", FileType(Format.CSV, Codec.BZIP2))],
)
def test_types_are_told_by_extension(path, expected):
    assert formats.detect(path) == expected
    assert formats.is_supported(path)


def test_other_files_are_not_supported():
    with pytest.raises(UnsupportedFormatError, match="unsupported file type"):
        formats.detect("a.txt")


@pytest.mark.parametrize(("path", "name"), [("/d/users.csv", "users"), ("users.v2.tsv.gz", "users.v2"), ("a b.ltsv", "a b"), (".csv", ".csv")])
def test_tables_are_named_after_files(path, name):
    assert formats.table_name(path) == name


@pytest.mark.parametrize(("raw", "name"), [("a b-c.d", "a_b_c_d"), ("2020", "table_2020"), ("  ", "table"), ("é!x", "x")])
def test_names_are_made_plain(raw, name):
    assert formats.sanitize(raw) == name


def test_compressed_copies_are_one_table(spark, files):
    plain, packed = files(a__csv="x\n1\n", a__csv__gz=gzip.compress(b"x\n2\n"))
    with tessera.open(packed, plain, spark=spark) as db:
        assert db.tables == ["a"] and rows(db, "SELECT x FROM a") == [(1,)]


def test_two_plain_files_of_one_name_are_an_error(spark, files):
    a, b = files(a__csv="x\n1\n", a__tsv="x\n2\n")
    with pytest.raises(DuplicateTableError):
        tessera.open(a, b, spark=spark)
    assert rows(tessera.open(a, b, spark=spark, last_wins=True), "SELECT x FROM a") == [(2,)]


def test_folders_are_walked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.tsv").write_text("y\n2\n")
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "notes.txt").write_text("no table")
    with tessera.open(str(tmp_path), spark=spark) as db:
        assert sorted(db.tables) == ["a", "b"]


def test_validation_messages(spark, tmp_path, files):
    with pytest.raises(TesseraError, match="at least one path must be provided"):
        tessera.Builder(spark).build()
    with pytest.raises(NotFoundError, match="path does not exist"):
        tessera.open(str(tmp_path / "no.csv"), spark=spark)
    with pytest.raises(UnsupportedFormatError, match="unsupported file type"):
        tessera.open(files(a__txt="x"), spark=spark)
    (tmp_path / "empty").mkdir()
    with pytest.raises(UnsupportedFormatError, match="no supported files found in directory"):
        tessera.open(str(tmp_path / "empty"), spark=spark)
    with pytest.raises(TesseraError, match="did you call Build"):
        tessera.Builder(spark).add_path("x.csv").open()
    with pytest.raises(TesseraError, match="reader cannot be nil"):
        tessera.Builder(spark).add_reader(None, "t", "csv")
    with pytest.raises(TesseraError, match="table name must be specified"):
        tessera.Builder(spark).add_reader(io.BytesIO(), " ", "csv")


VECTORS = [
    (["1", "2", "3"], Kind.INTEGER),
    (["1", "2.5"], Kind.REAL),
    (["1", "x"], Kind.TEXT),
    (["", "  ", None], Kind.TEXT),
    ([], Kind.TEXT),
    (["-3", "+4", ""], Kind.INTEGER),
    (["9223372036854775808"], Kind.REAL),
    (["1e5", ".5", "3."], Kind.REAL),
    (["2024-01-15", "2024-02-29"], Kind.DATETIME),
    (["2023-02-29"], Kind.TEXT),
    (["2024-01-15T10:30:00Z", "2024-01-15T10:30:00+09:00", "2024-01-15T10:30:00.123"], Kind.DATETIME),
    (["2024-01-15 10:30:00", "1/15/2024", "1/15/2024 2:30:00 PM", "15.1.2024 10:30:00"], Kind.DATETIME),
    (["10:30", "23:59:59.5"], Kind.DATETIME),
    (["24:00"], Kind.TEXT),
    (["13/45/2024"], Kind.TEXT),
    (["True", "False"], Kind.TEXT),
    (["1 2"], Kind.TEXT),
]


@pytest.mark.parametrize(("values", "kind"), VECTORS)
def test_inference(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer.infer(df)[0] == {"v": kind}


def test_cells(spark, files):
    path = files(t__csv='id,name,age,since\n1,"a, ""b""",,2024-01-01\n2, x ,3.5,\n')
    with tessera.open(path, spark=spark) as db:
        assert dict(db.table("t").dtypes) == {"id": "bigint", "name": "string", "age": "double", "since": "string"}
        assert db.table("t").schema["since"].metadata == {"logical": "datetime"}
        assert rows(db, "SELECT * FROM t ORDER BY id") == [(1, 'a, "b"', None, "2024-01-01"), (2, " x ", 3.5, "")]
    with tessera.open(path, spark=spark, empty_as="string") as db:
        assert dict(db.table("t").dtypes)["age"] == "string"
    with tessera.open(path, spark=spark, empty_as="null", datetime_mode="timestamp") as db:
        assert dict(db.table("t").dtypes)["since"] == "timestamp_ntz"


def test_quoted_line_ends_and_mixed_ones(spark, files):
    path = files(t__csv='a,b\r\n"x\ny",1\nz,2\r\n')
    assert rows(tessera.open(path, spark=spark), "SELECT a, b FROM t ORDER BY b") == [("x\ny", 1), ("z", 2)]


def test_byte_order_mark_and_foreign_letters(spark, files):
    path = files(t__csv="﻿名前,größe\nä,1\n")
    with tessera.open(path, spark=spark) as db:
        assert db.table("t").columns == ["名前", "größe"] and rows(db, "SELECT 名前 FROM t") == [("ä",)]


def test_header_only_gives_an_empty_table(spark, files):
    with tessera.open(files(t__csv="a,b\n"), spark=spark) as db:
        assert db.table("t").dtypes == [("a", "string"), ("b", "string")] and rows(db, "SELECT COUNT(*) FROM t") == [(0,)]


@pytest.mark.parametrize(
    ("content", "error"),
    [("", EmptyDataError), ("\n\n", EmptyDataError), ("a,A\n1,2\n", DuplicateColumnError), ("id,name,id\n", DuplicateColumnError), ("a,b\n1\n", InvalidDataError), ("a,b\n1,2,3\n", InvalidDataError), ('a,b\n"x,1\n', InvalidDataError)],
)
def test_malformed_texts(spark, files, content, error):
    with pytest.raises(error):
        tessera.open(files(t__csv=content), spark=spark)


def test_permissive_mode_fills_and_cuts(spark, files):
    db = tessera.open(files(t__csv="a,b\n1\n2,x,y\n"), spark=spark, mode="permissive")
    assert rows(db, "SELECT a, b FROM t ORDER BY a") == [(1, ""), (2, "x")]


def test_wide_and_long_cells(spark, files):
    wide = files(w__csv=",".join(f"c{i}" for i in range(300)) + "\n" + ",".join("1" * 300) + "\n")
    with tessera.open(wide, spark=spark) as db:
        assert len(db.table("w").columns) == 300
    long_ = files(l__csv="a\n" + "x" * 100_000 + "\n")
    assert rows(tessera.open(long_, spark=spark), "SELECT LENGTH(a) FROM l") == [(100_000,)]


def test_blank_column_names_are_numbered(spark, files):
    assert tessera.open(files(t__csv="a,,c\n1,2,3\n"), spark=spark).table("t").columns == ["a", "_c1", "c"]


@pytest.mark.parametrize(("extension", "pack"), [(".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".zst", zstandard.ZstdCompressor().compress)])
@pytest.mark.parametrize("kind", ["csv", "ltsv"])
def test_codecs(spark, tmp_path, extension, pack, kind):
    text = 'a,b\n1,"x\ny"\n2,z\n' if kind == "csv" else "a:1\tb:x\na:2\tb:z\n"
    (tmp_path / f"t.{kind}{extension}").write_bytes(pack(text.encode()))
    found = rows(tessera.open(str(tmp_path / f"t.{kind}{extension}"), spark=spark), "SELECT a, b FROM t ORDER BY a")
    assert found == [(1, "x\ny" if kind == "csv" else "x"), (2, "z")]


def test_corrupt_archive(spark, files):
    with pytest.raises(InvalidDataError):
        tessera.open(files(t__csv__gz=b"no gzip at all"), spark=spark)


def test_ltsv(spark, files):
    path = files(l__ltsv="time:2024-01-01T10:00:00Z\tlevel:INFO\n\nlevel:WARN\tn:0\tlevel:ERR\tnoise\turl:http://x\n")
    with tessera.open(path, spark=spark) as db:
        assert db.table("l").columns == ["time", "level", "n", "url"]
        assert rows(db, "SELECT level, n, url, time FROM l ORDER BY level") == [("ERR", 0, "http://x", ""), ("INFO", None, "", "2024-01-01T10:00:00Z")]
    assert tessera.open(path, spark=spark, column_order="sorted").table("l").columns == ["level", "n", "time", "url"]


def test_parquet_modes(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.sql("SELECT 1 AS i, 2.5D AS d, true AS b, DATE'1970-01-03' AS day, CAST(NULL AS STRING) AS s").coalesce(1).write.parquet(path)
    assert dict(tessera.open(path, spark=spark).table("p").dtypes)["d"] == "double"
    assert rows(tessera.open(path, spark=spark, parquet_mode="text"), "SELECT * FROM p") == [("1", "2.5", "1", "2", "")]


def book(**sheets):
    """A workbook of several sheets, made from single ones."""
    out = io.BytesIO()
    parts = {}
    for name, data in sheets.items():
        one = io.BytesIO()
        write_workbook(one, name, data)
        parts[name] = zipfile.ZipFile(one).read("xl/worksheets/sheet1.xml")
    with zipfile.ZipFile(out, "w") as z:
        ids = list(enumerate(parts, 1))
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in ids) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="x" Target="worksheets/s{i}.xml"/>' for i, _ in ids) + "</Relationships>")
        for i, n in ids:
            z.writestr(f"xl/worksheets/s{i}.xml", parts[n])
    return out.getvalue()


def test_workbooks(spark, files):
    data = book(People=[["id", "name"], ["1", "a"], ["2"]], Empty=[], Sales=[["x"], ["1.5", "beyond"]])
    with tessera.open(files(shop__xlsx=data), spark=spark) as db:
        assert db.tables == ["shop_People", "shop_Sales"]
        assert rows(db, "SELECT id, name FROM shop_People ORDER BY id") == [(1, "a"), (2, "")]
        assert rows(db, "SELECT x FROM shop_Sales") == [(1.5,)]
    with tessera.Builder(spark).add_reader(io.BytesIO(data), "first", "xlsx").build().open() as db:
        assert db.tables == ["first"] and db.table("first").count() == 2
    with pytest.raises(InvalidDataError):
        tessera.open(files(bad__xlsx=b"PK no"), spark=spark)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=8), min_size=1, max_size=5), min_size=1, max_size=6))
def test_workbook_round_trip(cells):
    out = io.BytesIO()
    write_workbook(out, "s", cells)
    assert list(Workbook(out.getvalue()).rows(0)) == cells


def test_readers_and_virtual_folders(spark, tmp_path):
    packed = tmp_path / "all.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("d/users.csv", "id\n1\n")
        z.writestr("logs.ltsv", "a:1\n")
        z.writestr("skip.txt", "x")
    db = tessera.Builder(spark).add_fs(zipfile.Path(packed)).add_reader(io.BytesIO(gzip.compress(b"x\ty\n1\t2\n")), "r", "tsv.gz").set_default_chunk_size(5).build().open()
    assert sorted(db.tables) == ["logs", "r", "users"] and rows(db, "SELECT x + y FROM r") == [(3,)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.floats(allow_nan=False, allow_infinity=False, width=64, min_value=-1e14, max_value=1e14), st.text(st.characters(blacklist_categories=("Cs", "Cc")), min_size=1, max_size=6).map(lambda s: f"t{s}t")), min_size=1, max_size=6))
def test_delimited_round_trip(spark, tmp_path_factory, values):
    from tessera.operators.sinks import DumpOptions, write_file

    path = str(tmp_path_factory.mktemp("rt") / "t.csv")
    df = spark.createDataFrame(values, "i long, d double, s string")
    write_file(df, path, DumpOptions())
    back = tessera.open(path, spark=spark).sql("SELECT i, CAST(d AS REAL) AS d, s FROM t").collect()
    assert sorted((r[0], float(r[1]), r[2]) for r in back) == sorted(values)
