import json

import pytest

from stammwerk.sources import files
from stammwerk.sources.registry import Field, Registry, Table, header_normalise


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content)
    return path


def test_detection(tmp_path):
    assert files.detect_encoding("ä".encode()) == "utf-8" and files.detect_encoding("ä".encode("cp1252")) == "cp1252" and files.detect_encoding(b"\x81\xe4") == "latin-1"
    assert files.detect_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and files.detect_encoding("abc".encode("utf-16")) == "utf-16" and files.detect_encoding("abc".encode("utf-16-be")) == "utf-16-be" and files.detect_encoding(b"") == "utf-8"
    assert files.detect_delimiter(["a;b,c", "1;2", "3;4"]) == ";" and files.detect_delimiter(["a\tb", "1,5\t2"]) == "\t" and files.detect_delimiter([]) == ";"
    put(tmp_path, "b.csv", b"x;y\n1;2\n"), put(tmp_path, ".hidden.csv", b""), put(tmp_path, "a.md", b""), put(tmp_path, "skip_a.csv", b"")
    assert [p.name for p in files.scan_files(tmp_path, ["skip_*"])] == ["b.csv"]
    assert files.detect_format(tmp_path / "b.csv") == files.FormatInfo("csv", "utf-8", ";")
    assert files.clean_header(["A", "", "A", "﻿B"]) == ["A", "column_2", "A_2", "B"]
    assert len(files.file_hash(tmp_path / "b.csv")) == 64


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    plain = b"K;T\n" + b"1;abc\n" * 300_000
    path = put(tmp_path, "late.csv", plain + "2;\u00e4\n".encode("cp1252"))
    assert files.detect_format(path).encoding == "cp1252" and files.load(spark, path).table.filter("T = '\u00e4'").count() == 1
    assert files.detect_format(put(tmp_path, "late8.csv", plain + "2;\u00e4\n".encode())).encoding == "utf-8"
    broken = put(tmp_path, "x.csv", "K;T\n1;a\n".encode("utf-16") + b"\x00\xd8\x41\x00")
    with pytest.raises(ValueError, match="utf-16"):
        files.load(spark, broken)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
def test_csv(spark, tmp_path, encoding):
    text = 'K;Text;Z\n1;"a;ä""q""";x\n2;"zwei\nZeilen";y\n3;short\n4;too;many;cells\n5;;\n'
    path = put(tmp_path, "t.csv", text.encode(encoding))
    loaded = files.load(spark, path)
    assert loaded.columns == ["K", "Text", "Z"]
    assert sorted(tuple(r) for r in loaded.table.collect()) == [("1", 'a;ä"q"', "x"), ("2", "zwei\nZeilen", "y"), ("3", "short", ""), ("5", "", "")]
    assert [tuple(r) for r in loaded.rejects.collect()] == [("4;too;many;cells", "cell_count")]


@pytest.mark.parametrize("size", ["7", "40", "1000000"])
def test_records_by_ranges(spark, tmp_path, size):
    """However the file is cut, the records are those of a plain reader."""
    import random

    rng = random.Random(int(size))
    rows = [["".join(rng.choice('ab";\n\u00e4 x') for _ in range(rng.randint(0, 12))) for _ in range(3)] for _ in range(120)] + [["x" * 300 + "\n" * 40, "y", 'in "plain" z']]
    cell = lambda c: '"' + c.replace('"', '""') + '"' if c[:1] == '"' or any(x in c for x in ";\n") or rng.random() < 0.2 else c
    text = "".join(";".join(map(cell, r)) + rng.choice(["\n", "\r\n"]) for r in [["A", "B", "C"], *rows])
    path = put(tmp_path, "t.csv", text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        loaded = files.read_csv(spark, path, files.FormatInfo("csv"))
        got = sorted(tuple(r) for r in loaded.table.collect())
        assert loaded.rejects.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(tuple(r) for r in rows)


def test_probes(spark, tmp_path):
    import hashlib

    contents = {"a.csv": b"x;y\n1;2\n", "b.csv": b"x\n1", "c.csv": b"", "d.csv": "x\n1\n".encode("utf-16"), "e.csv": "\u00e4\n".encode("cp1252")}
    paths = [put(tmp_path, n, c) for n, c in contents.items()]
    found = {p.name: files.probe_files(spark, paths)[str(p)] for p in paths}
    assert {n: p.sha256 for n, p in found.items()} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()} and {n: p.ends_open for n, p in found.items()} == {"a.csv": False, "b.csv": True, "c.csv": False, "d.csv": False, "e.csv": False}
    assert {n: p.encoding for n, p in found.items()} == {"a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "utf-8", "d.csv": "utf-16", "e.csv": "cp1252"} and files.probe_files(spark, []) == {}


def test_unclosed_quote_and_empty_files(spark, tmp_path):
    loaded = files.load(spark, put(tmp_path, "u.csv", b'A;B\n1;2\n3;"never\n4;5\n'))
    assert [tuple(r) for r in loaded.table.collect()] == [("1", "2")] and [r.reason for r in loaded.rejects.collect()] == ["unclosed_quote"]
    assert files.load(spark, put(tmp_path, "h.csv", b"A;B\n")).table.count() == 0 and files.load(spark, put(tmp_path, "e.csv", b"")).columns == []
    assert files.load(spark, put(tmp_path, "m.csv", b"A;B\r1;2\r3;4")).table.count() == 2


def test_framed(spark, tmp_path):
    path = put(tmp_path, "r.txt", "Report\n--------\n|K  |Text |\n--------\n|1  |ä a  |\n|2  |x |y |\n|3  |     |\nlost line\n--------\n".encode("utf-8"))
    loaded = files.load(spark, path)
    assert loaded.widths == {"K": 3, "Text": 5} and sorted(tuple(r) for r in loaded.table.collect()) == [("1", "ä a"), ("3", "")] and sorted(r.reason for r in loaded.rejects.collect()) == ["cell_count", "unframed"]


def test_parquet_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, "b;c"), (1, None, None)], "k int, x double, t string")
    files.write_staged(df, str(tmp_path / "s"), ["k"])
    loaded = files.read_parquet(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in loaded.table.collect()) == [("1", None, None), ("2", "1.5", "b;c")]
    files.write_csv(df, str(tmp_path / "o.csv"), ["k"])
    assert (tmp_path / "o.csv").read_bytes() == b'\xef\xbb\xbfk;x;t\n1;;\n2;1.5;"b;c"\n'
    found = spark.createDataFrame([("R1", "a"), ("R2", "b")], "rule_id string, object_key string")
    files.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).filter("rule_id = 'R1'").count() == 1


def test_manifest_and_dates(tmp_path):
    path = put(tmp_path, "manifest.yaml", b"client: '100'\ndate: 2024-01-31\ntables: {mara: 12, marc: {rows: 3}}\n")
    manifest = files.read_manifest(path)
    assert manifest["tables"] == {"MARA": {"rows": 12}, "MARC": {"rows": 3}}
    assert files.extraction_date("x_20240131.csv") == ("2024-01-31", "file name") and files.extraction_date("x_31.01.2024.csv", configured="2023-01-01") == ("2023-01-01", "configuration")
    assert files.extraction_date("x", modified="2020-01-01") == ("2020-01-01", "file time") and files.extraction_date("x12345678901") == (None, "none")


def test_registry():
    assert header_normalise("Straße") == header_normalise("STRASSE") == header_normalise("strase") and header_normalise("Löschkennz.") == header_normalise("LOESCHKENNZ")
    mara = Table("MARA", {n: Field(n, aliases=a) for n, a in (("MANDT", ("Mandant",)), ("MATNR", ("Material",)), ("MTART", ()))}, ("MANDT", "MATNR"))
    marc = Table("MARC", {n: Field(n) for n in ("MANDT", "MATNR", "WERKS")}, ("MANDT", "MATNR", "WERKS"))
    registry = Registry([mara, marc])
    assert mara.map_headers(["mandant", "Material", "MATNR", "ZZ"]) == {"mandant": "MANDT", "Material": "MATNR", "MATNR": "MATNR_2", "ZZ": "ZZ"}
    assert registry.assign("x/mara_2024.csv", ["MANDT", "MATNR"]).method == "file name"
    assert registry.assign("mara.csv", ["MANDT", "MATNR", "WERKS"]).table == "MARA" and registry.assign("marc.csv", ["MANDT", "MATNR", "MTART"]) == registry.assign("x.csv", ["MANDT", "MATNR", "MTART"])
    assert registry.assign("x.csv", ["A"]).method == "unresolved" and registry.assign("x.csv", ["A"], {"x.csv": "MARC"}).table == "MARC"
    assert json.dumps(mara.signature_score(["MANDT"])) == "null"
