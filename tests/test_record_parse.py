import csv
import io

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stammwerk.operators import record_parse as rp

TEXT = st.text(alphabet='ab";\n ä', max_size=40)


def slow_states(classes):
    state, out = rp.START, []
    for c in classes:
        out.append(state)
        state = int(rp.STEP[c, state])
    return out


@given(st.lists(st.integers(0, 3), max_size=2000))
@settings(max_examples=60, deadline=None)
def test_chunked_states_equal_a_walk(classes):
    assert rp.run_states(np.array(classes, dtype=np.uint8)).tolist() == slow_states(classes)


@given(st.lists(st.lists(st.text(alphabet='xy";\n ', max_size=12), min_size=1, max_size=6), max_size=8))
@settings(max_examples=60, deadline=None)
def test_round_trip_of_quoted_cells(records):
    texts = [";".join('"' + c.replace('"', '""') + '"' for c in r) for r in records]
    tokens = rp.Tokens(pa.array(texts, pa.string()), pa.array([";"] * len(texts), pa.string()))
    assert tokens.cells().to_pylist() == records


def test_plain_cells_like_the_csv_module():
    texts = ["a;b;c", "", 'x "y" z;2', ";;", '"a;b";c']
    tokens = rp.Tokens(pa.array(texts), pa.array([";"] * len(texts)))
    expected = [next(csv.reader(io.StringIO(t), delimiter=";"), [""]) for t in texts]
    assert tokens.cells().to_pylist() == expected


def test_fits():
    good = [("numc", "0012"), ("flag", "X"), ("flag", "0"), ("dats", "20240229"), ("dats", "29.02.2024"), ("dats", "2024-02-29"), ("dats", "00000000"), ("quan", "1.234,56-"), ("curr", "-1,234.5"), ("dec", "12"), ("quan", "1.234.567"), ("char", "anything")]
    bad = [("numc", "12a"), ("numc", "²"), ("flag", "x"), ("flag", "XX"), ("dats", "20230229"), ("dats", "2024-2-9"), ("dats", "31.04.2024"), ("quan", "1,23.456,7"), ("quan", "-1-"), ("curr", "k.A."), ("dec", ""), ("dec", "1 2")]
    assert [x for x in good if not rp.fits(*x)] == [] and [x for x in bad if rp.fits(*x)] == []


def test_parse_reasons_and_odd_input(spark):
    long = "y" * 300_000
    data = [
        (1, "1;20240101;x", ";", ["numc", "dats", "char"]), (2, '1;"never', ";", ["numc", "dats", "char"]), (3, '"1"x;2;3', ";", ["numc", "dats", "char"]), (4, "1;2", ";", ["numc", "dats", "char"]),
        (5, "1;20240230;x", ";", ["numc", "dats", "char"]), (6, None, ";", ["numc"]), (7, "", ";", ["numc"]), (8, f"1;;{long}", ";", ["numc", "dats", "char"]), (9, "a;b", None, None), (10, '1;"a;""b"" ";z', ";", ["numc", "char", "char"]), (1, "1;20240101;x", ";", ["numc", "dats", "char"]),
    ]
    df = spark.createDataFrame(data, "reason_id int, raw_text string, delimiter string, types array<string>").repartition(3)
    got = {r.reason_id: (r.reason, r.error_at, r.column_no) for r in rp.parse(df).collect()}
    assert got == {1: (None, None, None), 2: ("unclosed_quote", 8, None), 3: ("text_after_quote", 3, None), 4: ("cell_count", 3, None), 5: ("type", 2, 1), 8: (None, None, None), 9: (None, None, None), 10: (None, None, None)}
    cells = {r.reason_id: r.cells for r in rp.parse(df).collect()}
    assert cells[10] == ["1", 'a;"b" ', "z"] and cells[8][2] == long and cells[9] == ["a;b"]
    assert {r.reason_id for r in rp.parse(df, only_failing=True, with_cells=False).collect()} == {2, 3, 4, 5}
    assert rp.parse(df.limit(0)).count() == 0


def test_headers(spark):
    records = spark.createDataFrame([(1, 1, "﻿Mandant\tLöschvormerkung\tZZ X"), (1, 2, "1\tX\t"), (2, 1, '"MANDT";MANDT')], "file_id long, record_no int, raw_text string")
    files = spark.createDataFrame([(1, "A", "mara", None, None), (2, "B", "MARA", None, ";")], "file_id long, system_id string, table_name string, extraction_date date, delimiter string")
    registry = spark.createDataFrame([("MARA", "MANDT", "numc", 1, ["Mandant"]), ("MARA", "LVORM", "flag", None, ["Löschvormerkung"])], "table_name string, field_name string, field_type string, key_position int, aliases array<string>")
    columns = rp.file_headers(records, files, registry)
    assert sorted((r.file_id, r.pos, r.name, r.field_name, r.field_type) for r in columns.collect()) == [(1, 0, "MANDANT", "MANDT", "numc"), (1, 1, "LOESCHVORMERKUNG", "LVORM", "flag"), (1, 2, "ZZX", None, "char"), (2, 0, "MANDT", "MANDT", "numc"), (2, 1, "MANDT", "MANDT", "numc")]
    heads = {r.file_id: (r.delimiter, r.types, r.key_columns) for r in rp.headers_by_file(columns).collect()}
    assert heads == {1: ("\t", ["numc", "flag", "char"], [0]), 2: (";", ["numc", "numc"], [0, 1])}
