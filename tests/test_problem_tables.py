"""The parser and the drift queries against plain loops over the smallest provided tables."""

import os
import re
from collections import Counter, defaultdict
from datetime import datetime

import duckdb
import pytest

from stammwerk.plans import problems

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the provided tables are not here")


def plain(header):
    text = header.upper()
    for a, b in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "SS"), ("ẞ", "SS")):
        text = text.replace(a, b)
    return re.sub("[^A-Z0-9]", "", text)


def cells_of(text, mark):
    """Cells, or None for a broken quote."""
    cells, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            end, cell = at + 1, ""
            while True:
                if end >= len(text):
                    return None
                if text[end] != '"':
                    cell += text[end]
                elif text[end + 1 : end + 2] == '"':
                    cell, end = cell + '"', end + 1
                else:
                    break
                end += 1
            end += 1
            if end < len(text) and text[end] != mark:
                return None
        else:
            end = text.find(mark, at)
            end = len(text) if end < 0 else end
            cell = text[at:end]
        cells.append(cell)
        if end >= len(text):
            return cells
        at = end + 1


BODY = r"(?:\d+[.,]?\d*|[.,]\d+|\d{1,3}(?:\.\d{3})+(?:,\d*)?|\d{1,3}(?:,\d{3})+(?:\.\d*)?)"


def is_number(v):
    return bool(re.fullmatch(rf"[+-]?{BODY}|{BODY}[+-]", v, re.ASCII))


def fits(kind, v):
    if kind == "numc":
        return bool(re.fullmatch("[0-9]+", v))
    if kind == "flag":
        return v in ("X", "0", "1")
    if kind == "dats":
        for shape, layout in (("[0-9]{8}", "%Y%m%d"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "%d.%m.%Y"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d")):
            if re.fullmatch(shape, v):
                try:
                    return bool(datetime.strptime(v, layout))
                except ValueError:
                    return v == "00000000"
        return False
    return is_number(v) if kind in ("quan", "curr", "dec") else True


@pytest.fixture(scope="module")
def world():
    con = duckdb.connect()
    read = lambda what, name: con.execute(f"SELECT {what} FROM '{ROOT}/{name}.parquet'").fetchall()
    registry = read("upper(table_name), field_name, field_type, key_position, aliases", "registry_field")
    kinds, field, keys = {}, {}, {}
    for table, name, kind, position, aliases in registry:
        for alias in [name, *(aliases or [])]:
            kinds[plain(alias)] = kind
            field[table, plain(alias)] = name
        if position is not None:
            keys[table, name] = position
    files = {f: (s, d, f, t, m) for f, s, d, t, m in read("file_id, system_id, extraction_date, upper(table_name), delimiter", "source_file")}
    records = read("file_id, record_no, raw_text", "raw_records")
    heads, good, bad = {}, defaultdict(list), set()
    for f, n, text in records:
        if n == 1:
            text = text.lstrip("﻿")
            mark = files[f][4] or max(";\t|,", key=text.count)
            heads[f] = (mark, [plain(c) for c in cells_of(text, mark)])
    for f, n, text in records:
        if n > 1 and text:
            mark, names = heads[f]
            cells = cells_of(text, mark)
            if cells is None or len(cells) != len(names) or any(c.strip() and not fits(kinds.get(h), c.strip()) for h, c in zip(names, cells, strict=True)):
                bad.add((f, n))
            else:
                good[f].append([c.strip() for c in cells])
    return files, heads, good, bad, field, keys


def test_p2(spark, world):
    assert {tuple(r) for r in problems.p2_found(spark, ROOT).collect()} == world[3]
    assert {(r.file_id, r.rejected_rows) for r in problems.p2_files(spark, ROOT).collect() if r.rejected_rows} == set(Counter(f for f, _ in world[3]).items())


def form(values):
    values = [v for v in values if v]
    kinds = Counter("digits" if re.fullmatch("[0-9]+", v) else "date" if re.fullmatch(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}", v) else "number" if is_number(v) and re.search("[.,]", v) else "text" for v in values)
    return next((k for k, n in kinds.items() if 2 * n > len(values)), "text") if values else None


def test_p3(spark, world):
    files, heads, good, _, field, keys = world
    expected = set()
    series = sorted(files[f] for f in heads)
    for before, now in zip(series, series[1:], strict=False):
        if before[0] != now[0]:
            continue
        (p, f), table = (before[2], now[2]), now[3]
        old, new = heads[p][1], heads[f][1]

        def by_key(which, names, table=table):
            at = [i for _, i in sorted((keys[table, field[table, h]], i) for i, h in enumerate(names) if (table, field.get((table, h))) in keys)]
            return {tuple(r[i] for i in at): r for r in good[which]} if at else {}

        left, right = by_key(p, old), by_key(f, new)
        scored = []
        for a in set(old) - set(new):
            for b in set(new) - set(old):
                both = [(left[k][old.index(a)], right[k][new.index(b)]) for k in left.keys() & right.keys()]
                filled = [x for x in both if all(x)]
                equal = sum(x == y for x, y in filled)
                if field.get((table, a), 0) == field.get((table, b), 1):
                    scored.append((10, a, b))
                elif 2 * equal > len(filled):
                    scored.append((equal / len(filled), a, b))
        renamed = {}
        for _, a, b in sorted(scored, reverse=True):
            if a not in renamed and b not in renamed.values():
                renamed[a] = b
        expected |= {(f, renamed.get(a, a), "renamed" if a in renamed else "removed") for a in set(old) - set(new)}
        expected |= {(f, b, "added") for b in set(new) - set(old) - set(renamed.values())}
        for a, b in [*renamed.items(), *((x, x) for x in set(old) & set(new))]:
            x, y = form([r[old.index(a)] for r in good[p]]), form([r[new.index(b)] for r in good[f]])
            if x and y and x != y:
                expected.add((f, b, "retyped"))
    assert {tuple(r) for r in problems.p3_found(spark, ROOT).collect()} == expected and expected


def test_unified(spark, world):
    files, heads, good, *_ = world
    rows = problems.p3_unified(spark, ROOT).collect()
    assert len(rows) == sum(map(len, good.values())) and {r.table_name for r in rows} == {files[f][3] for f in heads if good[f]}
    assert all("MANDT" in r.fields for r in rows)
