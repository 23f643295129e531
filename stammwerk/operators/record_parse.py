"""Delimited records: a quote-aware finite-state tokenizer that works on whole batches, and the checks of their cells.

The bytes of all records of a batch form one tape, with a virtual end mark after each record. The tape is cut into chunks;
every chunk is run from all states at once (one vector step per byte offset, over all chunks), which gives each chunk's
transition function; composing these in order gives the state in which every chunk really starts, and so the state at every
byte, without walking the tape byte by byte. Records longer than a chunk need no special case.

A record fails for the first of these reasons: a quote never closed (`unclosed_quote`), text between a closing quote and the
delimiter (`text_after_quote`), another number of cells than the header (`cell_count`), a cell that does not fit its type
(`type`). `error_at` is the byte offset in the record (for `cell_count` the record's length), `column_no` the cell, from 0.

Null and empty texts are no records and give no row. Without a header (`types` null) only the quotes are checked. Very long
texts pass whole. Empty tables give no rows. Columns of the input other than those named are carried along.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, PLAIN, QUOTED, CLOSING, BROKEN = range(5)
OTHER, QUOTE, DELIMITER, END = range(4)
#: Next state by byte class (row) and state (column).
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [QUOTED, PLAIN, CLOSING, QUOTED, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
CHUNK = 256
REASONS = ["unclosed_quote", "text_after_quote", "cell_count", "type"]


def run_states(classes: np.ndarray) -> np.ndarray:
    """The state before each position of the tape."""
    n = len(classes)
    n_chunks = max(1, -(-n // CHUNK))
    tape = np.full(n_chunks * CHUNK, OTHER, dtype=np.uint8)
    tape[:n] = classes
    tape = np.ascontiguousarray(tape.reshape(n_chunks, CHUNK).T)
    table = STEP.ravel()
    state = np.broadcast_to(np.arange(5, dtype=np.uint8), (n_chunks, 5)).copy()
    seen = np.empty((CHUNK, n_chunks, 5), dtype=np.uint8)
    for i in range(CHUNK):
        seen[i] = state
        state = table[tape[i][:, None] * np.uint8(5) + state]
    starts = np.empty(n_chunks, dtype=np.intp)
    current = 0
    for k, row in enumerate(state.tolist()):
        starts[k] = current
        current = row[current]
    return np.take_along_axis(seen, starts[None, :, None], axis=2)[:, :, 0].T.ravel()[:n]


_NUMBER = r"(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]*)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?)"
NUMBER = re.compile(rf"[+-]?{_NUMBER}|{_NUMBER}[+-]")
DATE = re.compile(r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})|(?P<d2>[0-9]{2})\.(?P<m2>[0-9]{2})\.(?P<y2>[0-9]{4})|(?P<y3>[0-9]{4})-(?P<m3>[0-9]{2})-(?P<d3>[0-9]{2})")


def _is_date(text: str) -> bool:
    if text == "00000000":
        return True
    m = DATE.fullmatch(text)
    if not m:
        return False
    g = m.groupdict()
    year, month, day = (int(g[k] or g[k + "2"] or g[k + "3"]) for k in ("y", "m", "d"))
    try:
        dt.date(year, month, day)
    except ValueError:
        return False
    return True


def fits(kind: str, text: str) -> bool:
    """Whether a filled cell, without blanks around it, fits a registry type; types not named here take anything."""
    if kind == "numc":
        return text.isascii() and text.isdigit()
    if kind == "flag":
        return text in ("X", "0", "1")
    if kind == "dats":
        return _is_date(text)
    if kind in ("quan", "curr", "dec"):
        return NUMBER.fullmatch(text) is not None
    return True


#: One letter per registry type, as the tokenizer gets them: a string per header instead of a list.
CODES = {"numc": "n", "flag": "f", "dats": "d", "quan": "q", "curr": "q", "dec": "q"}
_KINDS = {ord("n"): "numc", ord("f"): "flag", ord("d"): "dats", ord("q"): "quan"}
_SHAPES = {ord("n"): "^[0-9]+$", ord("f"): "^[X01]$", ord("q"): f"^(?:[+-]?{_NUMBER}|{_NUMBER}[+-])$"}  # dates are judged one by one


def type_codes(types: Column) -> Column:
    """The letters of a header's types; c for types that take anything; null stays null."""
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.array_join(F.transform(types, lambda t: F.coalesce(F.try_element_at(known, t), F.lit("c"))), "")


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a text column; nulls are empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Tokens:
    """The cells of a batch of records as positions on the tape."""

    def __init__(self, texts: pa.Array, delimiters: pa.Array):
        n = len(texts)
        raw, offsets = _buffer(texts)
        lengths = np.diff(offsets)
        mark_bytes, mark_offsets = _buffer(delimiters)
        marks = np.zeros(n, dtype=np.uint8)
        given = np.diff(mark_offsets) > 0
        marks[given] = mark_bytes[mark_offsets[:-1][given]]
        ends = np.cumsum(lengths + 1) - 1  # of the end marks on the tape
        self.starts, self.ends = ends - lengths, ends
        self.tape = np.zeros(len(raw) + n, dtype=np.uint8)
        inner = np.ones(len(self.tape), dtype=bool)
        inner[ends] = False
        self.tape[inner] = raw
        classes = np.zeros(len(self.tape), dtype=np.uint8)
        quote = raw == ord('"')
        classes[inner] = np.where(quote, QUOTE, np.where((raw == np.repeat(marks, lengths)) & (raw != 0), DELIMITER, OTHER))
        classes[ends] = END
        # a record without a quote is at the start of a cell after each delimiter and inside one elsewhere; the others walk through the automaton
        self.states = np.full(len(classes), PLAIN, dtype=np.uint8)
        self.states[:1] = START
        self.states[1:][classes[:-1] >= DELIMITER] = START
        quoted = np.zeros(n, dtype=bool)
        quoted[np.searchsorted(offsets, np.flatnonzero(quote), "right") - 1] = True
        if quoted.any():
            walked = np.repeat(quoted, lengths + 1)
            self.states[walked] = run_states(classes[walked])
        cut = (classes == END) | ((classes == DELIMITER) & (self.states != QUOTED) & (self.states != BROKEN))
        self.cell_end = np.flatnonzero(cut)
        self.cell_start = np.concatenate([[0], self.cell_end[:-1] + 1]) if len(self.cell_end) else self.cell_end
        self.record = np.searchsorted(self.ends, self.cell_end)
        self.first_cell = np.searchsorted(self.record, np.arange(n + 1))
        self.n_cells = np.diff(self.first_cell)
        self.last_state = self.states[self.ends] if n else np.zeros(0, np.uint8)
        # opening and closing quotes and the first of two doubled ones are no text
        text = ~(cut | ((classes == QUOTE) & ((self.states == START) | (self.states == QUOTED))))
        upto = np.concatenate([[0], np.cumsum(text)])
        places = np.concatenate([upto[self.cell_start], upto[-1:]]).astype(np.int32)
        self.values = pa.StringArray.from_buffers(len(self.cell_end), pa.py_buffer(places), pa.py_buffer(self.tape[text]))

    def cells(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.first_cell.astype(np.int32)), self.values)

    def broken_at(self, record: int) -> int:
        """Offset of the first text after a closing quote."""
        inside = self.states[self.starts[record] : self.ends[record] + 1]
        return int(np.argmax(inside == BROKEN)) - 1


def _misfits(values: pa.Array, kinds: np.ndarray) -> np.ndarray:
    """Which cells do not fit their kinds; every distinct value is judged once."""
    wrong = np.zeros(len(kinds), dtype=bool)
    for kind in np.unique(kinds).tolist():
        if kind not in _KINDS:
            continue
        at = np.flatnonzero(kinds == kind)
        coded = pc.utf8_trim_whitespace(values.take(pa.array(at))).dictionary_encode()
        if kind in _SHAPES:
            good = pc.match_substring_regex(coded.dictionary, _SHAPES[kind]).to_numpy(zero_copy_only=False)
        else:
            good = np.array([fits(_KINDS[kind], v) for v in coded.dictionary.to_pylist()], dtype=bool)
        empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
        wrong[at] = ~(good | empty)[coded.indices.to_numpy(zero_copy_only=False)]
    return wrong


def _check(tokens: Tokens, types: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(reason, error_at, column_no) of every record; types are letters, one per cell, or null."""
    n = len(types)
    letters, offsets = _buffer(types)
    expected = np.where(types.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    lengths = tokens.ends - tokens.starts
    reason, at, column = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    open_quote, broken = tokens.last_state == QUOTED, tokens.last_state == BROKEN
    reason[open_quote], at[open_quote] = 0, lengths[open_quote]
    for i in np.flatnonzero(broken):
        reason[i], at[i] = 1, tokens.broken_at(i)
    whole = ~(open_quote | broken)
    other = whole & (expected >= 0) & (tokens.n_cells != expected)
    reason[other], at[other] = 2, lengths[other]
    good = np.flatnonzero(whole & (tokens.n_cells == expected))
    sizes = tokens.n_cells[good]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cells = np.repeat(tokens.first_cell[:-1][good], sizes) + inner
    kinds = letters[np.repeat(offsets[:-1][good], sizes) + inner]
    typed = kinds != ord("c")
    cells, kinds = cells[typed], kinds[typed]
    wrong = cells[_misfits(tokens.values.take(pa.array(cells)), kinds)]
    records, first = np.unique(tokens.record[wrong], return_index=True)
    wrong = wrong[first]
    reason[records], at[records], column[records] = 3, tokens.cell_start[wrong] - tokens.starts[records], wrong - tokens.first_cell[records]
    fine = reason < 0
    names = pa.array(REASONS).take(pa.array(reason, mask=fine))
    return names, pa.array(at, mask=fine), pa.array(column, mask=column < 0)


def parse(df: DataFrame, text: str = "raw_text", delimiter: str = "delimiter", types: str = "types", with_cells: bool = True, only_failing: bool = False) -> DataFrame:
    """df without text, delimiter and types, plus reason (null where the record is valid), error_at, column_no and, on request, cells.

    types is an array of registry types, or their letters as from type_codes."""
    if isinstance(df.schema[types].dataType, T.ArrayType):
        df = df.withColumn(types, type_codes(F.col(types)))
    kept = [f for f in df.schema.fields if f.name not in (text, delimiter, types)]
    added = [T.StructField("reason", T.StringType()), T.StructField("error_at", T.IntegerType()), T.StructField("column_no", T.IntegerType())]
    if with_cells:
        added.append(T.StructField("cells", T.ArrayType(T.StringType())))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                tokens = Tokens(part.column(text), part.column(delimiter))
                out = [*(part.column(name) for name in names), *_check(tokens, part.column(types))]
                if with_cells:
                    out.append(tokens.cells())
                made = pa.RecordBatch.from_arrays(out, names=[*names, *(f.name for f in added)])
                yield made.filter(pc.is_valid(made.column("reason"))) if only_failing else made

    return df.filter(f"`{text}` <> ''").mapInArrow(run, T.StructType([*kept, *added]))


def header_name(column: Column) -> Column:
    """Upper case, umlauts and sharp s spelled out, then only A-Z and 0-9."""
    text = F.upper(column)
    for umlaut, spelled in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "SS"), ("ẞ", "SS")):
        text = F.replace(text, F.lit(umlaut), F.lit(spelled))
    return F.regexp_replace(text, "[^A-Z0-9]", "")


def guess_delimiter(header: Column, declared: Column) -> Column:
    """The declared delimiter, unless it is missing or not in the header: then the most frequent candidate outside quotes."""
    bare = F.regexp_replace(header, '"[^"]*"', "")
    best = F.array_max(F.array(*(F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))).alias("n"), F.lit(rank).alias("rank"), F.lit(mark).alias("mark")) for rank, mark in ((4, ";"), (3, "\t"), (2, "|"), (1, ",")))))
    usable = declared.isNotNull() & (declared != "") & F.contains(header, declared)
    return F.when(usable, declared).otherwise(F.when(best["n"] > 0, best["mark"]).otherwise(F.coalesce(F.when(declared != "", declared), F.lit(";"))))


def registry_names(registry: DataFrame) -> DataFrame:
    """(table_name, name, field_name, field_type, key_position): one row per name or alias, names normalised."""
    names = F.explode(F.concat(F.array("field_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = registry.select(F.upper("table_name").alias("table_name"), names.alias("_n"), "field_name", "field_type", "key_position")
    return rows.select("table_name", header_name(F.col("_n")).alias("name"), "field_name", "field_type", "key_position").groupBy("table_name", "name").agg(F.min("field_name").alias("field_name"), F.min("field_type").alias("field_type"), F.min("key_position").alias("key_position"))


def file_headers(records: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per column of each file: file_id, system_id, table_name, extraction_date, delimiter, pos, header, name,
    field_name (of the file's own table), field_type (of its table, else of any), key_position."""
    first = records.filter("record_no = 1").groupBy("file_id").agg(F.min("raw_text").alias("raw_text"))
    info = files.groupBy("file_id").agg(F.min(F.struct("system_id", F.upper(F.trim("table_name")).alias("table_name"), "extraction_date", "delimiter")).alias("_f")).select("file_id", "_f.*")
    joined = first.join(info, "file_id", "left").withColumn("raw_text", F.regexp_replace("raw_text", "^﻿", ""))
    joined = joined.withColumn("mark", guess_delimiter(F.col("raw_text"), F.col("delimiter"))).drop("delimiter")
    cells = parse(joined.withColumn("delimiter", F.col("mark")).withColumn("types", F.lit(None).cast("array<string>")))
    columns = cells.select("file_id", "system_id", "table_name", "extraction_date", F.col("mark").alias("delimiter"), F.posexplode("cells").alias("pos", "header")).withColumn("header", F.trim("header")).withColumn("name", header_name(F.col("header")))
    names = registry_names(registry)
    own = names.select("table_name", "name", "field_name", F.col("field_type").alias("_own"), "key_position")
    other = names.groupBy("name").agg(F.min("field_type").alias("_any"))
    return columns.join(own, ["table_name", "name"], "left").join(other, "name", "left").withColumn("field_type", F.coalesce("_own", "_any", F.lit("char"))).drop("_own", "_any")


def headers_by_file(columns: DataFrame) -> DataFrame:
    """One row per file: delimiter, types, their letters (codes), names, and key_columns (positions in key order)."""
    one = F.array_sort(F.collect_list(F.struct("pos", "name", "field_type", "key_position")))
    return columns.groupBy("file_id", "delimiter").agg(one.alias("_c")).select(
        "file_id", "delimiter",
        F.transform("_c", lambda c: c["field_type"]).alias("types"),
        type_codes(F.transform("_c", lambda c: c["field_type"])).alias("codes"),
        F.transform("_c", lambda c: c["name"]).alias("names"),
        F.transform(F.array_sort(F.transform(F.filter("_c", lambda c: c["key_position"].isNotNull()), lambda c: F.struct(c["key_position"].alias("k"), c["pos"].alias("p")))), lambda c: c["p"]).alias("key_columns"),
    )
