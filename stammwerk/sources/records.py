"""Records of delimited files, read by byte ranges however many lines a quoted cell runs over.

A file is read as lines, range by range. Whether a line begins a record or goes on inside a quoted cell depends on all quotes before it, so every
range first gives its transition function: whether it ends inside quotes if it starts outside, and if it starts inside, and whether a record begins
in it. These few bits per range are composed in the order of the file; then every range is read again with the state in which it really
starts, and gives its records. A record that crosses ranges is put together from its parts.

Lines without a quote keep the state they find, so only lines with one go through the automaton of `record_parse`. A quote that is never closed makes one
record of the rest of its file, as the rule of quotes has it. Empty files give no records; null lines do not occur."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stammwerk.operators.record_parse import QUOTED, Tokens


def _ends(lines: pa.Array, delimiter: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, outside, inside) of the lines with a quote: whether each ends inside quotes if it starts outside, or inside."""
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    quoted = lines.take(pa.array(at))
    marks = pa.array([delimiter] * len(at), pa.string())
    outside = Tokens(quoted, marks).last_state == QUOTED
    inside = Tokens(pc.binary_join_element_wise(pa.scalar('"'), quoted, ""), marks).last_state == QUOTED
    return at, outside, inside


def _after(state: bool, n: int, at: np.ndarray, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The state after each of n lines."""
    out = np.empty(n, dtype=bool)
    done = 0
    for k, o, i in zip(at.tolist(), outside.tolist(), inside.tolist(), strict=True):
        out[done:k] = state
        state = i if state else o
        out[k] = state
        done = k + 1
    out[done:] = state
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start of the range, lines) in order, a range possibly in several pieces."""
    for batch in batches:
        files, starts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (starts[1:] != starts[:-1]), True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b > a:
                yield int(files[a]), int(starts[a]), batch.column(2).slice(a, b - a)


def _transitions(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, outside, inside, begins): per range and piece; begins tells whether a record begins there if it starts inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for file, start, part in _runs(batches):
            if now != (file, start):
                now = (file, start)
                found.append([file, start, False, True, False])
            at, outside, inside = _ends(part, delimiter)
            last = found[-1]
            if len(part):
                both = [_after(last[2 + k], len(part), at, outside, inside) for k in (0, 1)]
                last[4] = last[4] or not last[3] or bool((~both[1][:-1]).any())
                last[2], last[3] = bool(both[0][-1]), bool(both[1][-1])
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], names=["file", "start", "outside", "inside", "begins"])

    return lines.mapInArrow(run, "file long, start long, outside boolean, inside boolean, begins boolean")


def _compose(ranges: list) -> dict[tuple[int, int], int]:
    """(file, start) -> start of the range in which the record began that is open there; ranges that start outside quotes are missing."""
    owner: dict[tuple[int, int], int] = {}
    file, state, opened = None, False, 0
    for r in sorted(ranges, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, state = r.file, False
        if state:
            owner[r.file, r.start] = opened
            opened = r.start if r.begins else opened
            state = r.inside
        else:
            opened, state = r.start, r.outside
    return owner


def read_records(spark: SparkSession, path: str, delimiter: str, line_end: str = "\n") -> DataFrame:
    """(file, start, no, raw_text): the records of a file or of all files of a folder; the first one of a file has start 0 and no 0."""
    lines = spark.read.text(path, lineSep=line_end).select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"), "value")
    owner = _compose(_transitions(lines, delimiter).collect())  # a few bits for each range of a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, pending, number, began = None, False, [], 0, None
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "start", "no", "owner", "raw_text"])
            out.clear()
            return made

        for file, start, part in _runs(batches):
            if now != (file, start):
                if pending:  # the record goes on in the next range
                    out.append((*now, number, now[1] if began is None else began, line_end.join(pending)))
                now, number, pending = (file, start), 0, []
                began = owner.get(now)
                state = began is not None
            texts = part.to_pylist()
            after = _after(state, len(texts), *_ends(part, delimiter))
            state = bool(after[-1])
            low = 0
            for high in np.flatnonzero(~after).tolist():
                text = texts[low] if not pending and high == low else line_end.join([*pending, *texts[low : high + 1]])
                out.append((*now, number, began, text))
                pending, began, number, low = [], None, number + 1, high + 1
            pending += texts[low:]
            if len(out) >= 5000:
                yield given()
        if pending:
            out.append((*now, number, now[1] if began is None else began, line_end.join(pending)))
        yield given()

    parts = lines.mapInArrow(run, "file long, start long, no long, owner long, raw_text string")
    whole = parts.filter("owner IS NULL").select("file", "start", "no", "raw_text")
    # of a record that crosses ranges, the last part is given by its range as the others are: with the range where the record began
    crossing = parts.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "no", "raw_text"))).alias("_p"))
    joined = crossing.select("file", F.col("owner").alias("start"), F.col("_p")[0]["no"].alias("no"), F.array_join(F.transform("_p", lambda p: p["raw_text"]), line_end).alias("raw_text"))
    text = F.regexp_replace("raw_text", r"\r\z", "")
    return whole.unionByName(joined).withColumn("raw_text", F.when((F.col("start") == 0) & (F.col("no") == 0), F.regexp_replace(text, "^﻿", "")).otherwise(text))
