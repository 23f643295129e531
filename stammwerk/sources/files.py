"""Files of a delivery: listing, detection of format, encoding and delimiter, readers to all-text tables, and sinks.

Format and delimiter are judged by the first lines; the encoding and the hash by the whole file, in one pass in pieces. Contents are read by Spark. Blank header cells become column_N, repeated ones get a suffix."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stammwerk.functions.convert import typed_to_text
from stammwerk.operators import record_parse
from stammwerk.session import Scratch, _delete, _place, scratch_root
from stammwerk.sources import records

SUFFIXES = {".csv", ".txt", ".tsv", ".dat", ".parquet", ".xlsx"}
DELIMITERS = [";", "\t", "|", ","]
PROBE = 1 << 20


@dataclass(frozen=True)
class FormatInfo:
    kind: str  # csv, framed, parquet or xlsx
    encoding: str = "utf-8"
    delimiter: str = ";"


@dataclass
class Loaded:
    """All-text table of a file and what was set apart while reading it."""

    table: DataFrame
    columns: list[str]
    rejects: DataFrame | None = None
    #: One row: n_rows, n_rejected, n_distinct_rejected; computed in one pass when it is asked for.
    totals: DataFrame | None = None
    widths: dict[str, int] = field(default_factory=dict)


def scan_files(root: str | Path, ignore: list[str] = ()) -> list[Path]:
    """Files with a known suffix, sorted; no dot files, none that matches an ignore pattern."""
    found = (p for p in Path(root).rglob("*") if p.is_file() and p.suffix.lower() in SUFFIXES and not any(part.startswith(".") for part in p.relative_to(root).parts))
    return sorted(p for p in found if not any(fnmatch(p.name, g) or fnmatch(str(p.relative_to(root)), g) for g in ignore))


def _pieces(path: str | Path) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(PROBE):
            yield piece


@dataclass(frozen=True)
class Probe:
    """What one pass over the bytes of a file tells."""

    size: int
    sha256: str
    encoding: str
    ends_open: bool  # the last line has no end


def probe(path: str | Path) -> Probe:
    digest, size, last = hashlib.sha256(), 0, b""

    def pieces() -> Iterator[bytes]:
        nonlocal size, last
        for piece in _pieces(path):
            digest.update(piece)
            size, last = size + len(piece), (last + piece)[-2:]
            yield piece

    left = pieces()
    encoding = detect_encoding(left)
    for _ in left:  # what the detection did not need
        pass
    return Probe(size, digest.hexdigest(), encoding, bool(size) and last not in (b"\n\0", b"\0\n") and last[-1:] not in (b"\n", b"\r"))


def probe_files(spark: SparkSession, paths: list[Path]) -> dict[str, Probe]:
    """A probe of every file, read by the tasks; the folder of the delivery must be reachable for all of them, as the scratch folder is."""
    if not paths:
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [probe(path) for path in part.path]
            yield pd.DataFrame({"path": part.path, **{f: [getattr(p, f) for p in found] for f in ("size", "sha256", "encoding", "ends_open")}})

    # by size, so that a few large files do not sit in one task
    spread = spark.createDataFrame([(str(p),) for p in sorted(paths, key=lambda p: -p.stat().st_size)], "path string").repartition(min(len(paths), 512))
    rows = spread.mapInPandas(run, "path string, size long, sha256 string, encoding string, ends_open boolean").collect()  # a row for each file
    return {r.path: Probe(r["size"], r.sha256, r.encoding, r.ends_open) for r in rows}


def file_hash(path: str | Path) -> str:
    digest = hashlib.sha256()
    for piece in _pieces(path):
        digest.update(piece)
    return digest.hexdigest()


def detect_encoding(pieces: bytes | Iterable[bytes]) -> str:
    """A byte order mark, then many zero bytes (UTF-16), then valid UTF-8, else cp1252, or latin-1 where bytes are undefined in it.

    The first piece tells marks and zero bytes; UTF-8 and cp1252 must hold to the last byte, so a late byte of another encoding counts."""
    pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
    head = next(pieces, b"")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark) and name != "utf-8-sig":
            return name
    marked = head.startswith(b"\xef\xbb\xbf")
    if head and head.count(0) > len(head) * 0.2:
        return "utf-16-le" if head[1::2].count(0) >= head[::2].count(0) else "utf-16-be"
    able = {"utf-8": codecs.getincrementaldecoder("utf-8")("strict"), "cp1252": codecs.getincrementaldecoder("cp1252")("strict")}
    for piece in itertools.chain([head], pieces, [None]):
        for name in list(able):
            try:
                able[name].decode(piece or b"", final=piece is None)
            except UnicodeDecodeError:
                del able[name]
    return ("utf-8-sig" if marked else "utf-8") if "utf-8" in able else "cp1252" if "cp1252" in able else "latin-1"


def detect_delimiter(lines: list[str]) -> str:
    """The candidate that is frequent and even: mean / (1 + variance) of its counts over the first 200 lines."""
    best, score = DELIMITERS[0], 0.0
    for mark in DELIMITERS:
        counts = [line.count(mark) for line in lines[:200] if line.strip()]
        if counts:
            mean = sum(counts) / len(counts)
            value = mean / (1 + sum((c - mean) ** 2 for c in counts) / len(counts))
            if value > score:
                best, score = mark, value
    return best


_RULER = re.compile(r"^[|+]?[-=+]{3,}[|+]?$")


def is_framed(lines: list[str]) -> bool:
    """A report drawn with pipes: at least one ruler and two framed lines among the first 60."""
    head = [line.strip() for line in lines[:60]]
    return any(_RULER.match(x) for x in head) and sum(x.startswith("|") and x.endswith("|") and not _RULER.match(x) for x in head) >= 2


def detect_format(path: str | Path, encoding: str | None = None) -> FormatInfo:
    """encoding: what a probe found; without it the file is read for it."""
    suffix = Path(path).suffix.lower()
    if suffix == ".parquet":
        return FormatInfo("parquet")
    if suffix == ".xlsx":
        return FormatInfo("xlsx")
    encoding = encoding or detect_encoding(_pieces(path))
    with open(path, encoding=encoding, errors="replace", newline="") as f:
        lines = f.read(PROBE).splitlines()
    return FormatInfo("framed", encoding) if is_framed(lines) else FormatInfo("csv", encoding, detect_delimiter(lines))


def clean_header(cells: list[str]) -> list[str]:
    names: list[str] = []
    for i, cell in enumerate(cells, 1):
        name = cell.strip().lstrip("﻿") or f"column_{i}"
        taken, k = name, 2
        while taken in names:
            taken, k = f"{name}_{k}", k + 1
        names.append(taken)
    return names


def transcode(spark: SparkSession, path: str, encoding: str) -> str:
    """The path of a UTF-8 copy in the shared scratch folder, written in pieces of 4 MB; UTF-8 files stay where they are.

    Bytes that the encoding does not know stop the file with an error rather than change it; only UTF-16 can have some, as the others were
    read to their end."""
    if encoding in ("utf-8", "utf-8-sig"):
        return path
    target = f"{scratch_root(spark)}/utf8-{uuid.uuid4().hex[:12]}-{Path(path).name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(target)  # any file system that Spark can reach
    copy = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        with open(path, encoding=encoding, newline="") as source:
            while piece := source.read(1 << 22):
                copy.write(bytearray(piece.encode("utf-8")))
    except UnicodeDecodeError as problem:
        raise ValueError(f"{Path(path).name}: bytes that are not {encoding}: {problem.reason}") from problem
    finally:
        copy.close()
    return target


def read_csv(spark: SparkSession, path: str, info: FormatInfo, short_rows: str = "pad") -> Loaded:
    """All cells as text. Quoted cells may hold line breaks; short rows are padded, long ones and broken quotes set apart with the reason.

    The file is read by byte ranges (`records.read_records`) and its records go through the tokenizer, so a large file is many tasks. Blank lines are no rows."""
    with open(path, encoding=info.encoding, newline="", errors="replace") as f:
        head = f.read(PROBE)
        header = clean_header(next(csv.reader(io.StringIO(head.lstrip("\ufeff"), newline=""), delimiter=info.delimiter), []))
    line_end = "\r" if "\r" in head and "\n" not in head else "\n"
    found = records.read_records(spark, transcode(spark, str(path), info.encoding), info.delimiter, line_end).filter("(start <> 0 OR no <> 0) AND raw_text <> ''")
    asked = found.select(F.col("raw_text").alias("raw"), "raw_text", F.lit(info.delimiter).alias("delimiter"), F.lit(None).cast("string").alias("types"))
    parsed = Scratch(spark, "csv").write(record_parse.parse(asked))  # rows and rejects come from one parse
    fits = F.col("reason").isNull() & (F.size("cells") == len(header) if short_rows != "pad" else F.size("cells") <= len(header))
    table = parsed.filter(fits).select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)))
    totals = parsed.agg(F.count_if(fits).alias("n_rows"), F.count_if(~fits).alias("n_rejected"), F.count_distinct(F.when(~fits, F.col("raw"))).alias("n_distinct_rejected"))
    return Loaded(table, header, parsed.filter(~fits).select("raw", F.coalesce("reason", F.lit("cell_count")).alias("reason")), totals)


def read_framed(spark: SparkSession, path: str, info: FormatInfo) -> Loaded:
    """A pipe-framed report: rulers dropped, cells trimmed, widths kept. Rows with another number of cells than the header and lines without a frame
    below the header are set apart; the lines above the header are its title."""
    title: list[str] = []
    head = "||"
    with open(path, encoding=info.encoding, errors="replace") as f:
        for line in f:
            bare = line.lstrip("\ufeff").strip()
            if bare.startswith("|") and not _RULER.match(bare):
                head = bare
                break
            title.append(bare)
    cells = head[1:-1].split("|")
    header = clean_header(cells)
    lines_of = spark.read.text(transcode(spark, path, info.encoding)).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    rows = lines_of.select(F.trim(F.regexp_replace("line", r"\r\z", "")).alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(_RULER.pattern) & (F.col("line") != head) & ~F.col("line").isin(title))
    framed = F.startswith("line", F.lit("|"))
    split = rows.select("line", F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|", -1).alias("cells"))
    whole = framed & (F.size("cells") == len(header)) & F.endswith("line", F.lit("|"))
    table = split.filter(whole).select(*(F.trim(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(header)))
    totals = split.agg(F.count_if(whole).alias("n_rows"), F.count_if(~whole).alias("n_rejected"), F.count_distinct(F.when(~whole, F.col("line"))).alias("n_distinct_rejected"))
    rejects = split.filter(~whole).select(F.col("line").alias("raw"), F.when(framed, "cell_count").otherwise("unframed").alias("reason"))
    return Loaded(table, header, rejects, totals, dict(zip(header, map(len, cells), strict=True)))


def read_parquet(spark: SparkSession, path: str) -> Loaded:
    df = typed_to_text(spark.read.parquet(path))
    return Loaded(df, df.columns)


def read_xlsx(spark: SparkSession, path: str) -> Loaded:
    """Needs a workbook reader for pandas, which is optional."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str).fillna("")
    frame.columns = clean_header([str(c) for c in frame.columns])
    return Loaded(spark.createDataFrame(frame), list(frame.columns))


def load(spark: SparkSession, path: str | Path, info: FormatInfo | None = None) -> Loaded:
    info = info or detect_format(path)
    if info.kind == "parquet":
        return read_parquet(spark, str(path))
    if info.kind == "xlsx":
        return read_xlsx(spark, str(path))
    return read_framed(spark, str(path), info) if info.kind == "framed" else read_csv(spark, str(path), info)


def read_manifest(path: str | Path) -> dict:
    """tables: name -> count or {rows, date}; client and date of the whole delivery."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    tables = {str(k).upper(): v if isinstance(v, dict) else {"rows": v} for k, v in (raw.get("tables") or {}).items()}
    return {"client": raw.get("client"), "date": raw.get("date"), "tables": tables}


_DATES = [(re.compile(r"(?<![0-9])((?:19|20)[0-9]{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12][0-9]|3[01])(?![0-9])"), (1, 2, 3)), (re.compile(r"(?<![0-9])(0[1-9]|[12][0-9]|3[01])\.(0[1-9]|1[0-2])\.((?:19|20)[0-9]{2})"), (3, 2, 1))]


def extraction_date(name: str, manifest: str | None = None, configured: str | None = None, modified: str | None = None) -> tuple[str | None, str]:
    """(ISO date, source): manifest before configuration before a date in the file's name before the time of the file."""
    for value, source in ((manifest, "manifest"), (configured, "configuration")):
        if value:
            return str(value), source
    for pattern, (y, m, d) in _DATES:
        hit = pattern.search(name)
        if hit:
            return f"{hit[y]}-{hit[m]}-{hit[d]}", "file name"
    return (modified, "file time") if modified else (None, "none")


def write_staged(df: DataFrame, path: str, keys: list[str]) -> None:
    """Range-partitioned and sorted by key, so that readers prune by it; as many files as the data needs, not one."""
    df.repartitionByRange(*(F.col(k).asc_nulls_last() for k in keys)).sortWithinPartitions(*(F.col(k).asc_nulls_last() for k in keys)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_findings(df: DataFrame, path: str) -> None:
    """One write for all rules, a folder for each rule; cut by ranges of rule and key, so a rule with many findings is many files."""
    df.repartitionByRange("rule_id", "object_key").sortWithinPartitions("rule_id", "object_key").write.mode("overwrite").partitionBy("rule_id").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One semicolon file with a byte order mark, for people; written in order by Spark and joined part by part, on any file system that Spark can reach."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    df.orderBy(*order).write.mode("overwrite").csv(parts, sep=";", header=False, quote='"', escape='"', emptyValue="")
    place, system = _place(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(b"\xef\xbb\xbf" + ";".join(df.columns).encode() + b"\n"))
        for name in sorted(str(s.getPath()) for s in system.listStatus(_place(spark, parts)[0]) if s.getPath().getName().startswith("part-")):
            part = system.open(_place(spark, name)[0])
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
            finally:
                part.close()
    finally:
        out.close()
    _delete(spark, parts)
