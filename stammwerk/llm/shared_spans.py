"""Long exact spans shared between records, by super-k-mers.

A window is `span` code points. Its minimiser is the m-gram of least hash inside it, and consecutive windows with the same
minimiser form one super-k-mer, which travels as one packed string to the bucket of that minimiser. Equal windows have equal
minimisers, so they meet in one bucket. Before any text travels, the buckets are reduced to the least and greatest record
in them; a bucket of one record is dropped. The strings of the others go to the task that holds their bucket, where the windows are hashed (128 bits),
sorted and counted; no single window leaves it, only the runs of windows that more than one record holds, and one window for each
set of records.

Equal super-k-mers (128-bit hash) are unpacked once, however many records hold them, and carry the number of their records and two
sums over the hashed ids, which add up per window.

Hot buckets: a minimiser with more than CROWDED distinct super-k-mers is not counted in one task; its windows are sent on by their own hash and counted
there. Windows held by the same set of records (equal count and sums) are represented by one of them; the text of a
representative is compared in all its super-k-mers, so every pair rests on equal characters. Its records are paired in cells of bounded size.

Null and empty texts and those shorter than the span share nothing. Exact copies are ordinary cases. A span repeated inside
one record only is not shared. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.operators.skew import pairs_within
from stammwerk.session import Scratch

MINIMISER = 100
#: Most distinct super-k-mers of a bucket that one task counts.
CROWDED = 5000
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_STEP = 1 << 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(_STEP, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        have = _POWERS[base] = (made[0], made[1])
    return have


def gram_hashes(codes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every gram of that length: a polynomial over mixed code points, from prefix sums."""
    n = len(codes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)) * up[:n], out=sums[1:])
    return _mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, least = 1, values
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def super_kmers(text: str, span: int, m: int) -> tuple[np.ndarray, ...]:
    """(bucket, h1, h2, start, end) of the text's super-k-mers: two hashes of the packed string; start and end in code points."""
    codes = code_points(text)
    if len(codes) < span:
        return (np.zeros(0, np.int64),) * 5
    least = sliding_min(gram_hashes(codes, m, BASES[0]), span - m + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1]).astype(np.int64)
    end = np.concatenate([first[1:], [len(least)]]).astype(np.int64) - 1 + span
    strings = []
    for base in BASES:
        up, down = _powers(base, len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)) * up[: len(codes)], out=sums[1:])
        strings.append(_mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)).view(np.int64))
    return least[first].view(np.int64), *strings, first, end


def cut(documents: DataFrame, span: int, m: int) -> DataFrame:
    """(bucket, h1, h2, start, end, doc) for documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                made = [super_kmers(t, span, m) for t in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x[0]) for x in made])
                joined = [np.concatenate([x[k] for x in made]) if made else np.zeros(0, np.int64) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in joined[:3]), *(pa.array(x.astype(np.int32), pa.int32()) for x in joined[3:]), pa.array(ids, pa.int64())], names=["bucket", "h1", "h2", "start", "end", "doc"])

    return documents.filter(F.length("text") >= span).mapInArrow(run, "bucket long, h1 long, h2 long, start int, end int, doc long")


_SIGNS = ["n", "s1", "s2", "least", "most"]


_RUN, _HOLDER = 0, 1
#: Runs of shared windows (lo to hi) of a super-k-mer, and super-k-mers that hold a representative window (w1, w2).
FOUND = "kind int, h1 long, h2 long, lo int, hi int, w1 long, w2 long, n long, s1 long, s2 long"


def _windows_of(packed: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, at, w1, w2) of all windows of packed strings."""
    hashes = [[gram_hashes(code_points(text), span, base) for base in BASES] for text in packed]
    counts = [len(h[0]) for h in hashes]
    at = np.concatenate([np.arange(c, dtype=np.int64) for c in counts]) if counts else np.zeros(0, np.int64)
    w1, w2 = (np.concatenate([h[k] for h in hashes]).view(np.int64) if counts else np.zeros(0, np.int64) for k in range(2))
    return np.repeat(np.arange(len(counts)), counts), at, w1, w2


def count_windows(part: pa.Table, span: int) -> pa.RecordBatch:
    """FOUND rows of whole buckets: columns h1, h2, n, s1, s2, least, most, packed."""
    texts = part.column("packed").to_pylist()
    column = {c: part.column(c).to_numpy() for c in ("h1", "h2", *_SIGNS)}
    owner, at, w1, w2 = _windows_of(texts, span)
    order = np.lexsort((w2, w1))
    owner, at, w1, w2 = owner[order], at[order], w1[order], w2[order]
    first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])][: len(w1)])
    if not len(first):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)
    sums = {c: np.add.reduceat(column[c][owner], first) for c in _SIGNS[:3]}
    shared = np.minimum.reduceat(column["least"][owner], first) < np.maximum.reduceat(column["most"][owner], first)
    size = np.diff(np.r_[first, len(w1)])
    # runs of consecutive shared windows in each super-k-mer
    held = np.repeat(shared, size)
    back = np.lexsort((at[held], owner[held]))
    o, p = owner[held][back], at[held][back]
    start = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] > p[:-1] + 1)][: len(o)])
    stop = np.r_[start[1:], len(o)] - 1 if len(start) else start
    # one window for each set of records, with its super-k-mers grouped by the characters that they have there
    groups = np.flatnonzero(shared)
    _, chosen = np.unique(np.stack([sums[c][groups] for c in _SIGNS[:3]], axis=1), axis=0, return_index=True) if len(groups) else (None, [])
    holders: list[tuple[int, int, int]] = []
    for g in groups[chosen].tolist() if len(groups) else []:
        seen: dict[str, int] = {}
        for i in range(first[g], first[g] + size[g]):
            text = texts[owner[i]][at[i] : at[i] + span]
            holders.append((g, int(owner[i]), seen.setdefault(text, len(seen))))
    holders = sorted(set(holders))
    g, k, other = (np.array(c, dtype=np.int64) for c in zip(*holders, strict=True)) if holders else (np.zeros(0, np.int64),) * 3
    n, m, none = len(start), len(g), np.zeros
    both = lambda runs, held_by, kind=np.int64: pa.array(np.concatenate([runs, held_by]).astype(kind))
    columns = [both(np.full(n, _RUN), np.full(m, _HOLDER), np.int32), both(column["h1"][o[start]], column["h1"][k]), both(column["h2"][o[start]], column["h2"][k])]
    columns += [both(p[start], none(m), np.int32), both(p[stop] + span, none(m), np.int32), both(none(n), w1[first[g]]), both(none(n), w2[first[g]] ^ other)]
    columns += [both(none(n), sums[c][g]) for c in _SIGNS[:3]]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)


_FOUND_ARROW = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in (f.split(" ") for f in FOUND.split(", "))])


def count_in_buckets(packed: DataFrame, span: int) -> DataFrame:
    """FOUND rows of packed strings (bucket, h1, h2, signs, packed), each bucket in the task that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            ids = table.column("bucket").to_numpy()
            last = int(np.flatnonzero(ids == ids[-1])[0])
            rest = table.slice(last)
            if last:
                yield count_windows(table.slice(0, last), span)
        if rest is not None:
            yield count_windows(rest, span)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def count_by_hash(packed: DataFrame, span: int) -> DataFrame:
    """The same for crowded buckets: windows are counted where their own hash sends them."""
    others = [f for f in packed.schema.fields if f.name not in ("packed", "bucket")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                owner, at, w1, w2 = _windows_of(part.column("packed").to_pylist(), span)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(at.astype(np.int32)), *(part.column(f.name).take(pa.array(owner)) for f in others)], names=["w1", "w2", "at", *(f.name for f in others)])

    scratch = Scratch(packed.sparkSession, "crowded")
    windows = scratch.write(packed.mapInArrow(run, T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("at", T.IntegerType()), *others])))
    counts = windows.groupBy("w1", "w2").agg(*(F.sum(c).alias(c) for c in _SIGNS[:3]), F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most")
    at = windows.join(counts.select("w1", "w2"), ["w1", "w2"], "left_semi").select("h1", "h2", "at").distinct()
    island = F.col("at") - F.row_number().over(W.partitionBy("h1", "h2").orderBy("at"))
    runs = at.withColumn("_i", island).groupBy("h1", "h2", "_i").agg(F.min("at").alias("lo"), (F.max("at") + span).alias("hi"))
    chosen = counts.groupBy(*_SIGNS[:3]).agg(F.min(F.struct("w1", "w2")).alias("w")).select("w.w1", "w.w2", *_SIGNS[:3])
    held = windows.select("w1", "w2", "h1", "h2", F.col("at")).join(chosen, ["w1", "w2"])
    # the characters of the representatives, hashed as they stand, split a chance meeting of hashes
    text = packed.select("h1", "h2", "packed").join(held, ["h1", "h2"]).select("h1", "h2", "w1", (F.col("w2").bitwiseXOR(F.xxhash64(F.substring("packed", F.col("at") + 1, F.lit(span))))).alias("w2"), *_SIGNS[:3]).distinct()
    zero = lambda c, kind="long": F.lit(0).cast(kind).alias(c)
    names = [f.split(" ")[0] for f in FOUND.split(", ")]
    return runs.select(F.lit(_RUN).alias("kind"), "h1", "h2", "lo", "hi", *(zero(c) for c in names[5:])).unionByName(text.select(F.lit(_HOLDER).alias("kind"), "h1", "h2", zero("lo", "int"), zero("hi", "int"), "w1", "w2", *_SIGNS[:3]))


def shared_windows(documents: DataFrame, doc_id: str, text: str, span: int = 300, m: int = MINIMISER) -> tuple[DataFrame, DataFrame]:
    """(pieces, found): the super-k-mers (bucket, h1, h2, start, end, doc) in buckets of several records, and the FOUND rows of the distinct ones."""
    scratch = Scratch(documents.sparkSession, "spans")
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc IS NOT NULL")
    every = scratch.write(cut(docs, span, m))
    several = every.groupBy("bucket").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("bucket")
    pieces = scratch.write(every.join(several, "bucket", "left_semi"))
    scratch.drop(1)  # of the other buckets nothing is read again
    sign = lambda seed: F.sum(F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 31)))
    held = scratch.write(pieces.groupBy("bucket", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), sign(1).alias("s1"), sign(2).alias("s2"), F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(F.struct("doc", "start", "end")).alias("_p")).select("bucket", "h1", "h2", *_SIGNS, "_p.*"))
    # a bucket with one string holds no window in two places of different records, unless several records hold that string
    packed = docs.join(held, "doc").select("bucket", "h1", "h2", *_SIGNS, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("packed"))
    crowded = scratch.write(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > CROWDED).select("bucket"))
    if crowded.isEmpty():
        return pieces, scratch.write(count_in_buckets(packed, span))
    packed = scratch.write(packed)
    found = count_in_buckets(packed.join(crowded, "bucket", "left_anti"), span).unionByName(count_by_hash(packed.join(crowded, "bucket", "left_semi"), span))
    return pieces, scratch.write(found)


def sharing_classes(documents: DataFrame, doc_id: str, text: str, span: int = 300) -> DataFrame:
    """(w1, w2, doc): the records of every distinct set of records that share a span, named by one of its windows; one row per set and record.

    All links of `sharing_pairs` stand in it, unexpanded: two records share a span if and only if some set holds both."""
    pieces, found = shared_windows(documents, doc_id, text, span)
    holders = found.filter(F.col("kind") == _HOLDER)
    chosen = holders.groupBy(*_SIGNS[:3]).agg(F.min(F.struct("w1", "w2")).alias("w")).select("w.w1", "w.w2")
    kept = holders.join(chosen, ["w1", "w2"], "left_semi").select("w1", "w2", "h1", "h2").distinct().join(pieces.select("h1", "h2", "doc"), ["h1", "h2"]).select("w1", "w2", "doc").distinct()
    return Scratch(documents.sparkSession, "sharing").write(kept)


def sharing_pairs(documents: DataFrame, doc_id: str, text: str, span: int = 300) -> DataFrame:
    """(doc_a, doc_b), a smaller: all pairs of records that share a span."""
    return pairs_within(sharing_classes(documents, doc_id, text, span), ["w1", "w2"], "doc").select("doc_a", "doc_b").distinct()


def shared_share(documents: DataFrame, doc_id: str, text: str, span: int = 300) -> DataFrame:
    """(doc, n_chars, shared_chars, share): how much of each sharing record stands elsewhere too.

    The intervals of a record are merged in order; they are bounded by one text."""
    pieces, found = shared_windows(documents, doc_id, text, span)
    runs = found.filter(F.col("kind") == _RUN).select("h1", "h2", "lo", "hi")
    spans = runs.join(pieces, ["h1", "h2"]).select("doc", (F.col("lo") + F.col("start")).alias("lo"), (F.col("hi") + F.col("start")).alias("hi")).distinct()
    so_far = F.max("hi").over(W.partitionBy("doc").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.select("doc", F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(so_far, F.col("lo"))), F.lit(0)).alias("c")).groupBy("doc").agg(F.sum("c").alias("shared_chars"))
    lengths = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.length(f"`{text}`").alias("n_chars"))
    return covered.join(lengths, "doc").select("doc", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("share"))
