"""Evaluation texts inside documents: windows embedded by CGK random walks, found by bit-sampling LSH, verified exactly.

Texts become words (runs of a-z and 0-9 after lower-casing and spelling out umlauts and sharp s). Every window of `width`
words is walked through: at each of 3 * width steps the current word is written down, and a random bit of that word's hash
decides whether the walk moves on. Windows at a small edit distance (in words) give walks at a small Hamming distance, equal
windows give equal walks. A repetition samples `sampled` of the steps into one key; with `repetitions` walks of their own, a window at edit
distance d is missed with probability (1 - p(d)) ** repetitions. Equal windows are never missed, so no edits need one repetition. Each pair of windows
under one key is verified once, however many documents hold it: the word-level edit distance must not exceed `max_edits` (0: the same words in a row).

The items are the query set, of any number: their windows are a table, and the documents are read once. What goes to the tasks is a
bitmap of the items' keys, of at most MOST_BITS; windows of documents whose key is not in it are dropped where they stand, the others are
joined with the items' windows by key. A passage in a large part of the documents is a hot key there and is cut into splits.

Null and empty texts, and texts or items of fewer than `width` words, match nothing. Repeated items match each on their own.
Very long texts are walked whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.operators.skew import hot_keys, salted_join
from stammwerk.session import Scratch

#: Size of the bitmap: bits for each key of the items, and the most in all (8 MB).
BITS_A_KEY, MOST_BITS = 256, 1 << 26
_WORDS = re.compile("[a-z0-9]+").findall
_SPELL = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower().translate(_SPELL)) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object)) if tokens else np.zeros(0, np.uint64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walks:
    """The sampled walks of all windows, one key array per repetition."""

    def __init__(self, width: int, sampled: int, repetitions: int, seed: int = 11):
        self.width, self.repetitions = width, repetitions
        steps = 3 * width
        draw = np.random.default_rng(seed)
        self.samples = [set(draw.choice(steps, size=min(sampled, steps), replace=False).tolist()) for _ in range(repetitions)]
        self.factors = draw.integers(1, 2**63, size=(repetitions, steps), dtype=np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray, starts: np.ndarray, repetition: int) -> np.ndarray:
        steps = 3 * self.width
        padded = np.concatenate([hashes, np.zeros(steps, dtype=np.uint64)])
        bits = _mix(padded, 2 * repetition + 101)
        last = max(self.samples[repetition], default=-1)
        at = starts.astype(np.int64)
        end = at + self.width
        key = np.zeros(len(at), dtype=np.uint64)
        for step in range(last + 1):
            if step in self.samples[repetition]:  # a walk past its window writes down nothing
                key += np.where(at < end, padded[at], np.uint64(0)) * self.factors[repetition][step]
            if step and step % 64 == 0:
                bits = _mix(padded, 2 * repetition + 102 + (step << 16))
            at += ((bits >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)[at]
        return _mix(key, repetition)


def window_starts(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and the text of each."""
    counts = np.maximum(lengths - width + 1, 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (first[text] + inner).astype(np.int64), text


def edit_distance(a: list[str], b: list[str], limit: int) -> int:
    """Word-level edit distance, or limit + 1 if it is greater."""
    if a == b:
        return 0
    if limit == 0:
        return 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def _windows(rows: DataFrame, walks: Walks, bitmap: np.ndarray | None) -> DataFrame:
    """(id, key, window) of rows (id, text): one row per repetition and window whose key the bitmap holds, all without a bitmap."""
    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("key", T.LongType()), T.StructField("window", T.StringType())])
    sent = rows.sparkSession.sparkContext.broadcast(bitmap.tobytes()) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint64) if sent is not None else None
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [words(t) for t in part.column(1).to_pylist()]
                starts, owner = window_starts(np.array([len(ws) for ws in texts], dtype=np.int64), walks.width)
                if not len(starts):
                    continue
                tokens = [w for ws in texts for w in ws]
                hashes = word_hashes(tokens)
                for r in range(walks.repetitions):
                    keys = walks.keys(hashes, starts, r)
                    hit = np.arange(len(keys))
                    if held is not None:
                        at = keys & np.uint64(len(held) * 64 - 1)
                        hit = np.flatnonzero((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                    shown = [" ".join(tokens[i : i + walks.width]) for i in starts[hit].tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[hit])), pa.array(keys[hit].view(np.int64)), pa.array(shown, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all keys (key), put together in 64-bit words by the cluster: at most MOST_BITS / 64 rows come back."""
    wanted = max(64, keys.distinct().count() * BITS_A_KEY)
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    found = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bitmap


def _edits(pairs: DataFrame, limit: int) -> DataFrame:
    """(window, item_window, edits) of the pairs at most `limit` word edits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [edit_distance(a.split(" "), b.split(" "), limit) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.int32())], names=["window", "item_window", "edits"]).filter(pa.array([e <= limit for e in edits], pa.bool_()))

    return pairs.mapInArrow(run, "window string, item_window string, edits int")


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 12, max_edits: int = 0, sampled: int = 10, repetitions: int = 1) -> DataFrame:
    """(doc_id, item_id, edits): one row per document and item with windows at most max_edits words apart."""
    scratch = Scratch(documents.sparkSession, "leaks")
    walks = Walks(width, sampled, repetitions)
    filled = lambda df, i, t: df.select(F.col(f"`{i}`").alias("id"), F.col(f"`{t}`").alias("text")).filter("text <> ''")
    asked = scratch.write(_windows(filled(items, item_id, item_text), walks, None).distinct())
    hits = scratch.write(_windows(filled(documents, doc_id, text), walks, _bitmap(asked.select("key"))))
    sides = asked.select("key", F.col("id").alias("item"), F.col("window").alias("item_window"))
    met = salted_join(hits, sides, "key", hot_keys(hits, "key"), F.col("id")).select("id", "item", "window", "item_window")
    if max_edits:
        # a word that the other window lacks takes an edit of its own; most windows that merely share sampled words end here
        near = F.size(F.array_except(F.split("window", " "), F.split("item_window", " "))) <= max_edits
        met = scratch.write(met.filter(near).distinct())
        judged = _edits(met.select("window", "item_window").distinct(), max_edits)
        met = met.join(judged, ["window", "item_window"])
    else:
        met = met.filter("window = item_window").withColumn("edits", F.lit(0))
    return met.groupBy(F.col("id").alias(doc_id), F.col("item").alias(item_id)).agg(F.min("edits").alias("edits"))
