"""Byte-level BPE encoding of whole texts with a public vocabulary, by a bucket queue over merge ranks.

A pre-token is a doubly linked list of byte positions. Every adjacent pair that has a merge rank lies in the bucket of that
rank; a bitmap of three levels (64 branches each) tells which ranks have entries, and find-first-set walks down to the
least of them. All entries of that bucket are merged from left to right; an entry whose pair has changed since is stale
and skipped. Merging costs a constant number of word operations, so a pre-token of n bytes takes O(n) steps, however long.

Pre-tokens recur, so each task keeps those it has encoded (`CACHE` of up to 64 bytes each; beyond that number it starts
over, which changes only the speed).

Empty and null texts have the ids [] (an empty list, never null). Texts are encoded whole, without special tokens: the
names of special tokens inside a text are ordinary text. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The published pre-token pattern of the byte_bpe vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000


class RankQueue:
    """Ranks that have entries, as bitmaps of 64-bit words in three levels; pops the least."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.top = 0
        self.middle: dict[int, int] = {}
        self.low: dict[int, int] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its entries; the queue must not be empty."""
        group = (self.top & -self.top).bit_length() - 1
        words = self.middle[group]
        word = group << 6 | (words & -words).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.middle[group] = words & (words - 1)
            if not self.middle[group]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes texts with the ranks of a vocabulary (bytes of a token -> id, merges in the order of the ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        start_next = list(range(1, n + 1))  # end of the token that starts at i, which is the start of the next one
        before = list(range(-1, n - 1))
        alive = [True] * n
        pair = [-1] * n  # the rank under which the pair that starts at i is queued
        queue = RankQueue()

        def offer(i: int) -> None:
            middle = start_next[i]
            rank = ranks.get(piece[i : start_next[middle]]) if middle < n else None
            pair[i] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, i)

        for i in range(n - 1):
            offer(i)
        while queue.top:
            rank, entries = queue.pop()
            entries.sort()
            for i in entries:
                if not alive[i] or pair[i] != rank:
                    continue  # stale
                gone = start_next[i]
                alive[gone] = False
                after = start_next[gone]
                start_next[i] = after
                if after < n:
                    before[after] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : start_next[i]]])
            i = start_next[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        cache = self.cache
        for token in self.split(text):
            known = cache.get(token)
            if known is None:
                known = self.merge(token.encode("utf-8", "surrogatepass"))
                if len(token) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[token] = known
            ids += known
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_texts(df: DataFrame, id_column: str, text_column: str, vocabulary: str) -> DataFrame:
    """(id, ids) of every row; the vocabulary file is sent along with the tasks once, through a broadcast."""
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = df.schema[id_column].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder({base64.b64decode(t): int(r) for t, r in (line.split() for line in content.value.splitlines() if line.strip())})
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                ids = pa.array([encoder.encode(text) for text in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.select(f"`{id_column}`", f"`{text_column}`").mapInArrow(run, schema)
