"""The blocked duplicate finder: exact pairs on hard keys, fuzzy pairs inside blocks, clusters, and their findings rows.

No block is skipped: one with more than `cell` records is cut into parts, and every two parts meet in one cell, so all its pairs are
compared in pieces of bounded size. `blocks` reports the blocks and their sizes.
Exact keys never expand to all pairs: every record of a key is paired with the key's smallest record, which connects the same
clusters. Null and blank keys block nothing. Empty tables give no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.functions import names as nm
from stammwerk.functions.names import token_sort_ratio
from stammwerk.session import Scratch


def exact_pairs(df: DataFrame, key: str, hard_keys: list[str]) -> DataFrame:
    """(left, right, score, reason, match_type): left is the smallest record with the same filled hard key."""
    parts = []
    for name in hard_keys:
        rows = df.select(F.col(key).alias("k"), F.col(name).alias("v")).filter("v <> ''").distinct()
        first = rows.groupBy("v").agg(F.min("k").alias("left"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(rows.join(first, "v").filter("k <> left").select("left", F.col("k").alias("right"), F.lit(100).alias("score"), F.lit(f"same {name}").alias("reason"), F.lit("exact").alias("match_type")))
    return reduce(DataFrame.unionByName, parts)


def blocks(df: DataFrame, key: str, block_columns: list[str], cell: int = 2000) -> DataFrame:
    """(strategy, block, n, parts) of the blocks with more than one record."""
    each = df.select(F.col(key), F.inline(F.array(*(F.struct(F.lit(b).alias("strategy"), F.col(b).alias("block")) for b in block_columns)))).filter("block <> ''")
    return each.groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))


def _masks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, codes, masks, bags) of texts: codes by place (0 after the end), the places of each code as bits, and the bag of characters.

    A bag has four bits for each of 48 sorts of characters, filled one by one, and the number of characters beyond them."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner, place = np.repeat(np.arange(len(texts)), lengths), np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sort = np.where(raw == 32, 47, raw % 48)
    order = np.lexsort((sort, owner))
    group = owner[order] * 48 + sort[order]
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    rank = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    bit = group % 48 * 4 + np.minimum(rank, 3)
    bags = np.zeros((len(texts), 4), dtype=np.uint64)
    held = rank < 4
    np.bitwise_or.at(bags, (group[held] // 48, bit[held] >> 6), np.uint64(1) << (bit[held] & 63).astype(np.uint64))
    np.add.at(bags, (group[~held] // 48, 3), np.uint64(1))
    known, code = np.unique(raw, return_inverse=True)
    short = lengths[owner] <= 64
    codes = np.zeros((len(texts), int(min(lengths.max(initial=0), 64))), dtype=np.int64)
    codes[owner[short], place[short]] = code[short] + 1
    masks = np.zeros((len(texts), len(known) + 1), dtype=np.uint64)
    np.bitwise_or.at(masks, (owner[short], code[short] + 1), np.uint64(1) << place[short].astype(np.uint64))
    return lengths, codes, masks, bags


def _ratios(texts: list[str], facts: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded token-sort ratios of pairs of texts whose words are sorted already, as name_score gives them."""
    lengths, codes, masks, _ = facts
    out = np.zeros(len(i), dtype=np.int64)
    for begin in range(0, len(i), 50_000):
        x, y = i[begin : begin + 50_000], j[begin : begin + 50_000]
        full = np.where(lengths[x] >= 64, ~np.uint64(0), (np.uint64(1) << (lengths[x] & 63).astype(np.uint64)) - np.uint64(1))
        row = full.copy()
        for step in range(int(min(lengths[y].max(initial=0), 64))):
            hit = row & masks[x, codes[y, step]]
            row = ((row + hit) | (row - hit)) & full
        common = lengths[x] - np.bitwise_count(row)
        both = lengths[x] + lengths[y]
        score = (200.0 * common / np.maximum(both, 1) + 0.5).astype(np.int64)
        for at in np.flatnonzero((lengths[x] > 64) | (lengths[y] > 64)).tolist():
            score[at] = int(token_sort_ratio(texts[x[at]], texts[y[at]]) + 0.5)
        out[begin : begin + 50_000] = np.where((lengths[x] == 0) | (lengths[y] == 0), 0, score)
    return out


def _near_pairs(starts: np.ndarray, ends: np.ndarray, second: np.ndarray, lengths: np.ndarray, bags: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose lengths and bags allow the cutoff; a cell of two parts has those of the second part last."""
    small: list[tuple[np.ndarray, np.ndarray]] = []

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = np.minimum(bags[x, 3], bags[y, 3]).astype(np.int64)
        for w in range(3):
            common += np.bitwise_count(bags[x, w] & bags[y, w])
        return (common > 0) & (200.0 * np.minimum(common, np.minimum(lengths[x], lengths[y])) >= cutoff * (lengths[x] + lengths[y]))

    count = 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        middle = a + int(np.argmax(second[a:b])) if second[a:b].any() else b
        if middle == a:
            continue
        if middle == b and b - a <= 64:
            x, y = np.triu_indices(b - a, 1)
            small.append((x + a, y + a))
            count += len(x)
        else:
            step = max(1, 200_000 // (b - a))
            for begin in range(a, middle, step):
                top = min(begin + step, middle)
                low = middle if middle < b else begin + 1
                x, y = np.repeat(np.arange(begin, top), b - low), np.tile(np.arange(low, b), top - begin)
                if middle == b:
                    x, y = x[x < y], y[x < y]
                good = allowed(x, y)
                yield x[good], y[good]
        if count > 200_000:
            x, y = (np.concatenate(part) for part in zip(*small, strict=True))
            good = allowed(x, y)
            yield x[good], y[good]
            small, count = [], 0
    if small:
        x, y = (np.concatenate(part) for part in zip(*small, strict=True))
        good = allowed(x, y)
        yield x[good], y[good]


def fuzzy_pairs(df: DataFrame, key: str, name: str, address: str | None, block_columns: list[str], threshold: int = 88, combined: int = 85, cell: int = 2000) -> DataFrame:
    """Pairs whose name score reaches the threshold, or 0.65 name + 0.35 address the combined one (both addresses filled).

    The rows of a cell come to one task, which compares them in arrays: only pairs that score leave it, and a pair found in several
    blocks is kept once. Pairs are left out before the comparison only where lengths and characters rule the score out."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("n"), (F.col(address) if address else F.lit("")).alias("a"), *block_columns).filter("k IS NOT NULL AND trim(n) <> ''")
    counted = blocks(rows, "k", block_columns, cell).select("strategy", "block", "parts")
    each = rows.select("k", "n", "a", F.inline(F.array(*(F.struct(F.lit(b).alias("strategy"), F.col(b).alias("block")) for b in block_columns)))).filter("block <> ''").join(counted, ["strategy", "block"])
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    met = each.withColumn("_p", part).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("_p", "_i"), F.greatest("_p", "_i")
    placed = met.select("k", "n", "a", F.xxhash64("strategy", "block", low, high).alias("_h"), "strategy", "block", low.alias("c1"), high.alias("c2"), ((F.col("_p") != low)).alias("second"))
    cells = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_h").sortWithinPartitions("_h", "strategy", "block", "c1", "c2", "second").select("k", "n", "a", F.concat_ws("\u0001", "strategy", "block", "c1", "c2").alias("cell"), "second")
    # below the first score no address can lift a pair to the combined one
    cutoff = max(min(threshold, 70), min(threshold, math.ceil((combined - 35) / 0.65)))
    key_type = df.schema[key].dataType

    def compared(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("cell").to_numpy(zero_copy_only=False)
        change = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        names, places = ([" ".join(sorted((t or "").split())) for t in table.column(c).to_pylist()] for c in ("n", "a"))
        facts, other = _masks(names), _masks(places)
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        found = []
        for x, y in _near_pairs(change, np.r_[change[1:], len(ids)], second, facts[0], facts[3], cutoff - 0.5):
            score = _ratios(names, facts, x, y)
            good = score >= cutoff
            x, y, score = x[good], y[good], score[good]
            near = np.full(len(x), -1)
            asked = np.flatnonzero((score < threshold) & (other[0][x] > 0) & (other[0][y] > 0))
            near[asked] = _ratios(places, other, x[asked], y[asked])
            good = (score >= threshold) | ((near >= 0) & (0.65 * score + 0.35 * near >= combined - 0.001))
            found.append((x[good], y[good], score[good], near[good]))
        x, y, score, near = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        keys = table.column("k").combine_chunks()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(score, pa.int32()), pa.array(near, pa.int32())], names=["x", "y", "name_score", "address_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            ids = table.column("cell")
            last = len(ids) - 1
            if ids[0] == ids[last]:  # one cell so far
                rest = table
                continue
            while ids[last - 1] == ids[len(ids) - 1]:
                last -= 1
            rest = table.slice(last)
            yield compared(table.slice(0, last))
        if rest is not None:
            yield compared(rest)

    hits = cells.mapInArrow(run, T.StructType([T.StructField("x", key_type), T.StructField("y", key_type), T.StructField("name_score", T.IntegerType()), T.StructField("address_score", T.IntegerType())]))
    scored = hits.filter("x <> y").select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "name_score", F.when(F.col("address_score") >= 0, F.col("address_score")).alias("address_score")).distinct()
    mixed = scored.withColumn("mixed", 0.65 * F.col("name_score") + 0.35 * F.col("address_score"))
    score = F.when(F.col("name_score") >= threshold, F.col("name_score")).when(F.col("mixed") >= combined, F.round("mixed").cast("int"))
    reason = F.when(F.col("name_score") >= threshold, "similar name").otherwise("similar name and address")
    return mixed.withColumn("score", score).filter("score IS NOT NULL").select("left", "right", "score", reason.alias("reason"), F.lit("fuzzy").alias("match_type"))


def clusters(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(key, cluster): cluster is the smallest key linked directly or over others.

    Every round a record takes the smallest label among its neighbours and then its label's label, so a chain of n records takes
    about log n rounds; each round is written, which cuts the lineage."""
    scratch = scratch or Scratch(pairs.sparkSession, "clusters")
    edges = scratch.write(pairs.filter("left <> right").select(F.inline(F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b"))))).distinct())
    labels = scratch.write(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        jumped = scratch.write(nearer.join(up, "label", "left").select("a", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = jumped.select("a", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels.select(F.col("a").alias("key"), F.col("label").alias("cluster"))


def cluster_rows(pairs: DataFrame, members: DataFrame, key: str, shown: list[str], most: int = 1000) -> DataFrame:
    """One row per cluster: cluster, size, score (highest), match_type (exact if any is), members as JSON in key order.

    A member's compared values (columns `shown`) are those of one of its rows, the smallest. The JSON text shows the first `most` members; size counts
    all, and `clusters` names every one."""
    scratch = Scratch(pairs.sparkSession, "clusters")
    pairs = scratch.write(pairs)
    placed = scratch.write(clusters(pairs, scratch))
    facts = pairs.join(placed.withColumnRenamed("key", "left"), "left").groupBy("cluster").agg(F.max("score").alias("score"), F.min("match_type").alias("match_type"))
    rows = members.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count(F.lit(1)).alias("_rows"), *(F.min(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(shown)))
    size = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    first = placed.withColumn("_r", F.row_number().over(W.partitionBy("cluster").orderBy("key"))).filter(F.col("_r") <= most)
    member = F.struct("key", *(F.col(f"c{i}").alias(c) for i, c in enumerate(shown)))
    listed = first.join(rows, "key", "left").groupBy("cluster").agg(F.to_json(F.array_sort(F.collect_list(member)), {"ignoreNullFields": "false"}).alias("members"))
    return size.join(facts, "cluster").join(listed, "cluster").select("cluster", "size", "score", "match_type", "members")


@dataclass(frozen=True)
class Finder:
    """What makes two records of a source duplicates."""

    key_columns: tuple[str, ...]
    exact_keys: tuple[str, ...] = ()
    name_column: str | None = None
    street_column: str | None = None
    postcode_column: str | None = None
    city_column: str | None = None
    country_column: str | None = None
    strategies: tuple[str, ...] = ("country_postcode", "name_sorted", "name_prefix", "country_city", "postcode")
    fuzzy: bool = False
    threshold: int = 88
    combined: int = 85


#: The columns that a blocking strategy needs; one without them is dropped.
NEEDS = {"country_postcode": ("postcode_column",), "postcode": ("postcode_column",), "name_prefix": ("name_column",), "name_sorted": ("name_column",), "country_city": ("city_column",)}


def candidates(df: DataFrame, finder: Finder) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, hard keys, strategies): the key, the normalised hard keys, name, address and block keys of every record with a key."""
    have = lambda c: F.col(f"`{c}`") if c and c in df.columns else F.lit(None).cast("string")
    key = F.concat_ws("/", *(F.col(f"`{c}`").cast("string") for c in finder.key_columns))
    hard = [c for c in finder.exact_keys if c in df.columns]
    used = [s for s in finder.strategies if finder.fuzzy and all(getattr(finder, need) in df.columns for need in (*NEEDS[s], "name_column"))]
    name, street, post, city, land = (have(getattr(finder, f"{p}_column")) for p in ("name", "street", "postcode", "city", "country"))
    blocked = nm.block_keys(name, land, post, city)
    rows = df.select(key.alias("_key"), *(nm.norm_key(F.col(f"`{c}`").cast("string")).alias(f"_hard_{c}") for c in hard), nm.norm_name(name).alias("_name"), nm.norm_address(street, post, city, land).alias("_address"), *(blocked[s].alias(f"_block_{s}") for s in used))
    return rows.filter("_key <> ''"), hard, used


def find_pairs(df: DataFrame, finder: Finder) -> DataFrame:
    """(left, right, score, reason, match_type) of a source: exact pairs on every hard key, and fuzzy ones inside all of its blocks."""
    rows, hard, used = candidates(df, finder)
    rows = Scratch(df.sparkSession, "candidates").write(rows)
    none = rows.limit(0).select(F.col("_key").alias("left"), F.col("_key").alias("right"), F.lit(0).alias("score"), F.lit("").alias("reason"), F.lit("").alias("match_type"))
    parts = [none]
    if hard:
        parts.append(exact_pairs(rows, "_key", [f"_hard_{c}" for c in hard]).withColumn("reason", F.regexp_replace("reason", "_hard_", "")))
    if used:
        parts.append(fuzzy_pairs(rows, "_key", "_name", "_address", [f"_block_{s}" for s in used], finder.threshold, finder.combined))
    return reduce(DataFrame.unionByName, parts)


def duplicate_clusters(df: DataFrame, finder: Finder) -> DataFrame:
    """One row per cluster of a source, with the compared columns of its members as delivered."""
    key = F.concat_ws("/", *(F.col(f"`{c}`").cast("string") for c in finder.key_columns))
    compared = [c for c in (finder.name_column, finder.street_column, finder.postcode_column, finder.city_column, finder.country_column, *finder.exact_keys) if c and c in df.columns]
    return cluster_rows(find_pairs(df, finder), df.withColumn("_key", key), "_key", list(dict.fromkeys(compared)))
