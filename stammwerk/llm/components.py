"""Groups of records linked directly or indirectly, by repeated low-diameter decomposition.

One level: every vertex draws a shift from an exponential distribution and starts a cluster that much earlier; clusters
grow along the edges one hop a round, and a vertex joins the cluster that reaches it first (least start + hops, then
the smaller label). Clusters contract to super-vertices, edges inside a cluster vanish, and the next level works on the
edges between clusters. A vertex only ever takes a label of its own group, so contraction keeps groups apart and
together however early growth is stopped; the levels end when no edge is left. The assignments of all levels are then
composed from the last to the first, and each group is named by its smallest key.

Hubs: the edges of a vertex with many edges are cut into splits and its state is repeated for each, in the rounds of growth, in
contraction and in naming; messages to a vertex are reduced before the exchange. Levels are written to the shared scratch folder. Once a contracted
graph has at most SMALL edges, the remaining levels of the same recursion run in one task, whose memory that number bounds.

Nulls and empty keys link nothing and get no row; a key paired only with itself is a group of one; repeated and reversed
pairs count once; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stammwerk.operators.skew import hot_keys, salted_join
from stammwerk.session import Scratch

#: Rate of the exponential shifts, and rounds of growth a level.
BETA, ROUNDS = 0.1, 3
#: A vertex with more edges than this is cut into splits.
HUB = 20_000
#: A graph of at most so many edges (both directions) is finished in one task.
SMALL = 100_000


ID_BITS = 43  # of a vertex id; the time that a cluster reaches it stands above, in 1/16 hops
HOP = 16


def _start(vertex: Column, level: int) -> Column:
    """2**16 minus the vertex's shift; drawn from the vertex's hash, so a recomputed task draws the same."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return (F.lit(1 << 16) + F.round(F.log(uniform) / BETA * HOP)).cast("long")


def _grow(edges: DataFrame, hot: DataFrame | None, level: int) -> DataFrame:
    """(v, label): the cluster that reaches each vertex of edges (src, dst; both directions) first."""
    state = edges.select(F.col("src").alias("v")).distinct().select("v", F.shiftleft(_start(F.col("v"), level), ID_BITS).bitwiseOR(F.col("v")).alias("best"))
    for _ in range(ROUNDS):
        sent = state.withColumnRenamed("v", "src")
        met = edges.join(sent, "src") if hot is None else salted_join(edges, sent, "src", hot, F.col("dst"))
        reached = met.select(F.col("dst").alias("v"), (F.col("best") + F.lit(HOP << ID_BITS)).alias("best"))
        state = state.unionByName(reached).groupBy("v").agg(F.min("best").alias("best"))
    return state.select("v", F.col("best").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("label"))


def decompose(src: np.ndarray, dst: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, labels) of a graph in memory, by the same recursion; clusters grow until nothing changes. Edges stand in both directions."""
    vertices, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    label = np.arange(len(vertices))
    draw = np.random.default_rng(seed)
    while len(a):
        at, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
        best = (np.round((1e4 - draw.exponential(1 / BETA, len(at))) * HOP).astype(np.int64) << 32) | np.arange(len(at))
        while True:
            grown = np.minimum(best, np.minimum.reduceat(best[x] + (HOP << 32), first))  # every vertex has an edge
            if (grown == best).all():
                break
            best = grown
        step = np.arange(len(vertices))
        step[at] = at[best & 0xFFFFFFFF]
        label = step[label]
        a, b = step[a], step[b]
        kept = a != b
        pairs = np.unique(a[kept] * len(vertices) + b[kept])
        a, b = pairs // len(vertices), pairs % len(vertices)
    return vertices, vertices[label]


def _finish(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # at most SMALL edges
        if parts:
            whole = pd.concat(parts)
            v, label = decompose(whole.src.to_numpy(), whole.dst.to_numpy())
            yield pd.DataFrame({"v": v, "label": label})

    return edges.coalesce(1).mapInPandas(run, "v long, label long")


def connected_groups(pairs: DataFrame, left: str, right: str, small: int = SMALL) -> DataFrame:
    """(key, group): one row per key in a pair with both sides filled; group is the smallest key of its group."""
    scratch = Scratch(pairs.sparkSession, "groups")
    links = pairs.select(F.col(f"`{left}`").cast("string").alias("a"), F.col(f"`{right}`").cast("string").alias("b")).filter("a <> '' AND b <> ''")
    links = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # ids are unique and dense: the row in its task times the tasks, plus the task
    numbers = F.monotonically_increasing_id()
    keys = scratch.write(links.select(F.explode(F.array("a", "b")).alias("key")).distinct().select("key", F.shiftright(numbers, 33).alias("task"), numbers.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    tasks = (keys.agg(F.max("task")).first()[0] or 0) + 1
    keys = keys.select("key", (F.col("row") * tasks + F.col("task")).alias("id"))
    apart = links.filter("a <> b")
    half = salted_join(apart, keys.select(F.col("key").alias("a"), F.col("id").alias("src")), "a", hot_keys(apart, "a", HUB), F.col("b"))
    numbered = salted_join(half, keys.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b", hot_keys(apart, "b", HUB), F.col("a"))
    edges = scratch.write(numbered.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))))
    levels: list[DataFrame] = []
    n_edges = edges.count()
    while n_edges > small:
        at = scratch.written
        hot = scratch.write(hot_keys(edges, "src", HUB)) if n_edges > HUB else None  # fewer edges hold no hub
        hot = None if hot is None or hot.isEmpty() else hot
        grown = scratch.write(_grow(edges, hot, len(levels)))
        levels.append(grown)
        one, two = grown.select(F.col("v").alias("src"), F.col("label").alias("s")), grown.select(F.col("v").alias("dst"), F.col("label").alias("d"))
        if hot is None:
            inner = edges.join(one, "src").join(two, "dst")
        else:
            inner = salted_join(salted_join(edges, one, "src", hot, F.col("dst")), two, "dst", hot.withColumnRenamed("src", "dst"), F.col("src"))
        edges = scratch.write(inner.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
        n_edges = edges.count()
        scratch.drop(at)
    if n_edges:
        levels.append(scratch.write(_finish(edges)))
    if not levels:
        return keys.select("key", F.col("key").alias("group"))
    root = levels.pop()
    while levels:
        lower = levels.pop()
        up = root.select(F.col("v").alias("label"), F.col("label").alias("_up"))
        root = salted_join(lower, up, "label", hot_keys(lower, "label"), F.col("v"), "left").select("v", F.coalesce("_up", "label").alias("label"))
    root = scratch.write(keys.join(root.withColumnRenamed("v", "id"), "id", "left").select("key", F.coalesce("label", "id").alias("label")))
    names = root.groupBy("label").agg(F.min("key").alias("group"))
    return salted_join(root, names, "label", hot_keys(root, "label"), F.col("key")).select("key", "group")


def material_key(column: Column, width: int = 18) -> Column:
    """A key without blanks around it; one of digits only is filled with zeros to the width."""
    key = F.trim(column)
    return F.when(key.rlike(r"^[0-9]+\z") & (F.length(key) < width), F.lpad(key, width, "0")).otherwise(key)
