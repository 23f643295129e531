"""Joins and pairings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many of the most frequent keys are cut; any other key holds less than 1/MAX_HOT of the rows. It bounds what is broadcast.
MAX_HOT = 2048
#: Rows of a hot key in one split, and the most splits of a key.
SPLIT, MOST_SPLITS = 20_000, 4096


def hot_keys(df: DataFrame, key: str, least: int = SPLIT) -> DataFrame:
    """(key, splits) of the keys with more than `least` rows, the MAX_HOT most frequent ones; lazy, one aggregate over the key alone."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).orderBy(F.desc("_n")).limit(MAX_HOT)
    return counts.select(key, F.least(F.ceil(F.col("_n") / F.lit(least)), F.lit(MOST_SPLITS)).cast("int").alias("_splits"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """big join small on key, with the hot keys of big cut into splits and the rows of small repeated for each.

    `spread` is hashed to choose a split. `small` should hold few rows per key. Null keys of big match nothing;
    with how="left" they stay. Only "inner" and "left" are meaningful, as rows of small are repeated."""
    marks = F.broadcast(hot)
    left = big.join(marks, key, "left").withColumn("_salt", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_splits")).cast("int"))).drop("_splits")
    right = small.join(marks, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))).drop("_splits")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def pairs_within(df: DataFrame, group: list[str], item: str, cell: int = 1000) -> DataFrame:
    """(*group, item_a, item_b), a before b: every pair of different items of a group once per group; df holds each (group, item) once.

    A group of more than `cell` items is cut into parts by hash; every two parts meet in a cell of their own, so a task never holds more than
    two parts of a group at once and one large group is spread over many tasks. Null items pair with nothing; null groups hold nothing."""
    rows = df.select(*group, item).filter(F.col(item).isNotNull())
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*group, F.ceil(F.col("_n") / F.lit(cell)).cast("int").alias("_parts"))
    marked = rows.join(sized, group).withColumn("_p", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    met = marked.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("_p", "_i"), F.greatest("_p", "_i")
    placed = met.select(*group, item, F.col("_p"), low.alias("_c1"), high.alias("_c2"))
    on = [*group, "_c1", "_c2"]
    left, right = placed.withColumnRenamed(item, f"{item}_a").withColumnRenamed("_p", "_pa"), placed.withColumnRenamed(item, f"{item}_b").withColumnRenamed("_p", "_pb")
    both = left.join(right, on).filter((F.col(f"{item}_a") < F.col(f"{item}_b")) & ((F.col("_pa") != F.col("_pb")) | (F.col("_c1") == F.col("_c2"))))
    return both.select(*group, f"{item}_a", f"{item}_b")
