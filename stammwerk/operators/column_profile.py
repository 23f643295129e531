"""Column-level quality profile per load, by generalising values to character-class masks.

Cells are first counted per (table, column, load, value), combined before the exchange, so one value that fills a third
of the rows is one record afterwards. A value becomes a mask: A for capital letters, a for small ones, 9 for digits,
any other character as it stands, a run of four or more of one class as class and plus. The masks of a load, each with its cells, distinct
values, lengths and violations (`mask_table`), are the profile that all figures come from.

Violations: a column's conforming masks are given, or mined (`mined_masks`: the masks of a list of right values, or those that dominate the column). A value of another mask is
a violation at once; only values of conforming masks are checked one by one. Distribution: the divergence between the masks of two
loads is a lower bound of the one between their values; only columns whose masks stay under the limit are compared value by value.

Empty cells (null or only blanks) take part in the empty share alone. A load is compared with the load before only if
both delivered the column. An empty table gives an empty profile. Other columns of the tables are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stammwerk.session import Scratch


def mask(value: Column) -> Column:
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"[0-9]", "9")
    return F.regexp_replace(classes, r"(A|a|9)\1{3,}", "$1+")


def gtin_valid(value: Column) -> Column:
    """8, 12, 13 or 14 digits whose last one is the mod-10 check digit (weights 3, 1, ... from the right)."""
    digits = F.reverse(F.split(value, ""))
    total = F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0), lambda acc, i: acc + F.try_element_at(digits, i + 1).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.coalesce(F.when(value.rlike(r"^(?:[0-9]{8}|[0-9]{12,14})\z"), (total + F.element_at(digits, 1).cast("int")) % 10 == 0), F.lit(False))


def value_counts(df: DataFrame, table: str, columns: list[str], load: str) -> DataFrame:
    """(table_name, column_name, load_id, value, n)."""
    cells = df.select(F.col(load).alias("load_id"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))))
    return cells.groupBy("column_name", "load_id", "value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "column_name", "load_id", "value", "n")


def with_masks(counts: DataFrame) -> DataFrame:
    """Adds is_empty and mask to counted values."""
    empty = F.col("value").isNull() | (F.trim(F.col("value")) == "")
    return counts.withColumn("is_empty", empty).withColumn("mask", F.when(~empty, mask(F.col("value"))))


def mined_masks(examples: DataFrame, least: float = 0.0) -> DataFrame:
    """(column_name, mask): the masks of right values (column_name, value, and n if they are counted) with at least that share of their column."""
    weight = F.sum("n") if "n" in examples.columns else F.count(F.lit(1))
    per = examples.filter("trim(value) <> ''").groupBy("column_name", mask(F.col("value")).alias("mask")).agg(weight.alias("_n"))
    total = per.groupBy("column_name").agg(F.sum("_n").alias("_all"))
    return per.join(total, "column_name").filter(F.col("_n") >= F.col("_all") * least).select("column_name", "mask")


def with_marks(counts: DataFrame, valid: Column, conforming: DataFrame | None = None) -> DataFrame:
    """Adds is_empty, mask and is_valid to counted values; conforming (column_name, mask) are the masks a valid value can have, all where it is null."""
    marked = with_masks(counts)
    if conforming is not None:
        marked = marked.join(conforming.distinct().withColumn("_fits", F.lit(True)), ["column_name", "mask"], "left").withColumn("is_valid", F.when(F.col("_fits"), F.coalesce(valid, F.lit(False))).otherwise(F.lit(False))).drop("_fits")
        return marked.select(*counts.columns, "is_empty", "mask", "is_valid")  # rejected masks are violations without a look at their values
    return marked.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


_LOAD = ["table_name", "column_name", "load_id"]


def mask_table(counts: DataFrame) -> DataFrame:
    """One row per table, column, load and mask (null for empty cells): cells, distinct values, least and greatest length, violations."""
    return counts.groupBy(*_LOAD, "mask").agg(
        F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_values"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"),
        F.coalesce(F.sum(F.when(~F.col("is_valid"), F.col("n"))), F.lit(0)).alias("n_violations"),
    )


def profile(counts: DataFrame) -> DataFrame:
    """One row per table, column and load: rows, empty, filled, distinct_values, min_length, max_length, violations; from its masks."""
    return _profile_of(mask_table(counts))


def _profile_of(masks: DataFrame) -> DataFrame:
    filled = F.col("mask").isNotNull()
    over = lambda c: F.coalesce(F.sum(F.when(filled, F.col(c))), F.lit(0))
    return masks.groupBy(*_LOAD).agg(
        F.sum("n_cells").alias("n_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("n_cells"))), F.lit(0)).alias("n_empty"),
        over("n_cells").alias("n_filled"),
        over("n_values").alias("n_distinct"),
        F.min(F.when(filled, F.col("min_length"))).alias("min_length"),
        F.max(F.when(filled, F.col("max_length"))).alias("max_length"),
        over("n_violations").alias("n_violations"),
    )


def distribution_shift(counts: DataFrame, what: str) -> DataFrame:
    """Per table, column and load: half the sum of the absolute differences of the shares of `what` (a column) among filled cells to the load before."""
    per = counts.filter(~F.col("is_empty")).groupBy("table_name", "column_name", "load_id", F.col(what).alias("_what")).agg(F.sum("n").alias("_n"))
    total = counts.groupBy("table_name", "column_name", "load_id").agg(F.sum(F.when(~F.col("is_empty"), F.col("n")).otherwise(0)).alias("_all"))
    share = per.join(total, ["table_name", "column_name", "load_id"]).withColumn("_share", F.col("_n") / F.col("_all"))
    moved = share.select("table_name", "column_name", "_what", F.inline(F.array(F.struct(F.col("load_id").alias("load_id"), F.col("_share").alias("_d")), F.struct((F.col("load_id") + 1).alias("load_id"), (-F.col("_share")).alias("_d")))))
    gaps = moved.groupBy("table_name", "column_name", "_what", "load_id").agg(F.sum("_d").alias("_d"))
    return gaps.groupBy("table_name", "column_name", "load_id").agg((F.sum(F.abs("_d")) / 2).alias("shift"))


def departures(counts: DataFrame, identifying: list[str], nulls: float = 0.08, pattern: float = 0.06, mix: float = 0.2, distinct: float = 0.1) -> DataFrame:
    """(table_name, column_name, load_id, kind) of loads that depart from the load before.

    Columns in `identifying` are judged by their distinct share, all others by the mix of values and the range of lengths.
    Ratios are rounded to 9 places, so that a difference of exactly the threshold counts."""
    scratch = Scratch(counts.sparkSession, "masks")
    masks = scratch.write(mask_table(counts))
    stats = _profile_of(masks)
    before = W.partitionBy("table_name", "column_name").orderBy("load_id")  # one row per load: a few rows per window
    names = ["n_rows", "n_empty", "n_filled", "n_distinct", "min_length", "max_length", "n_violations"]
    pairs = stats.select("*", F.lag("load_id").over(before).alias("_load"), *(F.lag(c).over(before).alias(f"p_{c}") for c in names)).filter("_load = load_id - 1")
    by_mask = distribution_shift(masks.filter("mask IS NOT NULL AND NOT column_name IN (" + ", ".join(f"'{c}'" for c in ["", *identifying]) + ")").select(*_LOAD, "mask", F.col("n_cells").alias("n"), F.lit(False).alias("is_empty")), "mask")
    pairs = scratch.write(pairs.join(by_mask.select(*_LOAD, F.col("shift").alias("mask_shift")), _LOAD, "left"))  # one row per column and load
    # values are compared only where the masks, whose divergence is never greater, do not decide
    undecided = pairs.filter(~F.coalesce(F.round("mask_shift", 9) >= mix, F.lit(False)) & ~F.col("column_name").isin(identifying)).select("table_name", "column_name", F.explode(F.array("load_id", F.col("load_id") - 1)).alias("load_id")).distinct()
    by_value = distribution_shift(counts.join(undecided, _LOAD, "left_semi"), "value")
    pairs = pairs.join(by_value.select(*_LOAD, F.col("shift").alias("value_shift")), _LOAD, "left").withColumn("shift", F.when(F.round("mask_shift", 9) >= mix, F.col("mask_shift")).otherwise(F.col("value_shift")))

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    def apart(a: str, b: str, limit: float) -> Column:
        return F.round(F.abs(ratio(a, b) - ratio(f"p_{a}", f"p_{b}")), 9) >= limit

    both = (F.col("n_filled") > 0) & (F.col("p_n_filled") > 0)
    ident = F.col("column_name").isin(identifying)
    kinds = F.array(
        F.when(apart("n_empty", "n_rows", nulls), "nulls"),
        F.when(both & apart("n_violations", "n_filled", pattern), "pattern"),
        F.when(both & ~ident & (F.round("shift", 9) >= mix), "mix"),
        F.when(both & ident & apart("n_distinct", "n_filled", distinct), "distinct"),
        F.when(both & ~ident & ((F.col("min_length") != F.col("p_min_length")) | (F.col("max_length") != F.col("p_max_length"))), "range"),
    )
    return pairs.select("table_name", "column_name", "load_id", F.explode(F.array_compact(kinds)).alias("kind"))


def mask_profile(counts: DataFrame, dominant: float = 0.01) -> DataFrame:
    """Masks per table, column and load with their share; rare masks (share under `dominant`) are pattern violations."""
    per = counts.filter(~F.col("is_empty")).groupBy("table_name", "column_name", "load_id", "mask").agg(F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_values"))
    total = per.groupBy("table_name", "column_name", "load_id").agg(F.sum("n_cells").alias("_all"))
    share = F.round(F.col("n_cells") / F.col("_all"), 9)
    return per.join(total, ["table_name", "column_name", "load_id"]).select("table_name", "column_name", "load_id", "mask", "n_cells", "n_values", share.alias("share"), (share < dominant).alias("is_rare"))
