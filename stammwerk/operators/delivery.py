"""Checks of a delivery before its contents are judged, as DataFrames over the delivered tables.

Every check gives rows only where something is wrong. Null keys are keys like any other; empty tables give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and their surplus rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("surplus", F.col("n") - 1)


def row_counts(tables: dict[str, DataFrame], reported: dict[str, int], tolerance: float = 0.0) -> DataFrame:
    """(table_name, n_rows, reported, state): ok, differs or unreported; the tolerance is a share of the reported count."""
    counted = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(reported.get(name)).cast("bigint").alias("reported")) for name, df in tables.items()))
    return counted.withColumn("state", F.when(F.col("reported").isNull(), "unreported").when(F.abs(F.col("n_rows") - F.col("reported")) <= F.col("reported") * tolerance, "ok").otherwise("differs"))


def length_pile_ups(df: DataFrame, columns: list[str], least_rows: int = 100, least_hits: int = 5, share: float = 0.02, factor: float = 3.0, shortest: int = 10, source: str | None = None) -> DataFrame:
    """(column_name, max_length, n_at_max, n_filled): columns whose texts pile up at their greatest length. One pass.

    With a source column each source is judged on its own, and column_name is source.column."""
    title = lambda c: F.concat_ws(".", F.col(f"`{source}`"), F.lit(c)) if source else F.lit(c)
    cells = df.select(F.inline(F.array(*(F.struct(title(c).alias("column_name"), F.length(F.col(f"`{c}`").cast("string")).alias("l")) for c in columns)))).filter("l > 0")
    counts = cells.groupBy("column_name", "l").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column_name").agg(F.max("l").alias("max_length"), F.sum("n").alias("n_filled"))
    near = counts.join(top, "column_name").groupBy("column_name", "max_length", "n_filled").agg(F.sum(F.when(F.col("l") == F.col("max_length"), F.col("n"))).alias("n_at_max"), (F.coalesce(F.sum(F.when((F.col("l") < F.col("max_length")) & (F.col("l") >= F.col("max_length") - 3), F.col("n"))), F.lit(0)) / 3).alias("below"))
    return near.filter((F.col("n_filled") >= least_rows) & (F.col("n_at_max") >= least_hits) & (F.col("n_at_max") >= F.col("n_filled") * share) & (F.col("max_length") >= shortest) & (F.col("n_at_max") >= factor * F.col("below"))).select("column_name", "max_length", "n_at_max", "n_filled")


def over_declared(df: DataFrame, declared: dict[str, int]) -> DataFrame:
    """(column_name, declared, max_length) of the columns with longer texts than declared."""
    longest = df.agg(*(F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in declared))
    return longest.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("declared"), F.col(f"`{c}`").alias("max_length")) for c, n in declared.items())))).filter("max_length > declared")


def clients(df: DataFrame, column: str, expected: list[str] | None = None) -> DataFrame:
    """(client, n_rows, state): expected, unexpected, or missing (expected without rows); without expectations several clients are all 'unfiltered'."""
    found = df.groupBy(F.col(column).cast("string").alias("client")).agg(F.count(F.lit(1)).alias("n_rows"))
    if expected is None:
        many = found.agg(F.count(F.lit(1)).alias("_c"))
        return found.join(F.broadcast(many)).select("client", "n_rows", F.when(F.col("_c") > 1, "unfiltered").otherwise("expected").alias("state"))
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], "client string").withColumn("_w", F.lit(True))
    return found.join(wanted, "client", "full").select("client", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("_w").isNull(), "unexpected").when(F.col("n_rows").isNull(), "missing").otherwise("expected").alias("state"))


def same_content(files: DataFrame) -> DataFrame:
    """(sha256, n, files) of contents delivered more than once; one row per file, so the lists are as long as the deliveries."""
    return files.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_file")).filter("n > 1")


#: Row counts at which exports are known to stop.
EXPORT_LIMITS = [500, 1000, 5000, 9999, 10000, 50000, 65535, 99999, 100000, 999999, 1000000]


def reject_ratio(files: DataFrame, limit: float = 0.05) -> DataFrame:
    """Files whose rejected share is over the limit (blocking) or whose row count is an export limit (warning)."""
    rejected, rows = F.coalesce("rejected_rows", F.lit(0)), F.coalesce("raw_row_count", F.lit(0))
    state = F.when(rejected > limit * rows, "blocking").when(rows.isin(EXPORT_LIMITS), "export limit")
    return files.select("file_id", rows.alias("n_rows"), rejected.alias("n_rejected"), state.alias("state")).filter("state IS NOT NULL")


def partial_columns(columns: DataFrame) -> DataFrame:
    """(table_name, name, n_files, n_with): columns that some parts of a table lack; columns: table_name, file_id, name."""
    per_table = columns.groupBy("table_name").agg(F.count_distinct("file_id").alias("n_files"))
    per_name = columns.groupBy("table_name", "name").agg(F.count_distinct("file_id").alias("n_with"))
    return per_name.join(per_table, "table_name").filter("n_with < n_files").select("table_name", "name", "n_files", "n_with")


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """All partial deliveries under one schema; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scope(df: DataFrame, client: str, allowed_clients: list[str], company: str | None = None, allowed_companies: list[str] | None = None) -> DataFrame:
    """Rows of the expected clients; of the companies, or without one."""
    df = df.filter(F.col(client).isin(allowed_clients))
    if company and allowed_companies is not None:
        df = df.filter(F.col(company).isin(allowed_companies) | F.col(company).isNull())
    return df


def waterfall(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(position, stage, n): rows by the first condition that holds, counted in one pass, and what remains. A null condition does not hold."""
    label = F.lit(len(stages))
    for i, (_, condition) in reversed(list(enumerate(stages))):
        label = F.when(condition, i).otherwise(label)
    names = F.create_map(*(F.lit(x) for i, name in enumerate([*(n for n, _ in stages), "remaining"]) for x in (i, name)))
    return df.groupBy(label.alias("position")).agg(F.count(F.lit(1)).alias("n")).select("position", F.element_at(names, F.col("position")).alias("stage"), "n")


def cut_off_dates(files: DataFrame) -> DataFrame:
    """(table_name, state, n_files, first_date, last_date): tables with files of no known date (undocumented) or of several dates (differing).

    files: table_name, file_id, extraction_date. A table can have both states."""
    per = files.groupBy("table_name").agg(F.count_if(F.col("extraction_date").isNull()).alias("_none"), F.count_distinct("extraction_date").alias("_dates"), F.count(F.lit(1)).alias("n_files"), F.min("extraction_date").alias("first_date"), F.max("extraction_date").alias("last_date"))
    states = F.array_compact(F.array(F.when(F.col("_none") > 0, "undocumented"), F.when(F.col("_dates") > 1, "differing")))
    return per.select("table_name", F.explode(states).alias("state"), "n_files", "first_date", "last_date")


def usability(tables: DataFrame) -> DataFrame:
    """(system_id, table_name, problem, blocking, fields) of tables that cannot be used as they are.

    tables: system_id, table_name, row_count, row_count_before_filter, columns_seen, known_fields, missing_key_fields, tier. Missing key fields, no rows at all,
    and no rows left after the filter block a table of tier `must`; columns that no field is known for only warn."""
    unknown = F.array_except("columns_seen", F.coalesce("known_fields", F.array().cast("array<string>")))
    nothing = F.array().cast("array<string>")
    one = lambda when, name, fields: F.when(when, F.struct(F.lit(name).alias("problem"), F.array_sort(fields).alias("fields")))
    found = F.array_compact(F.array(
        one(F.size("missing_key_fields") > 0, "missing key", F.col("missing_key_fields")), one(F.coalesce("row_count_before_filter", "row_count") == 0, "empty", nothing),
        one((F.col("row_count") == 0) & (F.col("row_count_before_filter") > 0), "empty after filter", nothing), one(F.size(unknown) > 0, "unknown columns", unknown),
    ))
    rows = tables.select("system_id", "table_name", "tier", F.inline(found))
    return rows.select("system_id", "table_name", "problem", ((F.col("problem") != "unknown columns") & (F.lower("tier") == "must")).alias("blocking"), "fields")
