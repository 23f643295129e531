"""The core's problem queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stammwerk.operators import column_profile, record_parse, schema_drift, snapshot_diff
from stammwerk.operators.skew import hot_keys, salted_join
from stammwerk.session import Scratch
from stammwerk.sources.tables import table


def _mara_marc_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counted and marked values of the profiled columns."""
    counts = column_profile.value_counts(table(spark, root, "mara"), "mara", ["matkl", "meins", "ean11"], "load_id").unionByName(column_profile.value_counts(table(spark, root, "marc"), "marc", ["dismm"], "load_id"))
    listed = (
        table(spark, root, "t023").select(F.lit("matkl").alias("column_name"), F.col("matkl").alias("value"))
        .unionByName(table(spark, root, "t006").select(F.lit("meins").alias("column_name"), F.col("msehi").alias("value")))
        .distinct().withColumn("_listed", F.lit(True))
    )
    kind = F.col("column_name")
    valid = F.when(kind == "ean11", column_profile.gtin_valid(F.col("value"))).when(kind == "dismm", F.col("value").rlike(r"^[A-Z][A-Z0-9]\z")).otherwise(F.col("_listed"))
    # what a valid value can look like: the masks of the lists, two characters, or digits only
    fixed = spark.createDataFrame([("dismm", "AA"), ("dismm", "A9"), ("ean11", "9+")], "column_name string, mask string")
    conforming = column_profile.mined_masks(listed).unionByName(fixed)
    marked = column_profile.with_marks(counts.join(listed, ["column_name", "value"], "left"), valid, conforming).drop("_listed")
    return Scratch(spark, "profile").write(marked)  # the tables are read once, all figures come from the counted values


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return column_profile.departures(_mara_marc_counts(spark, root), ["ean11"])


def p6_profile(spark: SparkSession, root: str) -> DataFrame:
    return column_profile.profile(_mara_marc_counts(spark, root))


def p6_masks(spark: SparkSession, root: str) -> DataFrame:
    return column_profile.mask_profile(_mara_marc_counts(spark, root))


def p6_mask_shift(spark: SparkSession, root: str) -> DataFrame:
    shift = column_profile.distribution_shift(_mara_marc_counts(spark, root), "mask")
    return shift.select("table_name", "column_name", "load_id", F.round("shift", 6).alias("shift"))


def _finding_keys() -> dict:
    return {"mandt": F.coalesce(F.col("mandt"), F.lit("")), "finding_id": F.col("finding_id")}


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    findings = table(spark, root, "findings")
    return snapshot_diff.snapshot_changes(findings, "run_id", _finding_keys(), "loaded_at", ["run_at", "mandt", "finding_id"], ["detail"]).select("run_id", "mandt", "finding_id", "change")


def _with_headers(records: DataFrame, heads: DataFrame) -> DataFrame:
    """The records after the header, each with what its file's header says."""
    rows = records.filter("record_no > 1 AND raw_text <> ''")
    return salted_join(rows, heads, "file_id", hot_keys(records, "file_id"), F.col("record_no"), "left")


def _heads(columns: DataFrame, *more: str) -> DataFrame:
    """One row per file, written: so the join knows its size, and takes it to the records or the records to it."""
    heads = record_parse.headers_by_file(columns).select("file_id", "delimiter", F.col("codes").alias("types"), *more)
    return Scratch(columns.sparkSession, "heads").write(heads)


def _parsed(spark: SparkSession, root: str, **options: bool) -> DataFrame:
    records = table(spark, root, "raw_records").select("file_id", "record_no", "raw_text")
    columns = record_parse.file_headers(records, table(spark, root, "source_file"), table(spark, root, "registry_field"))
    return record_parse.parse(_with_headers(records, _heads(columns)), **options)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _parsed(spark, root, with_cells=False, only_failing=True).select("file_id", "record_no")


def p2_rejects(spark: SparkSession, root: str) -> DataFrame:
    return _parsed(spark, root, with_cells=False, only_failing=True).select("file_id", "record_no", "reason", "error_at", "column_no")


def _columns_and_cells(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The columns of every file, and (file_id, record_no, key, cells) of the valid records, both written once."""
    scratch = Scratch(spark, "drift")
    records = table(spark, root, "raw_records").select("file_id", "record_no", "raw_text")
    columns = scratch.write(record_parse.file_headers(records, table(spark, root, "source_file"), table(spark, root, "registry_field")))
    parsed = record_parse.parse(_with_headers(records, _heads(columns, "key_columns"))).filter("reason IS NULL")
    key = F.when(F.size("key_columns") > 0, F.array_join(F.transform("key_columns", lambda p: F.trim(F.try_element_at("cells", p + 1))), "\x1f"))
    return columns, scratch.write(parsed.select("file_id", "record_no", key.alias("key"), "cells"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    columns, cells = _columns_and_cells(spark, root)
    return schema_drift.schema_changes(columns, cells).select("file_id", "header", "change")


def p3_changes(spark: SparkSession, root: str) -> DataFrame:
    columns, cells = _columns_and_cells(spark, root)
    return schema_drift.schema_changes(columns, cells)


def p3_mapping(spark: SparkSession, root: str) -> DataFrame:
    """Per file: its headers with the registry fields they name, and the headers that name none."""
    records = table(spark, root, "raw_records").select("file_id", "record_no", "raw_text")
    columns = record_parse.file_headers(records, table(spark, root, "source_file"), table(spark, root, "registry_field"))
    one = columns.groupBy("file_id", "system_id", "table_name", "header").agg(F.min("field_name").alias("field_name"))
    known = F.array_sort(F.collect_list(F.when(F.col("field_name").isNotNull(), F.struct("header", "field_name"))))
    return one.groupBy("file_id", "system_id", "table_name").agg(F.map_from_entries(known).alias("header_mapping"), F.array_sort(F.collect_list(F.when(F.col("field_name").isNull(), F.col("header")))).alias("unmapped_columns"))


def p3_unified(spark: SparkSession, root: str) -> DataFrame:
    """All valid records in one consistent table per table_name, one column name per field over all files and renames."""
    columns, cells = _columns_and_cells(spark, root)
    changes = Scratch(spark, "changes").write(schema_drift.schema_changes(columns, cells))
    return schema_drift.unified(columns, changes, cells)


def p2_files(spark: SparkSession, root: str) -> DataFrame:
    """Per file: rejected_rows, up to five reject_samples (the first ones) and incomplete_last_line."""
    records = table(spark, root, "raw_records").select("file_id", "record_no", "raw_text", "line_end")
    columns = record_parse.file_headers(records, table(spark, root, "source_file"), table(spark, root, "registry_field"))
    rejects = record_parse.parse(_with_headers(records.drop("line_end"), _heads(columns)).withColumn("raw", F.col("raw_text")), with_cells=False, only_failing=True)
    first = W.partitionBy("file_id").orderBy("record_no", "raw")
    samples = rejects.withColumn("_r", F.row_number().over(first)).filter("_r <= 5").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "raw"))), lambda r: r["raw"]).alias("reject_samples"))
    counted = rejects.groupBy("file_id").agg(F.count(F.lit(1)).alias("rejected_rows"))
    last = records.groupBy("file_id").agg((F.max_by(F.coalesce("line_end", F.lit("")), "record_no") == "").alias("incomplete_last_line"))
    return last.join(counted, "file_id", "left").join(samples, "file_id", "left").select("file_id", F.coalesce("rejected_rows", F.lit(0)).alias("rejected_rows"), F.coalesce("reject_samples", F.array().cast("array<string>")).alias("reject_samples"), "incomplete_last_line")


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    """For changed findings the detail before and after."""
    findings = table(spark, root, "findings")
    changes = p4_found(spark, root).filter("change = 'changed'")
    full = snapshot_diff.changed_values(changes, findings, "run_id", _finding_keys(), "loaded_at")
    return full.select("run_id", "mandt", "finding_id", F.col("old.detail").alias("old_detail"), F.col("new.detail").alias("new_detail"), F.col("old.severity").alias("old_severity"), F.col("new.severity").alias("new_severity"))


_CELLS = """WITH cells AS (
  SELECT 'mara' AS table_name, 'matkl' AS column_name, load_id, matkl AS value, matkl IN (SELECT matkl FROM t023) AS valid FROM mara
  UNION ALL SELECT 'mara', 'meins', load_id, meins, meins IN (SELECT msehi FROM t006) FROM mara
  UNION ALL SELECT 'mara', 'ean11', load_id, ean11, regexp_matches(ean11, '^([0-9]{8}|[0-9]{12,14})$') AND list_sum([substr(ean11, i::INT, 1)::INT * CASE WHEN (length(ean11) - i) % 2 = 1 THEN 3 ELSE 1 END for i in generate_series(1, length(ean11)) if regexp_matches(ean11, '^[0-9]+$')]) % 10 = 0 FROM mara
  UNION ALL SELECT 'marc', 'dismm', load_id, dismm, regexp_matches(dismm, '^[A-Z][A-Z0-9]$') FROM marc),
marked AS (SELECT *, trim(coalesce(value, '')) <> '' AS filled FROM cells),
stats AS (SELECT table_name, column_name, load_id, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE NOT filled)::BIGINT AS n_empty, count(*) FILTER (WHERE filled)::BIGINT AS n_filled,
  count(DISTINCT CASE WHEN filled THEN value END)::BIGINT AS n_distinct, min(CASE WHEN filled THEN length(value) END)::INT AS min_length, max(CASE WHEN filled THEN length(value) END)::INT AS max_length,
  count(*) FILTER (WHERE filled AND NOT coalesce(valid, false))::BIGINT AS n_violations FROM marked GROUP BY ALL)
"""
_SHARES = _CELLS + """, shares AS (SELECT m.table_name, m.column_name, m.load_id, {what} AS what, count(*) / any_value(n_filled) AS share FROM marked m JOIN stats s ON (m.table_name, m.column_name, m.load_id) = (s.table_name, s.column_name, s.load_id) WHERE filled GROUP BY ALL),
moved AS (SELECT table_name, column_name, load_id, what, share AS d FROM shares UNION ALL SELECT table_name, column_name, load_id + 1, what, -share FROM shares),
shift AS (SELECT table_name, column_name, load_id, sum(abs(d)) / 2 AS shift FROM (SELECT table_name, column_name, load_id, what, sum(d) AS d FROM moved GROUP BY ALL) GROUP BY ALL)
"""
_MASK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g'), '[0-9]', '9', 'g'), 'A{4,}', 'A+', 'g'), 'a{4,}', 'a+', 'g'), '9{4,}', '9+', 'g')"

SQL: dict[str, str] = {
    "p4_found": """WITH f AS (SELECT run_id, coalesce(mandt, '') AS mandt, finding_id, loaded_at,
      md5(concat_ws(chr(31), coalesce(rule_id, ''), coalesce(rule_version, ''), coalesce(rule_name, ''), coalesce(category, ''), coalesce(category_label, ''), coalesce(requirement, ''), coalesce(severity, ''), coalesce(severity_rank::VARCHAR, ''),
        coalesce(object_area, ''), coalesce(object_type, ''), coalesce(object_key, ''), coalesce(bukrs, ''),
        CASE WHEN json_valid(detail) THEN list_sort([k || '=' || json_extract(detail, '$."' || k || '"')::VARCHAR for k in json_keys(detail)])::VARCHAR ELSE coalesce(detail, '') END)) AS h FROM findings),
    r AS (SELECT run_id, mandt, finding_id, arg_max(h, loaded_at) AS h FROM f GROUP BY ALL)
    SELECT coalesce(n.run_id, o.run_id + 1)::INT AS run_id, coalesce(n.mandt, o.mandt) AS mandt, coalesce(n.finding_id, o.finding_id) AS finding_id,
      CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM r n FULL JOIN r o ON n.run_id = o.run_id + 1 AND n.mandt = o.mandt AND n.finding_id = o.finding_id
    WHERE n.h IS DISTINCT FROM o.h AND coalesce(n.run_id, o.run_id + 1) BETWEEN 2 AND (SELECT max(run_id) FROM findings)""",
    "p4_values": """WITH f AS (SELECT run_id, coalesce(mandt, '') AS mandt, finding_id, loaded_at, detail, severity,
      md5(concat_ws(chr(31), coalesce(rule_id, ''), coalesce(rule_version, ''), coalesce(rule_name, ''), coalesce(category, ''), coalesce(category_label, ''), coalesce(requirement, ''), coalesce(severity, ''), coalesce(severity_rank::VARCHAR, ''),
        coalesce(object_area, ''), coalesce(object_type, ''), coalesce(object_key, ''), coalesce(bukrs, ''),
        CASE WHEN json_valid(detail) THEN list_sort([k || '=' || json_extract(detail, '$."' || k || '"')::VARCHAR for k in json_keys(detail)])::VARCHAR ELSE coalesce(detail, '') END)) AS h FROM findings),
    r AS (SELECT run_id, mandt, finding_id, arg_max({'h': h, 'd': detail, 's': severity}, loaded_at) AS x FROM f GROUP BY ALL)
    SELECT n.run_id, n.mandt, n.finding_id, o.x.d AS old_detail, n.x.d AS new_detail, o.x.s AS old_severity, n.x.s AS new_severity
    FROM r n JOIN r o ON n.run_id = o.run_id + 1 AND n.mandt = o.mandt AND n.finding_id = o.finding_id WHERE n.x.h <> o.x.h""",
    "p6_profile": _CELLS + "SELECT * FROM stats",
    "p6_mask_shift": _SHARES.replace("{what}", _MASK) + "SELECT s.table_name, s.column_name, s.load_id, round(shift, 6) AS shift FROM shift s",
    "p6_masks": _CELLS + f", m AS (SELECT table_name, column_name, load_id, {_MASK} AS mask, count(*)::BIGINT AS n_cells, count(DISTINCT value)::BIGINT AS n_values FROM marked WHERE filled GROUP BY ALL) SELECT m.*, round(n_cells / n_filled, 9) AS share, round(n_cells / n_filled, 9) < 0.01 AS is_rare FROM m JOIN stats s ON (m.table_name, m.column_name, m.load_id) = (s.table_name, s.column_name, s.load_id)",
    "p6_found": _SHARES.replace("{what}", "value")
    + """, p AS (SELECT n.table_name, n.column_name, n.load_id, shift, n.column_name = 'ean11' AS ident, n.n_filled > 0 AND o.n_filled > 0 AS both_filled,
      round(abs(n.n_empty / n.n_rows - o.n_empty / o.n_rows), 9) AS nulls, round(abs(n.n_violations / n.n_filled - o.n_violations / o.n_filled), 9) AS pattern, round(abs(n.n_distinct / n.n_filled - o.n_distinct / o.n_filled), 9) AS distinct_gap,
      n.min_length <> o.min_length OR n.max_length <> o.max_length AS moved
      FROM stats n JOIN stats o ON n.table_name = o.table_name AND n.column_name = o.column_name AND n.load_id = o.load_id + 1 LEFT JOIN shift s ON s.table_name = n.table_name AND s.column_name = n.column_name AND s.load_id = n.load_id)
    SELECT table_name, column_name, load_id, 'nulls' AS kind FROM p WHERE nulls >= 0.08
    UNION ALL SELECT table_name, column_name, load_id, 'pattern' FROM p WHERE both_filled AND pattern >= 0.06
    UNION ALL SELECT table_name, column_name, load_id, 'mix' FROM p WHERE both_filled AND NOT ident AND round(shift, 9) >= 0.2
    UNION ALL SELECT table_name, column_name, load_id, 'distinct' FROM p WHERE both_filled AND ident AND distinct_gap >= 0.1
    UNION ALL SELECT table_name, column_name, load_id, 'range' FROM p WHERE both_filled AND NOT ident AND moved""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
