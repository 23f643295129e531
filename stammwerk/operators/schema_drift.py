"""Schema changes between the consecutive files of a series, and one consistent table out of all of them.

Every column of a file gets a profile: its normalised name, the registry field it names, how its filled cells divide
over the forms (digits, date with separators, number with a mark, text), and a value sketch: the hashed cells of the records whose
hashed key falls under SKETCH / n of the hash range, n being the records of the file. The samples of two files are coordinated, so their common part
is a sample of the records that both hold; a file of up to SKETCH records is held whole and its sketch is exact.

A header that is gone and one that is new are the two sides of a bipartite graph per pair of files. An edge is a common registry
field, or sketches that agree for most common records. Where a sketch is only a sample, a pair is dropped when at least SURE
sampled records agree in less than DOUBT of the cases (a pair that agrees for half of all records gets there with a chance under 1e-4);
all others are then counted exactly on all common records, because "most" has to be exact. Similarity of the names and equal forms decide between edges of equal
agreement. The matching of greatest weight gives the renames; what stays unmatched is removed or added.

Hot files and series: cells join their file's profile in splits, and are combined per (file, column) and per (pair, key) before the exchange.

Nulls: files without a header record take no part; a null system_id is a series of its own. A header repeated in a file
counts once (its first position). Columns without filled cells have no form and are never retyped. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stammwerk.operators.skew import hot_keys, salted_join
from stammwerk.session import Scratch

FORMS = ["digits", "date", "number"]
#: Expected number of records in a value sketch, and when a sampled agreement is low beyond doubt.
SKETCH, SURE, DOUBT = 256, 128, 0.3


def form(value: Column) -> Column:
    """The form of a filled cell without blanks around it."""
    number = r"^(?:[+-]?(?:[0-9]+[.,][0-9]*|[.,][0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]*)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?)|(?:[0-9]+[.,][0-9]*|[.,][0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]*)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?)[+-])\z"
    return (
        F.when(value.rlike(r"^[0-9]+\z"), "digits")
        .when(~value.rlike(r"^[0-9.,+-]+\z"), "text")  # most texts end here
        .when(value.rlike(r"^(?:[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\z"), "date")
        .when(value.rlike(number), "number")
        .otherwise("text")
    )


def file_order(columns: DataFrame) -> DataFrame:
    """(file_id, prev_file_id) along each series; the window holds one narrow row per file and spills."""
    files = columns.select("system_id", "file_id", "extraction_date").distinct()
    order = W.partitionBy("system_id").orderBy("extraction_date", "file_id")
    return files.select("file_id", F.lag("file_id").over(order).alias("prev_file_id")).filter("prev_file_id IS NOT NULL")


def column_forms(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """(file_id, name, form) of the columns with filled cells; cells is (file_id, cells) of valid records."""
    each = cells.select("file_id", F.posexplode("cells").alias("pos", "value")).withColumn("value", F.trim("value")).filter("value <> ''")
    counted = each.groupBy("file_id", "pos", form(F.col("value")).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    kinds = counted.groupBy("file_id", "pos").agg(F.sum("n").alias("n"), F.max(F.struct(F.col("n").alias("m"), "form")).alias("_m"))
    best = F.when(F.col("_m.m") * 2 > F.col("n"), F.col("_m.form")).otherwise("text")
    return kinds.select("file_id", "pos", best.alias("form")).join(columns.select("file_id", "pos", "name"), ["file_id", "pos"]).select("file_id", "name", "form")


def assign(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The matching of greatest total weight between two small sets of names (columns of two files); ties by name."""
    left, right = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    swap = len(left) > len(right)
    if swap:
        left, right = right, left
    weight = {(b, a) if swap else (a, b): w for a, b, w in edges}
    n, m = len(left), len(right)
    cost = [[-weight.get((a, b), 0.0) for b in right] for a in left]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)  # potentials and the row matched with each column, from 1
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            row, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(left[match[j] - 1], right[j - 1]) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if swap else (a, b) for a, b in pairs if weight.get((a, b), 0.0) > 0)


def _match(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in groups:
        made = [(f, old, new) for f, rows in zip(part.file_id, part.edges, strict=True) for old, new in assign([(e["old"], e["new"], e["weight"]) for e in rows])]
        yield pd.DataFrame(made, columns=["file_id", "old", "new"]).astype({"file_id": "int64"})


def header_changes(columns: DataFrame, order: DataFrame) -> DataFrame:
    """One row per pair of files and name: old and new (structs of pos and field_name; null where missing)."""
    named = columns.groupBy("file_id", "name").agg(F.min(F.struct("pos", "field_name")).alias("c"))
    nothing = F.lit(None)
    here = order.join(named, "file_id").select("file_id", "prev_file_id", "name", F.col("c").alias("new"), nothing.cast(named.schema["c"].dataType).alias("old"))
    before = order.join(named.withColumnRenamed("file_id", "prev_file_id"), "prev_file_id").select("file_id", "prev_file_id", "name", nothing.cast(named.schema["c"].dataType).alias("new"), F.col("c").alias("old"))
    return here.unionByName(before).groupBy("file_id", "prev_file_id", "name").agg(F.max("new").alias("new"), F.max("old").alias("old"))


def _cell(pos: Column) -> Column:
    return F.nullif(F.trim(F.try_element_at("cells", pos + 1)), F.lit(""))


def _drawn(key: Column, size: int) -> Column:
    """Whether a hashed key lies in the part of the hash range that holds about `size` of n records."""
    return F.pmod(key, F.lit(1 << 40)) / float(1 << 40) * F.col("n") < size


def sketches(wanted: DataFrame, cells: DataFrame, size: int = SKETCH) -> DataFrame:
    """(file_id, pos, n, sample): the value sketch of the columns in wanted (file_id, pos); n records of the file have a key.

    sample holds (k, v), the hashes of key and cell, of about `size` records, all of them in a smaller file. Of several records under one key the
    greatest cell counts."""
    rows = cells.filter("key IS NOT NULL")
    sized = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    need = wanted.groupBy("file_id").agg(F.collect_set("pos").alias("places")).join(sized, "file_id")
    key = F.xxhash64("key")
    drawn = salted_join(rows.select("file_id", "key", "cells"), need, "file_id", hot_keys(rows, "file_id"), key).filter(_drawn(key, size))
    each = drawn.select("file_id", "n", key.alias("k"), F.explode(F.transform("places", lambda p: F.struct(p.alias("pos"), _cell(p).alias("value")))).alias("_c")).select("file_id", "n", "k", "_c.*").filter("value IS NOT NULL")
    one = each.groupBy("file_id", "pos", "n", "k").agg(F.max("value").alias("value"))
    return one.groupBy("file_id", "pos", "n").agg(F.collect_list(F.struct("k", F.xxhash64("value").alias("v"))).alias("sample"))


def sketched_agreement(candidates: DataFrame, cells: DataFrame, size: int = SKETCH) -> DataFrame:
    """candidates plus n_common, n_equal and exact, from the sketches; pairs without a common record with both cells filled are missing."""
    wanted = candidates.select(F.inline(F.array(F.struct(F.col("file_id"), F.col("new_pos").alias("pos")), F.struct(F.col("prev_file_id").alias("file_id"), F.col("old_pos").alias("pos"))))).distinct()
    drawn = sketches(wanted, cells, size)
    new = drawn.select("file_id", F.col("pos").alias("new_pos"), F.col("n").alias("n_new"), F.col("sample").alias("b"))
    old = drawn.select(F.col("file_id").alias("prev_file_id"), F.col("pos").alias("old_pos"), F.col("n").alias("n_old"), F.col("sample").alias("a"))
    both = candidates.join(new, ["file_id", "new_pos"]).join(old, ["prev_file_id", "old_pos"]).withColumn("n", F.greatest("n_new", "n_old"))
    inside = lambda c: F.filter(c, lambda e: _drawn(e["k"], size))
    both = both.withColumn("a", inside("a")).withColumn("b", inside("b"))
    common = F.size(F.array_intersect(F.transform("a", lambda e: e["k"]), F.transform("b", lambda e: e["k"])))
    counted = both.withColumn("n_common", common).withColumn("n_equal", F.size(F.array_intersect("a", "b"))).withColumn("exact", F.col("n") <= size)
    return counted.filter("NOT exact OR n_common > 0").drop("a", "b", "n", "n_new", "n_old")


def agreement(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """candidates plus n_common and n_equal over the records that both files hold under the same key, both cells filled.

    candidates: file_id, prev_file_id, old, new (names), old_pos, new_pos; cells: file_id, key, cells of valid records."""
    ids = ["file_id", "prev_file_id", "old", "new"]
    rows = cells.filter("key IS NOT NULL").select(F.col("file_id").alias("_f"), "key", "cells")
    ask = lambda f, p, new: F.struct(F.col(f).alias("_f"), F.struct(*ids, F.col(p).alias("pos"), F.lit(new).alias("new_side")).alias("q"))
    asked = candidates.select(F.inline(F.array(ask("file_id", "new_pos", True), ask("prev_file_id", "old_pos", False)))).groupBy("_f").agg(F.collect_list("q").alias("asked"))
    met = salted_join(rows, asked, "_f", hot_keys(rows, "_f"), F.col("key")).select("key", "cells", F.inline("asked")).withColumn("value", _cell(F.col("pos")))
    per_key = met.groupBy(*ids, "key").agg(F.max(F.when(F.col("new_side"), F.col("value"))).alias("a"), F.max(F.when(~F.col("new_side"), F.col("value"))).alias("b"))
    return per_key.groupBy(*ids).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


def schema_changes(columns: DataFrame, cells: DataFrame, size: int = SKETCH) -> DataFrame:
    """(file_id, header, change, old_header): added, removed, renamed and retyped columns of each file against the one before.

    columns as from record_parse.file_headers; cells: file_id, key, cells of the valid records; size: records in a value sketch."""
    scratch = Scratch(columns.sparkSession, "changes")
    order = file_order(columns)
    names = scratch.write(header_changes(columns, order))
    forms = scratch.write(column_forms(columns, cells.select("file_id", "cells")))
    gone = names.filter("new IS NULL").select("file_id", "prev_file_id", F.col("name").alias("old"), F.col("old.pos").alias("old_pos"), F.col("old.field_name").alias("old_field"))
    fresh = names.filter("old IS NULL").select("file_id", F.col("name").alias("new"), F.col("new.pos").alias("new_pos"), F.col("new.field_name").alias("new_field"))
    candidates = gone.join(fresh, "file_id").withColumn("same_field", F.coalesce(F.col("old_field") == F.col("new_field"), F.lit(False)))
    ids = ["file_id", "prev_file_id", "old", "new"]
    sketched = scratch.write(sketched_agreement(candidates.filter("NOT same_field").select(*ids, "old_pos", "new_pos"), cells, size))
    counted = sketched.filter("exact").select(*ids, "n_common", "n_equal")
    sampled = sketched.filter(f"NOT exact AND NOT (n_common >= {SURE} AND n_equal < {DOUBT} * n_common)")
    if not sampled.isEmpty():
        counted = counted.unionByName(agreement(sampled.select(*ids, "old_pos", "new_pos"), cells))
    form_of = lambda side, f: forms.select(F.col("file_id").alias(f), F.col("name").alias(side), F.col("form").alias(f"{side}_form"))
    alike = 1 - F.levenshtein("old", "new") / F.greatest(F.length("old"), F.length("new"), F.lit(1))
    same_form = F.coalesce((F.col("old_form") == F.col("new_form")).cast("double"), F.lit(0.0))
    likely = counted.filter("n_equal * 2 > n_common").join(form_of("old", "prev_file_id"), ["prev_file_id", "old"], "left").join(form_of("new", "file_id"), ["file_id", "new"], "left")
    weight = 1.0 + F.col("n_equal") / F.col("n_common") + (alike + same_form) / 1e8 + F.col("n_common") / 1e12
    edges = candidates.filter("same_field").select("file_id", F.struct("old", "new", F.lit(10.0).alias("weight")).alias("e")).unionByName(likely.select("file_id", F.struct("old", "new", weight.alias("weight")).alias("e")))
    renamed = scratch.write(edges.groupBy("file_id").agg(F.collect_list("e").alias("edges")).mapInPandas(_match, "file_id long, old string, new string"))
    columns_left = names.select("file_id", "name", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").alias("change")).filter("change IS NOT NULL")
    taken = renamed.select("file_id", F.inline(F.array(F.struct(F.col("new").alias("name"), F.lit("added").alias("change"), F.col("old").alias("old_header")), F.struct(F.col("old").alias("name"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("old_header")))))
    moved = columns_left.join(taken.withColumn("_t", F.lit(True)), ["file_id", "name", "change"], "left")
    by_name = moved.filter("_t IS NULL OR old_header IS NOT NULL").select("file_id", F.col("name").alias("header"), F.when(F.col("_t"), "renamed").otherwise(F.col("change")).alias("change"), "old_header")
    kept = names.filter("old IS NOT NULL AND new IS NOT NULL").select("file_id", "prev_file_id", F.col("name").alias("old"), F.col("name").alias("new"))
    both = kept.unionByName(renamed.join(order, "file_id").select("file_id", "prev_file_id", "old", "new"))
    typed = both.join(form_of("new", "file_id"), ["file_id", "new"]).join(form_of("old", "prev_file_id"), ["prev_file_id", "old"])
    retyped = typed.filter("new_form <> old_form").select("file_id", F.col("new").alias("header"), F.lit("retyped").alias("change"), F.when(F.col("old") != F.col("new"), F.col("old")).alias("old_header"))
    return by_name.unionByName(retyped)


def canonical_names(columns: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, pos, name, canonical): the registry field where known, else what the column was called when it first came, over all renames.

    Each column points to itself in the file before (under its old name); pointers are halved round by round, so a series of n files takes
    about log n rounds."""
    scratch = Scratch(columns.sparkSession, "names")
    first = columns.groupBy("file_id", "name").agg(F.min("pos").alias("pos"), F.min("field_name").alias("field_name"))
    renamed = changes.filter("change = 'renamed'").select("file_id", F.col("header").alias("name"), "old_header")
    back = first.join(file_order(columns), "file_id", "left").join(renamed, ["file_id", "name"], "left").withColumn("old", F.coalesce("old_header", "name"))
    there = first.select(F.col("file_id").alias("prev_file_id"), F.col("name").alias("old"), F.lit(True).alias("_there"))
    linked = back.join(there, ["prev_file_id", "old"], "left")
    ends = F.col("field_name").isNotNull() | F.col("_there").isNull()
    here = F.struct(F.col("file_id").alias("f"), F.col("name").alias("n"))
    nodes = scratch.write(linked.select("file_id", "name", "pos", F.coalesce("field_name", "name").alias("title"), F.when(ends, here).otherwise(F.struct(F.col("prev_file_id").alias("f"), F.col("old").alias("n"))).alias("to")))
    while True:
        step = nodes.select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), F.col("to").alias("_next"), F.col("title").alias("_title"))
        joined = nodes.join(step, (F.col("to.f") == F.col("_f")) & (F.col("to.n") == F.col("_n")))
        moved = scratch.write(joined.select("file_id", "name", "pos", "title", F.col("_next").alias("to"), F.col("_title").alias("canonical"), (F.col("_next") != F.col("to")).alias("_moved")))
        if moved.filter("_moved").isEmpty():
            return moved.select("file_id", "pos", "name", "canonical")
        nodes = moved.select("file_id", "name", "pos", "title", "to")


def unified(columns: DataFrame, changes: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_name, file_id, record_no, fields): every valid record as a map from canonical name to cell; blank cells are null.

    A second column of a file with the same canonical name is left to the first one. cells: file_id, record_no, cells."""
    tables = columns.groupBy("file_id").agg(F.min("table_name").alias("table_name"))
    one = canonical_names(columns, changes).groupBy("file_id", "canonical").agg(F.min("pos").alias("pos"))
    heads = one.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("_c")).join(tables, "file_id")
    rows = salted_join(cells, heads, "file_id", hot_keys(cells, "file_id"), F.col("record_no"))
    value = lambda p: F.nullif(F.trim(F.try_element_at("cells", p + 1)), F.lit(""))
    return rows.select("table_name", "file_id", "record_no", F.map_from_arrays(F.transform("_c", lambda c: c["canonical"]), F.transform("_c", lambda c: value(c["pos"]))).alias("fields"))
