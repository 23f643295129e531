"""Changes between consecutive full snapshots of a table.

`SnapshotIndex` keeps an index of the last snapshot in a folder: one entry per key, its value a 128-bit hash of the row, in buckets of the
key's hash. A new snapshot is reduced to such entries, combined before the one exchange, and written into the same buckets; it then probes
the kept index bucket by bucket, without another exchange, and takes its place (the swap is one small file that names the index in
force). So adding a snapshot reads that snapshot and the kept index, never an older snapshot. Old and new values are fetched only for the keys that
changed (`changed_values`).

Nulls: key columns compare as given by `keys` (null keys are keys); null and empty text are one value in the hash. Repeated
rows of a snapshot: the one with the greatest version counts; among equal versions the greatest hash, so the result does
not depend on order. An empty table gives no rows; an empty snapshot removes all keys. `snapshot_changes` compares a run only if the run before it is in
the table. Extra columns take part in the comparison unless named in `ignore`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.session import Scratch, _delete, read_text, write_text

#: Snapshots of one table whose indexes are built side by side.
AT_ONCE = 4


def canonical_json(text: Column) -> Column:
    """The JSON text without its layout: keys sorted, no blanks; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def _comparable(df: DataFrame, name: str, json_cols: Sequence[str]) -> Column:
    column = F.col(f"`{name}`")
    if name in json_cols:
        column = canonical_json(column)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.lit(""))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.to_json(F.array_sort(F.map_entries(column))), F.lit(""))
    return F.coalesce(column.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType)) else F.to_json(column), F.lit(""))


_ZERO = {T.StringType: "", T.BinaryType: "", T.BooleanType: "false", T.DateType: "1970-01-01", T.TimestampType: "1970-01-01", T.TimestampNTZType: "1970-01-01"}


def _flag(name: str) -> str:
    return f"_null_{name}"


def snapshot_entries(df: DataFrame, keys: dict[str, Column], version: str, ignore: Sequence[str] = (), json_cols: Sequence[str] = ()) -> DataFrame:
    """(*keys, *flags, h1, h2): one row per key of a snapshot, with the hashes of the row that counts.

    A null key is stored as its type's zero with the flag set, so that keys join by plain equality, which buckets serve."""
    skip = {version, *ignore}
    values = [_comparable(df, name, json_cols) for name in df.columns if name not in skip]
    body = F.struct(F.col(f"`{version}`").alias("version"), F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(7919), *values).alias("h2"))
    kinds = df.select(*(column.alias(name) for name, column in keys.items())).schema
    filled = [F.coalesce(column, F.lit(_ZERO.get(type(kinds[name].dataType), "0")).cast(kinds[name].dataType)).alias(name) for name, column in keys.items()]
    flags = [column.isNull().alias(_flag(name)) for name, column in keys.items()]
    names = [*keys, *map(_flag, keys)]
    return df.select(*filled, *flags, body.alias("_entry")).groupBy(*names).agg(F.max("_entry").alias("_entry")).select(*names, "_entry.h1", "_entry.h2")


class SnapshotIndex:
    """The kept index of a table that is delivered in full snapshots."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, Column], version: str, ignore: Sequence[str] = (), json_cols: Sequence[str] = (), buckets: int | None = None):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.version, self.ignore, self.json_cols = version, ignore, json_cols
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _stored(self) -> list[str]:
        return [*self.keys, *map(_flag, self.keys)]

    def in_force(self) -> dict | None:
        """label, place, buckets and schema of the kept index."""
        text = read_text(self.spark, f"{self.folder}/current.json")
        return json.loads(text) if text else None

    def _read(self, state: dict) -> DataFrame:
        """A bucketed read; the catalogue entry that Spark needs for it lasts for the moment of reading."""
        schema = T.StructType.fromJson(state["schema"])
        name, columns = f"stammwerk_index_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(f"`{k}`" for k in self._stored())
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {state['buckets']} BUCKETS LOCATION '{state['place']}'")
        try:
            return self.spark.table(name).select("*")
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files are not the catalogue's and stay

    def build(self, snapshot: DataFrame, label: str) -> dict:
        """Writes the index of a snapshot beside the one in force and returns its state; nothing is swapped yet."""
        kept = self.in_force()
        buckets = kept["buckets"] if kept else self.buckets
        entries = snapshot_entries(snapshot, self.keys, self.version, self.ignore, self.json_cols)
        place, name = f"{self.folder}/{uuid.uuid4().hex[:12]}", f"stammwerk_index_{uuid.uuid4().hex}"
        entries.write.format("parquet").bucketBy(buckets, *self._stored()).option("path", place).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return {"label": label, "place": place, "buckets": buckets, "schema": entries.schema.jsonValue()}

    def swap(self, state: dict) -> DataFrame | None:
        """Probes the index in force with a built one, which takes its place; null for the first one."""
        before = self.in_force()
        changes = self._compared(state, before) if before else None
        write_text(self.spark, f"{self.folder}/current.json", json.dumps(state))
        return changes

    def advance(self, snapshot: DataFrame, label: str) -> DataFrame | None:
        """Takes the snapshot in and returns (*keys, change) against the one in force before, null for the first one.

        change is added, removed or changed. The index before stays until `forget`, as the result reads it."""
        return self.swap(self.build(snapshot, label))

    def _compared(self, now: dict, before: dict) -> DataFrame:
        new, old = self._read(now), self._read(before)
        same = reduce(Column.__and__, (F.col(f"n.{k}") == F.col(f"o.{k}") for k in self._stored()))
        change = F.when(F.col("o.h1").isNull(), "added").when(F.col("n.h1").isNull(), "removed").when((F.col("n.h1") != F.col("o.h1")) | (F.col("n.h2") != F.col("o.h2")), "changed")
        key = [F.when(~F.coalesce(F.col(f"n.{_flag(k)}"), F.col(f"o.{_flag(k)}")), F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}"))).alias(k) for k in self.keys]
        return new.alias("n").join(old.alias("o"), same, "full").select(*key, change.alias("change")).filter("change IS NOT NULL")

    def forget(self, state: dict) -> None:
        """Deletes an index that is no longer in force and that no result has to read any more."""
        if state["place"] != (self.in_force() or {}).get("place"):
            _delete(self.spark, state["place"])


def snapshot_changes(df: DataFrame, run: str, keys: dict[str, Column], version: str, ignore: Sequence[str] = (), json_cols: Sequence[str] = ()) -> DataFrame:
    """(run, *keys, change) for each run whose predecessor is there: every run is read once into an index, and the indexes probe and replace
    one another in the order of the runs. A few are built at a time, so that small runs do not wait for one another."""
    spark = df.sparkSession
    index = SnapshotIndex(spark, Scratch(spark, "index").path, keys, version, [run, *ignore], json_cols)
    runs = sorted(r[0] for r in df.select(F.col(f"`{run}`")).distinct().collect() if r[0] is not None)  # one value per delivery
    with ThreadPoolExecutor(AT_ONCE) as pool:
        built = list(pool.map(lambda number: index.build(df.filter(F.col(f"`{run}`") == number), str(number)), runs))
    parts, last = [], None
    for number, state in zip(runs, built, strict=True):
        changes = index.swap(state)
        if changes is not None and last == number - 1:
            parts.append(changes.select(F.lit(number).cast(df.schema[run].dataType).alias(run), *keys, "change"))
        last = number
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return df.select(F.col(f"`{run}`").alias(run), *(c.alias(n) for n, c in keys.items()), F.lit("").alias("change")).limit(0)


def changed_values(changes: DataFrame, df: DataFrame, run: str, keys: dict[str, Column], version: str) -> DataFrame:
    """For rows of `changes` the old and the new row as structs (`old`, `new`; null where there is none)."""
    names = list(keys)
    rows = df.select(F.col(f"`{run}`").alias("_run"), *(c.alias(n) for n, c in keys.items()), F.struct(F.col(f"`{version}`").alias("_version"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")).alias("_e"))
    wanted = changes.select(F.col(run).alias("_run"), *names, "change")
    both = wanted.select(*names, F.col("_run").alias("_at"), "change", F.explode(F.array(F.col("_run"), F.col("_run") - 1)).alias("_run"))
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"w.{n}")) for n in names] + [F.col("r._run") == F.col("w._run")]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    found = both.alias("w").join(rows.alias("r"), condition, "left").select(*(F.col(f"w.{n}") for n in names), "w._at", "w.change", F.col("w._run").alias("_run"), "r._e")
    return found.groupBy(*names, "_at", "change").agg(
        F.max(F.when(F.col("_run") == F.col("_at") - 1, F.col("_e"))).alias("_o"), F.max(F.when(F.col("_run") == F.col("_at"), F.col("_e"))).alias("_n")
    ).select(F.col("_at").alias(run), *names, "change", F.col("_o._row").alias("old"), F.col("_n._row").alias("new"))
