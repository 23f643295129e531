from pyspark.sql import functions as F

from stammwerk.operators import snapshot_diff as sd

def keys():
    return {"mandt": F.coalesce(F.col("mandt"), F.lit("")), "id": F.col("id")}


SCHEMA = "run int, mandt string, id string, note string, detail string, at int, _run string"


def changes(df):
    return sorted(tuple(r) for r in sd.snapshot_changes(df, "run", keys(), "at", ["mandt", "id"], ["detail"]).collect())


def test_changes(spark):
    rows = [
        (1, None, "a", None, '{"x": 1, "y": [1, 2]}', 1, "p"), (2, "", "a", "", '{"y":[1,2],"x":1}', 1, "p"),  # same: null and empty, layout and order
        (1, "1", "b", "old", "{}", 1, "p"), (2, "1", "b", "mid", "{}", 1, "p"), (2, "1", "b", "new", "{}", 2, "p"), (3, "1", "b", "new", "{}", 1, "p"),  # superseded row does not count
        (1, "1", "c", "x", "no json", 1, "p"), (3, "1", "c", "x", "no json", 1, "p"), (2, "2", "b", "x", None, 1, "p"), (2, "2", "b", "x", None, 1, "p"), (5, "9", "z", None, None, 1, "p"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = [(2, "1", "b", "changed"), (2, "1", "c", "removed"), (2, "2", "b", "added"), (3, "", "a", "removed"), (3, "1", "c", "added"), (3, "2", "b", "removed")]
    assert changes(df) == expected and changes(df.repartition(4)) == expected
    assert changes(df.limit(0)) == []


def test_one_hot_key_and_ties(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("run"), F.lit("1").alias("mandt"), F.lit("k").alias("id"), (F.col("id") % 7).cast("string").alias("note"), F.lit(None).cast("string").alias("detail"), F.lit(1).alias("at"), F.lit("").alias("_run"))
    assert changes(df) == []  # equal versions: the same row of each run counts, whatever the order


def test_values_of_changes(spark):
    df = spark.createDataFrame([(1, "1", "b", "old", "{}", 1, "p"), (2, "1", "b", "new", "{}", 1, "p"), (1, "1", "c", "gone", "{}", 1, "p"), (1, None, "d", None, None, 1, "p"), (2, None, "d", "x", None, 1, "p")], SCHEMA)
    full = sd.changed_values(sd.snapshot_changes(df, "run", keys(), "at", ["mandt", "id"], ["detail"]), df, "run", keys(), "at")
    assert sorted((r.id, r.change, r.old.note if r.old else None, r.new.note if r.new else None) for r in full.collect()) == [("b", "changed", "old", "new"), ("c", "removed", "gone", None), ("d", "changed", None, "x")]


def test_a_new_snapshot_reads_only_itself_and_the_index(spark, tmp_path):
    day = lambda rows: spark.createDataFrame([(1, m, i, n, "{}", 1, "p") for m, i, n in rows], SCHEMA).drop("run")
    open_index = lambda: sd.SnapshotIndex(spark, str(tmp_path / "ix"), keys(), "at", ["mandt", "id"], ["detail"], buckets=3)
    for name, rows in (("d1", [("1", "a", "x"), (None, "b", "y"), ("1", None, "n")]), ("d2", [("1", "a", "z"), ("1", "c", "x"), ("1", None, "n")]), ("d3", [])):
        day(rows).write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert open_index().advance(read("d1"), "d1") is None
    first = open_index().in_force()
    changes = open_index().advance(read("d2"), "d2")  # another object, as in a later session
    assert sorted((tuple(r) for r in changes.collect()), key=repr) == [("", "b", "removed"), ("1", "a", "changed"), ("1", "c", "added")]
    assert {f.split("/")[-2] for f in changes.inputFiles()} == {first["place"].split("/")[-1], open_index().in_force()["place"].split("/")[-1]}
    assert "Exchange" not in changes._jdf.queryExecution().executedPlan().toString()  # bucket by bucket
    open_index().forget(first)
    assert sorted(r.change for r in open_index().advance(read("d3"), "d3").collect()) == ["removed"] * 3 and open_index().in_force()["label"] == "d3"
