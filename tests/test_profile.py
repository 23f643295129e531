from pyspark.sql import functions as F

from stammwerk.operators import column_profile as cp


def test_mask_and_gtin(spark):
    df = spark.createDataFrame([("AB12-x",), ("ABCDEF12345",), ("äÖ ",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(cp.mask(F.col("v"))).collect()] == ["AA99-a", "A+9+", "aA ", "", None]
    codes = spark.createDataFrame([("4006381333931",), ("4006381333932",), ("96385074",), ("123",), ("",), (None,), (" 96385074",), ("a6385074",)], "v string")
    assert [r[0] for r in codes.select(cp.gtin_valid(F.col("v"))).collect()] == [True, False, True, False, False, False, False, False]


def prepared(spark, rows):
    df = spark.createDataFrame(rows, "load int, a string, n string, load_id string")
    counts = cp.value_counts(df, "t", ["a", "n"], "load")
    return cp.with_marks(counts, F.col("value").rlike("^[A-Z]+$"))


def test_departures(spark):
    base = [(1, "AB", str(i), "clash") for i in range(90)] + [(1, None, str(i), None) for i in range(10)]
    more = [(2, "ab", "1", "x") for _ in range(50)] + [(2, "AB", str(i), "x") for i in range(30)] + [(2, " ", None, "x") for _ in range(20)]
    found = {(r.column_name, r.load_id, r.kind) for r in cp.departures(prepared(spark, base + more), ["n"]).collect()}
    assert found == {("a", 2, "nulls"), ("a", 2, "pattern"), ("a", 2, "mix"), ("n", 2, "nulls"), ("n", 2, "distinct")}
    assert cp.departures(prepared(spark, base + [(3, "x" * 50, None, None)]), ["n"]).count() == 0  # load 2 is missing
    exact = [(1, "AB", "1", "") for _ in range(100)] + [(2, "AB", "1", "") for _ in range(92)] + [(2, "", "1", "") for _ in range(8)]
    assert ("a", 2, "nulls") in {(r.column_name, r.load_id, r.kind) for r in cp.departures(prepared(spark, exact), ["n"]).collect()}
    assert cp.departures(prepared(spark, base).limit(0), ["n"]).count() == 0


def test_range_and_masks(spark):
    counts = prepared(spark, [(1, "AB", None, ""), (2, "ABCDE", None, ""), (2, "AB", None, ""), (2, "AB", None, "")])
    assert ("a", 2, "range") in {(r.column_name, r.load_id, r.kind) for r in cp.departures(counts, []).collect()}
    masks = {(r.load_id, r["mask"], r.n_cells, r.is_rare) for r in cp.mask_profile(counts, 0.5).collect()}
    assert masks == {(1, "AA", 1, False), (2, "AA", 2, False), (2, "A+", 1, True)}


def test_conforming_masks_and_bound(spark):
    listed = spark.createDataFrame([("a", "AB1"), ("a", "CD2"), ("n", "x")], "column_name string, value string")
    assert {tuple(r) for r in cp.mined_masks(listed).collect()} == {("a", "AA9"), ("n", "a")}
    counted = spark.createDataFrame([("a", "AB1", 95), ("a", "zz", 5), ("a", " ", 50)], "column_name string, value string, n long")
    assert [tuple(r) for r in cp.mined_masks(counted, 0.1).collect()] == [("a", "AA9")]
    rows = [(1, "AB1", None, "") for _ in range(8)] + [(1, "ab1", None, ""), (1, None, None, "")] + [(2, "CD2", None, "") for _ in range(8)] + [(2, "AB1", None, "")]
    df = spark.createDataFrame(rows, "load int, a string, n string, load_id string")
    counts = cp.with_marks(cp.value_counts(df, "t", ["a", "n"], "load"), F.lit(True), cp.mined_masks(listed))
    assert {(r.load_id, r.n_violations) for r in cp.profile(counts).filter("column_name = 'a'").collect()} == {(1, 1), (2, 0)}
    found = {(r.column_name, r.load_id, r.kind) for r in cp.departures(counts, []).collect()}
    assert found == {("a", 2, "nulls"), ("a", 2, "pattern"), ("a", 2, "mix")}  # the masks differ by 0.11, the values by far more
