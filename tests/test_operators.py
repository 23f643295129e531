import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stammwerk.functions import names
from stammwerk.operators import delivery, duplicates, findings
from stammwerk.operators.skew import hot_keys, pairs_within, salted_join

FACTS = {"rule_id": "R-X-001", "rule_version": "1", "rule_name": "n", "category": "risk", "severity": "high", "object_area": "a", "object_type": "t"}


def test_salted_join_equals_join(spark, rows):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = spark.createDataFrame([(7, "a"), (7, "b"), (1, "c"), (None, "d")], "k long, y string")
    hot = hot_keys(big, "k", least=1000)
    assert [r.k for r in hot.collect()] == [7]
    assert rows(salted_join(big, small, "k", hot, F.col("x"))) == rows(big.join(small, "k"))
    assert salted_join(big, small, "k", hot, F.col("x"), "left").count() == big.join(small, "k", "left").count()
    assert salted_join(big.limit(0), small, "k", hot_keys(big.limit(0), "k"), F.col("x")).count() == 0


@pytest.mark.parametrize("cell", [4, 1000])
def test_pairs_within_equal_all_pairs(spark, cell):
    items = [(g, i) for g, n in (("a", 40), ("b", 1), ("c", 2), ("d", 9)) for i in range(n)] + [("a", None), (None, 5), (None, 6)]
    df = spark.createDataFrame(items, "g string, i int")
    got = [tuple(r) for r in pairs_within(df, ["g"], "i", cell).collect()]
    assert sorted(got) == sorted((g, i, j) for g, n in (("a", 40), ("c", 2), ("d", 9)) for i, j in combinations(range(n), 2))
    assert pairs_within(df.limit(0), ["g"], "i", cell).count() == 0


@pytest.mark.parametrize("cell", [3, 2000])
def test_fuzzy_pairs_equal_brute_force(spark, cell):
    people = [(f"{i:02}", n, a, b) for i, (n, a, b) in enumerate([("ALPHA BETA", "HAUPT 1", "x"), ("BETA ALPHA", "", "x"), ("ALPHA BETTA", "HAUPT 1", "x"), ("GAMMA", "WEG 2", "x"), ("GAMMAS", "WEG 2", "x"), ("DELTA", None, "x"), ("DELTA", None, None), ("", "HAUPT 1", "x"), ("ALPHA", "HAUPT 1", "x"), ("ALPHA BETA", "HAUPT 1", "")])]
    df = spark.createDataFrame(people, "k string, n string, a string, blk string")
    got = {(r.left, r.right, r.score) for r in duplicates.fuzzy_pairs(df, "k", "n", "a", ["blk"], cell=cell).collect()}
    expected = set()
    for (k1, n1, a1, b1), (k2, n2, a2, b2) in combinations(people, 2):
        if b1 and b1 == b2:
            s = int(names.token_sort_ratio(n1, n2) + 0.5)
            t = int(names.token_sort_ratio(a1, a2) + 0.5) if a1 and a2 else None
            if s >= 88:
                expected.add((k1, k2, s))
            elif s >= 70 and t is not None and 0.65 * s + 0.35 * t >= 85:
                expected.add((k1, k2, int(0.65 * s + 0.35 * t + 0.5)))
    assert got == expected and got


def test_dup_fuzzy_compares_inside_all_blocks(spark, tmp_path):
    from stammwerk.plans import reference

    rng = random.Random(3)
    stems = ["Dadrelkazig", "Bomunderov", "Ulsornnehof", "Gropellaeck" * 7]
    people = [("a", "Zander Kaltwalz", "Weg 1", None, "Bonn", "DE"), ("b", "Zander Kaltwals", None, "11111", "Köln", "DE"), ("c", "Kaltwalz Zander", None, None, None, None), ("d", "Kaltwalz", "Weg 1", "11112", "Bonn", "AT")]
    for i in range(150):
        stem = rng.choice(stems)
        at = rng.randrange(1, 9)
        people.append((f"k{i:03}", f"{stem[:at]}{rng.choice(['', 'x'])}{stem[at:]} {rng.choice(['Spedition', 'Logistik', 'Metallbau'])} GmbH", rng.choice([None, "Weg 1", "Gartenstr. 7"]), rng.choice([None, "11111", "22222"]), rng.choice([None, "Bonn", "Köln"]), rng.choice([None, "DE", "DE", "AT"])))
    spark.createDataFrame(people, "schluessel string, name string, stras string, plz string, ort string, land string").write.parquet(f"{tmp_path}/candidates.parquet")
    keys = names.block_keys(F.col("name"), F.col("land"), F.col("plz"), F.col("ort"))
    rows = spark.read.parquet(f"{tmp_path}/candidates.parquet").select("schluessel", names.norm_name(F.col("name")), names.norm_address(F.col("stras"), F.col("plz"), F.col("ort")), *keys.values()).collect()
    expected = set()
    for x, y in combinations(sorted(rows), 2):
        if any(a and a == b for a, b in zip(x[3:], y[3:], strict=True)):
            s, t = (int(names.token_sort_ratio(x[c], y[c]) + 0.5) for c in (1, 2))
            if s >= 88:
                expected.add((x[0], y[0], s))
            elif s >= 70 and x[2] and y[2] and 0.65 * s + 0.35 * t >= 85:
                expected.add((x[0], y[0], int(0.65 * s + 0.35 * t + 0.5)))
    got = [(r.left, r.right, r.score) for r in reference.dup_fuzzy(spark, str(tmp_path)).collect()]
    assert set(got) == expected and len(got) == len(expected) > 500
    assert {("a", "b"), ("b", "c"), ("a", "c")} & {p[:2] for p in got} >= {("a", "b")}


def test_exact_pairs_and_clusters(spark):
    df = spark.createDataFrame([("a", "1", "9"), ("b", "1", None), ("c", "", "9"), ("d", None, None), ("e", "1", ""), ("e", "1", "")], "k string, v string, w string")
    pairs = duplicates.exact_pairs(df, "k", ["v", "w"])
    assert {(r.left, r.right) for r in pairs.collect()} == {("a", "b"), ("a", "e"), ("a", "c")}
    assert {(r.key, r.cluster) for r in duplicates.clusters(pairs).collect()} == {(k, "a") for k in "abce"}
    chain = spark.range(60).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("left"), F.lpad((F.col("id") + 1).cast("string"), 3, "0").alias("right"))
    assert {r.cluster for r in duplicates.clusters(chain).collect()} == {"000"}
    assert duplicates.clusters(pairs.limit(0)).count() == 0
    shown = duplicates.cluster_rows(pairs, df, "k", ["v"]).collect()
    assert len(shown) == 1 and shown[0].size == 4 and '"key":"e"' in shown[0].members
    cut = duplicates.cluster_rows(pairs, df, "k", ["v"], most=2).collect()
    assert cut[0].size == 4 and cut[0].members == '[{"key":"a","v":"1"},{"key":"b","v":"1"}]'


def test_finder(spark):
    rows = [("1", "Alpha GmbH", "Weg 1", "11111", "Bonn", "DE 1"), ("2", "ALPHA", "Weg 1", "11111", "Bonn", None), ("3", "Beta AG", None, None, None, "de1"), ("4", None, None, None, None, " "), (None, "Alpha", None, "11111", None, "DE1"), ("5", "Alpha", None, "99999", "Ulm", "x")]
    df = spark.createDataFrame(rows, "k string, n string, s string, p string, o string, u string")
    finder = duplicates.Finder(("k",), ("u", "missing"), "n", "s", "p", "o", None, fuzzy=True)
    assert duplicates.candidates(df, finder)[1:] == (["u"], ["country_postcode", "name_sorted", "name_prefix", "country_city", "postcode"])
    assert duplicates.candidates(df.drop("p"), finder)[2] == ["name_sorted", "name_prefix", "country_city"] and duplicates.candidates(df.drop("n"), finder)[2] == []
    found = duplicates.duplicate_clusters(df, finder).collect()
    assert [(r.cluster, r.size, r.score, r.match_type) for r in found] == [("1", 4, 100, "exact")] and '"n":"Beta AG"' in found[0].members
    assert duplicates.duplicate_clusters(df.limit(0), finder).count() == 0 and duplicates.duplicate_clusters(df, duplicates.Finder(("k",))).count() == 0


def test_findings(spark):
    df = spark.createDataFrame([("1", None, "x"), ("2", "b", None)], "k string, p string, detail string")
    found = findings.as_findings(df, FACTS, ["k", "p"], client="p", multi_client=True)
    got = {r.object_key: r for r in found.collect()}
    assert set(got) == {"1", "2/b"} and got["1"].detail == '{"k":"1","p":null,"detail":"x"}' and got["2/b"].mandt == "b" and got["1"].severity_rank == 1
    owners = spark.createDataFrame([("rule", "R-X-001", "me")], "kind string, name string, owner string")
    assert {r.data_owner for r in findings.with_owner(found, owners, "x").collect()} == {"me"} and {r.data_owner for r in findings.with_owner(found, owners.limit(0), "x").collect()} == {"x"}
    before = found.filter("object_key = '1'")
    assert {r.object_key: r.delta_state for r in findings.with_delta(found, before).collect()} == {"1": "unchanged", "2/b": "new"} and {r.delta_state for r in findings.with_delta(found, None).collect()} == {"none"}
    assert tuple(findings.delta_by_rule(found, before).collect()[0]) == ("R-X-001", 1, 2, 1, 0, 1)
    status = spark.createDataFrame([(got["1"].finding_id, "accepted", "ok")], "finding_id string, status string, note string")
    assert {r.object_key: r.status for r in findings.with_status(found, status).collect()} == {"1": "accepted", "2/b": "open"}
    assert findings.search(found, "2/B", ("object_key",)).count() == 1 and findings.search(found, "%").count() == 0 and findings.search(found, category=["risk"]).count() == 2
    assert [r.object_key for r in findings.page(found, 1, 1).collect()] == ["2/b"]


def test_exceptions(spark):
    found = spark.createDataFrame([("f1", "R1", "0001", "1"), ("f2", "R2", "a.b", None), ("f3", "R2", "axb", "2")], "finding_id string, rule_id string, object_key string, mandt string")
    schema = "entry_id string, finding_id string, rule_id string, object_key string, pattern string, mandt string, reason string, expires date"
    from datetime import date

    entries = [("e1", None, "R2", None, None, None, "z rule", None), ("e2", None, None, None, "a.*", None, "a glob", None), ("e3", "f1", None, None, None, "2", "other client", None), ("e4", None, None, "0001", None, None, "late", date(2020, 1, 1)), ("e5", None, None, "axb", "a?[!c]", "2", "shape", date(2030, 1, 1))]
    got = {r.finding_id: (r.whitelisted, r.whitelist_reason, r.exception_ids) for r in findings.with_exceptions(found, spark.createDataFrame(entries, schema), "2025-01-01").collect()}
    assert got == {"f1": (False, None, None), "f2": (True, "a glob", ["e1", "e2"]), "f3": (True, "shape", ["e1", "e5"])}
    assert findings.with_exceptions(found, spark.createDataFrame([], schema), "2025-01-01").filter("whitelisted").count() == 0


def test_score(spark):
    found = spark.createDataFrame([("a", "critical"), ("a", "low"), ("b", "high")], "object_area string, severity string")
    records = spark.createDataFrame([("a", 100), ("b", 0), ("c", 5)], "area string, n_records long")
    assert {r.area: r.score for r in findings.area_scores(found, records).collect()} == {"a": 96.33, "b": None, "c": 100.0}


def test_delivery(spark):
    df = spark.createDataFrame([("1", "x", "A"), ("1", "x", "B"), (None, "y", None), (None, "y", None), ("2", "z", "C")], "c string, k string, b string")
    assert {(r.c, r.k, r.n, r.surplus) for r in delivery.duplicate_keys(df, ["c", "k"]).collect()} == {("1", "x", 2, 1), (None, "y", 2, 1)}
    assert {(r.client, r.state) for r in delivery.clients(df, "c", ["1", "7"]).collect()} == {("1", "expected"), (None, "unexpected"), ("2", "unexpected"), ("7", "missing")}
    assert {r.state for r in delivery.clients(df, "c").collect()} == {"unfiltered"} and {r.state for r in delivery.clients(df.filter("c = '1'"), "c").collect()} == {"expected"}
    assert {(r.table_name, r.state) for r in delivery.row_counts({"a": df, "b": df, "e": df.limit(0)}, {"a": 5, "e": 1}).collect()} == {("a", "ok"), ("b", "unreported"), ("e", "differs")}
    assert [tuple(r) for r in delivery.over_declared(df, {"k": 1, "b": 0}).collect()] == [("b", 0, 1)]
    stages = [("first", F.col("c") == "1"), ("second", F.col("k") == "x")]
    assert {(r.stage, r.n) for r in delivery.waterfall(df, stages).collect()} == {("first", 2), ("remaining", 3)}
    assert delivery.scope(df, "c", ["1", "2"], "b", ["A"]).count() == 1
    assert delivery.merge_parts([df, df.select("c")]).filter("k IS NULL").count() == 5
    pile = spark.range(200).select(F.when(F.col("id") < 50, "x" * 20).otherwise(F.repeat(F.lit("y"), (F.col("id") % 16).cast("int"))).alias("t"), F.lit(None).cast("string").alias("n"))
    assert [r.column_name for r in delivery.length_pile_ups(pile, ["t", "n"]).collect()] == ["t"]
    files = spark.createDataFrame([(1, "h", 100, 10), (2, "h", 65535, 0), (3, None, None, None)], "file_id long, sha256 string, raw_row_count long, rejected_rows long")
    assert {(r.file_id, r.state) for r in delivery.reject_ratio(files).collect()} == {(1, "blocking"), (2, "export limit")} and delivery.same_content(files).count() == 1
    cols = spark.createDataFrame([("T", 1, "A"), ("T", 1, "B"), ("T", 2, "A")], "table_name string, file_id long, name string")
    assert [r.name for r in delivery.partial_columns(cols).collect()] == ["B"]
