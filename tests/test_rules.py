import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.plans import rules as rl
from stammwerk.streaming import stream

TEXT = """rules:
  - id: T-COMP-001
    name: no name
    category: completeness
    severity: high
    version: 1.0.0
    object_area: partner
    key_columns: [K]
    requires: {tables: [A], fields: {A: [K, N, C]}}
    params: {closed: [X, Y], none: []}
    sql: SELECT K, N FROM A WHERE coalesce(N, '') = '' AND coalesce(C, '') NOT IN ${closed} AND coalesce(C, '') NOT IN ${none}
  - id: T-REF-001
    name: no group
    category: referential
    severity: low
    version: 1.0.0
    object_area: partner
    key_columns: [K]
    requires: {tables: [A, B], fields: {A: [K], B: [K]}}
    sql: SELECT a.K FROM A a LEFT ANTI JOIN B b ON a.K = b.K
  - id: T-REF-002
    name: broken
    category: referential
    severity: low
    version: 1.0.0
    object_area: partner
    key_columns: [K]
    requires: {tables: [A], fields: {A: [K]}}
    sql: SELECT K, N FROM A
  - {id: bad, name: x}
"""


@pytest.fixture
def catalog(tmp_path):
    (tmp_path / "r.yaml").write_text(TEXT)
    return rl.read_catalog(tmp_path)


def test_catalog(catalog, spark):
    assert [r.id for r in catalog.rules] == ["T-COMP-001", "T-REF-001", "T-REF-002"] and len(catalog.problems) == 1 and len(catalog.digest) == 64
    chosen = catalog.select(disabled=["T-REF-002"], severity={"T-REF-001": "critical"})
    assert [(r.id, r.severity) for r in chosen.rules] == [("T-COMP-001", "high"), ("T-REF-001", "critical")] and chosen.disabled == {"T-REF-002": "disabled"}
    schemas = {"A": T.StructType([T.StructField(c, T.StringType()) for c in "KNC"])}
    assert rl.lint(spark, catalog.rules[0], schemas) == [] and len(rl.lint(spark, catalog.rules[2], schemas)) == 1  # N is not declared there


def test_render():
    assert rl.render("x IN ${a} AND y = ${b} AND z IN ${c}", {"a": ["o'k", 1], "b": None, "c": []}) == "x IN ('o\\'k', 1) AND y = NULL AND z IN (SELECT NULL WHERE FALSE)"
    with pytest.raises(rl.RuleError):
        rl.render("${missing}", {})


def test_coverage_and_demand(catalog):
    assert rl.coverage(catalog.rules, {"A": {"K"}}) == {"T-COMP-001": {"A": ["C", "N"]}, "T-REF-001": {"B": ["K"]}, "T-REF-002": {}}
    assert rl.demand(catalog.rules, {}) == [("A", 2), ("B", 1)] and rl.demand(catalog.rules, {}, 1) == [("A", 2)]


def test_engine(catalog, spark):
    a = spark.createDataFrame([("1", None, None), ("2", "", "X"), ("3", "n", None), (None, None, None)], "K string, N string, C string")
    outcome = rl.run(spark, catalog.rules, {"A": a, "B": a.filter("K = '1'")})
    assert outcome.status["T-COMP-001"] == "ok" and outcome.status["T-REF-001"] == "ok"
    got = [(r.rule_id, r.object_key) for r in rl.ordered(outcome.findings).collect()]
    assert got[:2] == [("T-COMP-001", ""), ("T-COMP-001", "1")] and ("T-REF-001", "3") in got
    partial = rl.run(spark, catalog.rules, {"A": a.select("K")})
    assert partial.status["T-REF-001"].startswith("skipped") and partial.status["T-REF-002"].startswith("error")
    assert partial.findings.count() == 0 and rl.run(spark, [], {}).findings.columns == rl.FINDING_SCHEMA.names


def test_a_rule_that_fails_while_it_runs(catalog, spark, tmp_path):
    bad = rl.parse_rule({"id": "T-COMP-009", "name": "cast", "category": "format", "severity": "low", "version": "1", "object_area": "partner", "key_columns": ["K"], "requires": {"tables": ["A"], "fields": {"A": ["K", "N"]}}, "sql": "SELECT K FROM A WHERE CAST(N AS INT) > 0"})
    a = spark.createDataFrame([("1", None, None), ("2", "", "X"), ("3", "n", None)], "K string, N string, C string")
    outcome = rl.run(spark, [bad, catalog.rules[0]], {"A": a}, str(tmp_path / "raw"))
    assert outcome.status["T-COMP-009"].startswith("error") and outcome.status["T-COMP-001"] == "ok" and not (tmp_path / "raw" / "rule_id=T-COMP-009").exists()
    assert [(r.rule_id, r.object_key) for r in outcome.findings.collect()] == [("T-COMP-001", "1")]


def test_duplicate_rule(spark):
    raw = {"id": "T-DUP-001", "name": "same", "kind": "duplicate", "category": "duplicate", "severity": "high", "version": "1", "object_area": "partner", "key_columns": ["K"], "requires": {"tables": ["A"], "fields": {"A": ["K", "N", "V"]}}, "duplicate": {"source": "SELECT K, N, V FROM A WHERE K <> '9'", "key_columns": ["K"], "exact_keys": ["V"], "name_column": "N", "fuzzy": True}}
    a = spark.createDataFrame([("1", "Alpha Beta", "x"), ("2", "Gamma", "X"), ("3", "Beta Alpha GmbH", None), ("9", "Gamma", "x"), ("4", "Delta", "")], "K string, N string, V string")
    outcome = rl.run(spark, [rl.parse_rule(raw)], {"A": a})
    assert outcome.status == {"T-DUP-001": "ok"}
    assert [(r.object_key, '"size":3' in r.detail) for r in outcome.findings.collect()] == [("1", True)]
    with pytest.raises(rl.RuleError):
        rl.parse_rule(raw | {"duplicate": {"source": "x", "key_columns": ["K"], "what": 1}})


def test_qualification(catalog):
    said = rl.qualify(catalog.rules, {"A": {"K", "N"}})
    assert said["ratio"] == 1 / 3 and said["by_area"] == {"partner": (1, 3)} and said["blocking"] == {"A": 1, "B": 1} and said["missing_tables"] == {"B": 1} and said["incomplete_tables"] == {"A": ["C"]} and "1 of 3" in said["text"]
    assert rl.qualify([], {})["ratio"] == 0.0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, -1.0, "2024-01-01 00:00:00"), (1, -1.0, "2024-01-01 00:01:00"), (2, 5.0, "2024-01-01 00:00:00")], "k int, v double, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.watch(spark, str(tmp_path / "in"), rows.schema)
    facts = {"rule_id": "R-X-001", "rule_version": "1", "rule_name": "n", "category": "risk", "severity": "low", "object_area": "a"}
    found = stream.stream_rule(source, F.col("v") < 0, facts, ["k"]).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    first = stream.first_of_key(source, ["k"], "t", "1 hour").writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    found.awaitTermination(60), first.awaitTermination(60)
    assert spark.table("found").count() == 2 and spark.table("first").count() == 2
