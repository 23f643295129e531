import json

import pytest

from stammwerk.plans import pipeline
from stammwerk.plans.config import ConfigError, read_project
from stammwerk.sources.registry import Field, Registry, Table

REGISTRY = Registry([
    Table("MARA", {"MANDT": Field("MANDT", "numc", 3), "MATNR": Field("MATNR", "char", 18, aliases=("Material",)), "MATKL": Field("MATKL", "char", 4, aliases=("Warengruppe",)), "BRGEW": Field("BRGEW", "quan", 13), "ERSDA": Field("ERSDA", "dats", 8)}, ("MANDT", "MATNR")),
    Table("T023", {"MATKL": Field("MATKL", "char", 4)}, ("MATKL",)),
])
RULES = """rules:
  - {id: MAT-COMP-001, name: no group, category: completeness, severity: critical, version: 1.0.0, object_area: material, key_columns: [MATNR], client_column: MANDT, requires: {tables: [MARA], fields: {MARA: [MANDT, MATNR, MATKL]}}, sql: "SELECT MANDT, MATNR FROM MARA WHERE MATKL IS NULL OR is_placeholder_text(MATKL)"}
  - {id: MAT-REF-001, name: unknown group, category: referential, severity: high, version: 1.0.0, object_area: material, key_columns: [MATNR], requires: {tables: [MARA, T023], fields: {MARA: [MATNR, MATKL], T023: [MATKL]}}, sql: "SELECT m.MATNR FROM MARA m LEFT ANTI JOIN T023 t ON m.MATKL = t.MATKL WHERE m.MATKL IS NOT NULL"}
  - {id: MAT-REF-002, name: other table, category: referential, severity: low, version: 1.0.0, object_area: material, key_columns: [MATNR], requires: {tables: [MARC], fields: {MARC: [MATNR]}}, sql: "SELECT MATNR FROM MARC"}
"""
PROJECT = """name: t
as_of: 2024-06-01
input: in
output: out
delivery: {clients: ['100'], expected_rows: {MARA: 4, T023: 2}, must_tables: [MARA]}
ingestion: {alpha: {MATNR: 18}}
rules: {folders: [rules]}
findings: {exceptions: ex.yaml, owners: [{kind: area, name: material, owner: M}]}
privacy: {fields: {MATNR: generic}}
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "rules").mkdir()
    (tmp_path / "in" / "mara_20240131_1.csv").write_text("MANDT;Material;Warengruppe;BRGEW;ERSDA\n100;1;A;1.234,5;20240101\n100;2;;0,5;15.01.2024\n900;3;A;;\n")
    (tmp_path / "in" / "mara_20240131_2.csv").write_bytes("MANDT,Material,Warengruppe,BRGEW,Zusatz\n100,4,Z,\"7,5\",ä\n100,X-5,k.A.,,\n".encode("cp1252"))
    (tmp_path / "in" / "t023.csv").write_text("MATKL\nA\nB\n")
    (tmp_path / "rules" / "r.yaml").write_text(RULES)
    (tmp_path / "ex.yaml").write_text("- {entry_id: e1, pattern: '*X-5', reason: known}\n")
    (tmp_path / "p.yaml").write_text(PROJECT)
    return read_project(tmp_path / "p.yaml")


def test_run(spark, project, tmp_path):
    result = pipeline.execute(spark, project, REGISTRY)
    assert result["n_findings"] == 4 and result["n_effective"] == 2, result  # X-5 is excepted from both rules
    assert result["by_severity"] == {"critical": 1, "high": 1} and result["rules"]["MAT-REF-002"].startswith("skipped") and result["demand"] == [("MARC", 1)]
    out = tmp_path / "out" / result["run_id"]
    staged = {r.MATNR: r for r in spark.read.parquet(str(out / "staged" / "MARA")).collect()}
    assert staged["0" * 17 + "1"].BRGEW == 1234.5 and str(staged["0" * 17 + "2"].ERSDA) == "2024-01-15" and staged["X-5"].MATKL == "k.A." and len(staged) == 4
    assert json.loads((out / "run.json").read_text())["n_findings"] == 4 and (out / "findings.csv").read_bytes().count(b"\n") == 5
    assert (out / "summary.md").read_text().count("| critical | 1 |") == 1 and (out / "coverage.csv").read_text().splitlines()[1:] == ["MAT-COMP-001;yes;;", "MAT-REF-001;yes;;", "MAT-REF-002;no;MARC;MATNR"]
    assert json.loads((tmp_path / "out" / "audit.jsonl").read_text())["run_id"] == result["run_id"] and pipeline.baseline(project) == out
    assert {(c["check"], c["text"]) for c in result["checks"] if c["table"] == "MARA"} >= {("usability", "unknown columns: ['Zusatz']")} and result["qualification"]["by_area"] == {"material": (2, 3)}
    assert {r.data_owner for r in spark.read.parquet(str(out / "findings")).collect()} == {"M"}
    assert pipeline.pseudonymise(spark, project, str(out / "staged"), str(tmp_path / "masked")) == ["MARA", "T023"]
    assert all(r.MATNR.startswith("X") and r.MATNR != "X-5" for r in spark.read.parquet(str(tmp_path / "masked" / "MARA")).collect())
    assert pipeline.purge(project, 4e9) != [] and out.exists() and pipeline.purge(project, 4e9, True) and not out.exists() and pipeline.purge(project, 0) == []


def test_blocking(spark, project, tmp_path):
    (tmp_path / "in" / "mara_again.csv").write_text("MANDT;Material;Warengruppe\n100;1;A\n")
    with pytest.raises(pipeline.DeliveryError, match="duplicate key"):
        pipeline.execute(spark, project, REGISTRY)


def test_rejects_of_the_run(spark, project, tmp_path):
    (tmp_path / "in" / "t023.csv").write_text("MATKL\nA\nB;x\nB;x\nC")
    ingested = pipeline.ingest(spark, project, REGISTRY, str(tmp_path / "s"))
    entry = next(e for e in ingested.files if e["table"] == "T023")
    assert (entry["rows"], entry["rejected"], entry["rejected_distinct"], entry["incomplete_last_line"], entry["reject_samples"]) == (2, 2, 1, True, ["B;x", "B;x"])
    assert {(c.check, c.level) for c in ingested.checks if c.table == "T023"} == {("parse", "error"), ("parse", "warning")}


def test_configuration(tmp_path):
    (tmp_path / "p.yaml").write_text("what: 1")
    with pytest.raises(ConfigError):
        read_project(tmp_path / "p.yaml")
    (tmp_path / "p.yaml").write_text("delivery: {what: 1}")
    with pytest.raises(ConfigError):
        read_project(tmp_path / "p.yaml")


def test_manifest_and_dates_in_the_run(spark, project, tmp_path):
    (tmp_path / "in" / "manifest.yaml").write_text("date: 2024-02-01\ntables: {T023: {rows: 3, date: 2024-03-01}}\n")
    project.delivery.expected_rows.clear()
    ingested = pipeline.ingest(spark, project, REGISTRY, str(tmp_path / "s"))
    assert {(e["table"], e["date"], e["date_source"]) for e in ingested.files} == {("MARA", "2024-02-01", "manifest"), ("T023", "2024-03-01", "manifest")}
    checks = pipeline.validate(ingested, project, REGISTRY)
    assert ("row count", "T023", "2 rows, reported 3") in {(c.check, c.table, c.text) for c in checks}


def test_state_and_commands(tmp_path, capsys):
    from stammwerk.__main__ import main
    from stammwerk.plans import state

    assert main(["init", str(tmp_path / "p")]) == 0 and main(["init", str(tmp_path / "p")]) == 2
    project = str(tmp_path / "p" / "project.yaml")
    assert main(["whitelist", project, "--rule-id", "R", "--reason", "agreed", "--expires", "2030-01-31"]) == 0 and main(["whitelist", project, "--reason", "no condition"]) == 2 and main(["whitelist", project, "--rule-id", "R"]) == 2
    assert main(["whitelist", project, "--pattern", "x*", "--reason", "shape"]) == 0 and main(["whitelist", project, "--end", "e2", "--expires", "2024-01-01"]) == 0 and main(["whitelist", project, "--end", "e9"]) == 2
    entries = state.read_exceptions(tmp_path / "p" / "exceptions.yaml")
    assert [(e["entry_id"], str(e["expires"])) for e in entries] == [("e1", "2030-01-31"), ("e2", "2024-01-01")]
    assert main(["status", project, "f1", "f2", "--set", "accepted", "--note", "a;b"]) == 0 and main(["status", project, "f1", "--set", "what"]) == 2 and main(["status", project, "f1", "--set", "open"]) == 0
    assert state.read_status(tmp_path / "p" / "status.csv") == {"f1": {"status": "open", "note": ""}, "f2": {"status": "accepted", "note": "a;b"}}
    assert len((tmp_path / "p" / "output" / "audit.jsonl").read_text().splitlines()) == 5
    (tmp_path / "x.yaml").write_text("- {entry_id: e1, rule_id: R}")
    with pytest.raises(state.StateError):
        state.read_exceptions(tmp_path / "x.yaml")
