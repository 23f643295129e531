"""From a delivery folder to findings: load, assign, map, convert, stage, check, cover, run, enrich, score, write.

Small facts (file list, headers, schemas, counts per rule) live on the driver; rows stay in Spark and are written once per stage."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stammwerk.functions import masking, validators
from stammwerk.functions.convert import comma_votes, convert
from stammwerk.operators import delivery, findings
from stammwerk.plans import report, state
from stammwerk.plans import rules as rl
from stammwerk.plans.config import Project
from stammwerk.sources import files
from stammwerk.sources.registry import Registry


class DeliveryError(RuntimeError):
    """The delivery cannot be used as it is."""


@dataclass
class Check:
    check: str
    level: str  # info, warning or error
    table: str
    text: str


@dataclass
class Ingested:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    files: list[dict] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    manifest: dict = field(default_factory=dict)


def ingest(spark: SparkSession, project: Project, registry: Registry, stage: str) -> Ingested:
    """Typed tables of all files, partial deliveries merged, staged as Parquet sorted by key."""
    out = Ingested()
    parts: dict[str, list[DataFrame]] = {}
    columns: dict[str, list[set[str]]] = {}
    hashes: dict[str, str] = {}
    told = project.path(project.input) / project.ingestion.manifest
    manifest = files.read_manifest(told) if project.ingestion.manifest and told.exists() else {"client": None, "date": None, "tables": {}}
    out.manifest = manifest
    found = files.scan_files(project.path(project.input), project.ingestion.ignore)
    probes = files.probe_files(spark, found)
    for path in found:
        seen = probes[str(path)]
        if seen.size == 0:
            out.checks.append(Check("files", "warning", "", f"{path.name} is empty"))
            continue
        if seen.sha256 in hashes:
            out.checks.append(Check("files", "error", "", f"{path.name} has the content of {hashes[seen.sha256]}"))
            continue
        hashes[seen.sha256] = path.name
        info = files.detect_format(path, seen.encoding)
        loaded = files.load(spark, path, info)
        chosen = registry.assign(str(path), loaded.columns, project.ingestion.files)
        own = manifest["tables"].get(chosen.table or "", {}).get("date") or manifest["date"]
        changed = time.strftime("%Y-%m-%d", time.gmtime(path.stat().st_mtime))
        date, source = files.extraction_date(path.name, own, project.delivery.date, changed)
        entry = {"file": path.name, "sha256": seen.sha256, "format": info.kind, "encoding": info.encoding, "delimiter": info.delimiter, "table": chosen.table, "method": chosen.method, "date": date, "date_source": source}
        if loaded.totals is not None:
            counted = loaded.totals.first()
            entry |= {"rows": counted.n_rows, "rejected": counted.n_rejected, "rejected_distinct": counted.n_distinct_rejected, "incomplete_last_line": seen.ends_open}
            entry["reject_samples"] = [r.raw for r in loaded.rejects.orderBy("raw").limit(5).collect()] if counted.n_rejected else []
            every = counted.n_rows + counted.n_rejected
            if counted.n_rejected > project.delivery.reject_ratio * every:
                out.checks.append(Check("parse", "error", chosen.table or "", f"{path.name}: {counted.n_rejected} of {every} rows rejected"))
            if seen.ends_open:
                out.checks.append(Check("parse", "warning", chosen.table or "", f"{path.name}: the last line has no end"))
            if every in delivery.EXPORT_LIMITS:
                out.checks.append(Check("parse", "warning", chosen.table or "", f"{path.name}: {every} rows are a known export limit"))
        out.files.append(entry)
        if chosen.table is None:
            out.checks.append(Check("files", "warning", "", f"{path.name} fits no table"))
            continue
        table = registry.tables[chosen.table]
        mapped = table.map_headers(loaded.columns, project.ingestion.headers.get(chosen.table))
        typed = loaded.table.toDF(*(mapped[c] for c in loaded.columns))
        numbers = [c for c in typed.columns if c in table.fields and table.fields[c].kind in ("curr", "quan", "dec", "int")]
        votes = comma_votes(typed, numbers).collect()[0].asDict() if numbers else {}
        order = [*(f for f in table.fields if f in typed.columns), *sorted(c for c in typed.columns if c not in table.fields)]
        kind = lambda c: table.fields[c].kind if c in table.fields else "char"
        parts.setdefault(chosen.table, []).append(typed.select(*(convert(F.col(f"`{c}`"), kind(c), project.ingestion.alpha.get(c), votes.get(c, False)).alias(c) for c in order)))
        columns.setdefault(chosen.table, []).append(set(order))
    for name, frames in parts.items():
        if len({frozenset(c) for c in columns[name]}) > 1:
            out.checks.append(Check("partial", "warning", name, f"parts lack {sorted(set.union(*columns[name]) - set.intersection(*columns[name]))}"))
        merged = delivery.merge_parts(frames)
        key = [k for k in registry.tables[name].key if k in merged.columns]
        client = next((c for c in ("MANDT", "CLIENT") if c in merged.columns), None)
        if client and project.delivery.clients:
            for row in delivery.clients(merged, client, project.delivery.clients).filter("state = 'missing'").collect():
                out.checks.append(Check("clients", "error", name, f"client {row.client} is missing"))
            merged = delivery.scope(merged, client, project.delivery.clients, "BUKRS" if "BUKRS" in merged.columns else None, project.delivery.companies or None)
        path = f"{stage}/{name}"
        files.write_staged(merged, path, key or merged.columns[:1])
        out.tables[name] = spark.read.parquet(path)
    return out


def validate(ingested: Ingested, project: Project, registry: Registry) -> list[Check]:
    """All checks of the delivery; an error blocks."""
    checks = list(ingested.checks)
    for name, entries in _by_table(ingested.files).items():
        days = sorted({e["date"] for e in entries if e["date_source"] != "file time"})
        if any(e["date_source"] == "file time" for e in entries):
            checks.append(Check("cut-off date", "warning", name, "no date but that of the file is known"))
        if len(days) > 1:
            checks.append(Check("cut-off date", "warning", name, f"parts of several days: {days}"))
    for name in project.delivery.must_tables:
        if name not in ingested.tables:
            checks.append(Check("usability", "error", name, "table is missing"))
    expected = {n: t["rows"] for n, t in ingested.manifest.get("tables", {}).items() if t.get("rows") is not None} | project.delivery.expected_rows
    for row in delivery.row_counts(ingested.tables, expected, project.delivery.tolerance).collect() if ingested.tables else []:
        if row.state != "ok":
            if row.n_rows == 0:
                checks.append(Check("usability", "error" if row.table_name in project.delivery.must_tables else "warning", row.table_name, "no rows are left"))
            checks.append(Check("row count", "error" if row.state == "differs" else "warning", row.table_name, f"{row.n_rows} rows, reported {row.reported}"))
    for name, df in ingested.tables.items():
        table = registry.tables[name]
        strange = [c for c in df.columns if c not in table.fields]
        if strange:
            checks.append(Check("usability", "warning", name, f"unknown columns: {strange}"))
        missing = [k for k in table.key if k not in df.columns]
        if missing:
            checks.append(Check("usability", "error", name, f"key fields missing: {missing}"))
        else:
            surplus = delivery.duplicate_keys(df, list(table.key)).agg(F.sum("surplus")).collect()[0][0] if table.key else None
            if surplus:
                checks.append(Check("duplicate key", "error", name, f"{surplus} surplus rows"))
        texts = [c for c, k in df.dtypes if k == "string" and c in table.fields and table.fields[c].length and table.fields[c].kind == "char" and c not in table.key]
        if texts:
            for row in delivery.over_declared(df, {c: table.fields[c].length for c in texts}).collect():
                checks.append(Check("length", "warning", name, f"{row.column_name}: {row.max_length} characters, declared {row.declared}"))
            for row in delivery.length_pile_ups(df, texts).collect():
                checks.append(Check("truncation", "warning", name, f"{row.column_name}: {row.n_at_max} texts of {row.max_length} characters"))
    return checks


def _by_table(entries: list[dict]) -> dict[str, list[dict]]:
    found: dict[str, list[dict]] = {}
    for e in entries:
        if e["table"]:
            found.setdefault(e["table"], []).append(e)
    return found


def execute(spark: SparkSession, project: Project, registry: Registry, force: bool = False) -> dict:
    """The whole run; returns what run.json holds. Raises DeliveryError if a check blocks, unless forced."""
    run_id = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    target = project.path(project.output) / run_id
    if target.exists():
        raise DeliveryError(f"{target} is there already; no run writes over another")
    ingested = ingest(spark, project, registry, str(target / "staged"))
    checks = validate(ingested, project, registry)
    blocking = [c for c in checks if c.level == "error"]
    result: dict = {"run_id": run_id, "fingerprint": project.fingerprint, "files": ingested.files, "checks": [vars(c) for c in checks]}
    target.mkdir(parents=True, exist_ok=True)
    try:
        if blocking and not force:
            raise DeliveryError("; ".join(f"{c.check} {c.table}: {c.text}" for c in blocking))
        validators.register(spark)
        catalogs = [rl.read_catalog(project.path(f)) for f in project.rules.folders]
        chosen = [c.select(project.rules.enabled, project.rules.disabled, project.rules.categories_off, project.rules.severity, project.rules.params, project.rules.external) for c in catalogs]
        rules = [r for c in chosen for r in c.rules]
        delivered = {n: set(df.columns) for n, df in ingested.tables.items()}
        result |= {"catalog": [c.digest for c in chosen], "problems": [p for c in chosen for p in c.problems], "coverage": rl.coverage(rules, delivered), "demand": rl.demand(rules, delivered), "qualification": rl.qualify(rules, delivered)}
        outcome = rl.run(spark, rules, ingested.tables, str(target / "raw"))
        full = enrich(spark, outcome.findings, project)
        files.write_findings(full, str(target / "findings"))
        full = spark.read.parquet(str(target / "findings"))
        effective = full.filter("NOT whitelisted")
        leading = {r.object_area: next(iter(r.requires)) for r in rules if set(r.requires) & set(ingested.tables)}
        areas = [ingested.tables[t].agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(a).alias("area"), "n_records") for a, t in leading.items() if t in ingested.tables]
        scores = findings.area_scores(effective, reduce(DataFrame.unionByName, areas)).collect() if areas else []
        by = lambda c: {r[c]: r["count"] for r in effective.groupBy(c).count().collect()}
        result |= {"rules": outcome.status, "n_findings": full.count(), "n_effective": effective.count(), "by_severity": by("severity"), "by_category": by("category"), "scores": [r.asDict() for r in scores]}
        files.write_csv(rl.ordered(full.drop("exception_ids")), str(target / "findings.csv"), ["severity_rank", "rule_id", "object_key", "finding_id"])
    finally:
        (target / "run.json").write_text(json.dumps(result, indent=1, default=str), encoding="utf-8")
        (target / "summary.md").write_text(report.summary(result), encoding="utf-8")
        (target / "coverage.csv").write_text(report.coverage_csv(result.get("coverage", {})), encoding="utf-8")
        state.audit(project.path(project.output) / "audit.jsonl", "run", run_id=run_id, fingerprint=project.fingerprint, catalog=result.get("catalog", []), files={e["file"]: e["sha256"] for e in ingested.files}, forced=force, blocked=bool(blocking and not force))
    return result


def enrich(spark: SparkSession, raw: DataFrame, project: Project) -> DataFrame:
    """Exceptions, status, owner and delta; the state files are optional."""
    schema = "entry_id string, finding_id string, rule_id string, object_key string, pattern string, mandt string, reason string, expires date"
    entries = state.read_exceptions(project.path(project.findings.exceptions)) if project.findings.exceptions else []
    rows = [tuple(e.get(c.split()[0]) for c in schema.split(", ")) for e in entries]
    status = spark.read.csv(str(project.path(project.findings.status)), header=True, schema="finding_id string, status string, note string", sep=";") if project.findings.status else spark.createDataFrame([], "finding_id string, status string, note string")
    owners = spark.createDataFrame([(o["kind"], o["name"], o["owner"]) for o in project.findings.owners], "kind string, name string, owner string")
    base = baseline(project)
    before = spark.read.parquet(str(base / "findings")) if base else None
    full = findings.with_exceptions(raw, spark.createDataFrame(rows, schema), project.as_of)
    return findings.with_delta(findings.with_owner(findings.with_status(full, status), owners, project.findings.default_owner), before)


def baseline(project: Project) -> Path | None:
    """The run to compare with: the one that is named, else the newest earlier one with findings; `none` compares with nothing."""
    if project.findings.baseline == "none":
        return None
    if project.findings.baseline:
        return project.path(project.findings.baseline)
    root = project.path(project.output)
    runs = sorted(p for p in root.iterdir() if (p / "run.json").exists() and (p / "findings").exists()) if root.exists() else []
    return runs[-1] if runs else None


def pseudonymise(spark: SparkSession, project: Project, stage: str, target: str) -> list[str]:
    """Masked copies of staged tables: privacy.fields names the method of each column; the salt file is made once, readable by its owner only."""
    import secrets

    salt_file = project.path(project.privacy.salt_file)
    if not salt_file.exists():
        salt_file.touch(mode=0o600)
        salt_file.write_text(secrets.token_hex(32))
    salt = salt_file.read_text().strip()
    done = []
    for folder in sorted(p for p in Path(stage).iterdir() if p.is_dir()):
        df = spark.read.parquet(str(folder))
        methods = {c: m for c, m in project.privacy.fields.items() if c in df.columns}
        df.select(*(masking.mask(F.col(f"`{c}`"), methods[c], salt).alias(c) if c in methods else F.col(f"`{c}`") for c in df.columns)).write.mode("overwrite").parquet(f"{target}/{folder.name}")
        done.append(folder.name)
    return done


def purge(project: Project, now: float, confirmed: bool = False) -> list[dict]:
    """Runs older than the retention; only listed unless confirmed, and every deletion is logged beside the runs."""
    import shutil

    root = project.path(project.output)
    old = [p for p in sorted(root.iterdir()) if p.is_dir() and (p / "run.json").exists() and now - (p / "run.json").stat().st_mtime > project.privacy.retention_days * 86400] if root.exists() else []
    report = [{"path": str(p), "days": int((now - (p / "run.json").stat().st_mtime) // 86400)} for p in old]
    if confirmed:
        for p, entry in zip(old, report, strict=True):
            shutil.rmtree(p)
            with open(root / "deleted.log", "a", encoding="utf-8") as log:
                log.write(json.dumps(entry) + "\n")
    return report
