"""Declarative rules: Spark SQL with facts about it, checked, selected and run; each rule's rows become findings.

A rule names the tables and fields it needs. The catalogue is validated and linted on the driver, the coverage tells which rules a
delivery supports and which table would unlock most of the others. The engine writes the findings of each rule by a job of its own, so a rule that
fails, while it is analysed or while it runs, leaves no rows and does not touch the others. A rule of kind `duplicate` runs the duplicate finder over its source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stammwerk.operators import duplicates
from stammwerk.operators import findings as fnd
from stammwerk.session import Scratch, _delete

ID = re.compile(r"^[A-Z]{1,4}-[A-Z]{2,5}-[0-9]{3}$")
CATEGORIES = ["completeness", "consistency", "referential", "format", "lifecycle", "duplicate", "risk", "external"]
FACTS = {"id", "name", "description", "category", "severity", "version", "object_area", "object_type", "key_columns", "client_column", "company_column", "requires", "params", "sql", "requirement", "kind", "duplicate", "remediation"}
FINDING_SCHEMA = T.StructType([T.StructField("finding_id", T.StringType()), *(T.StructField(c, T.IntegerType() if c == "severity_rank" else T.StringType()) for c in fnd.COLUMNS)])


class RuleError(ValueError):
    """A rule that cannot be used; the others can."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    severity: str
    version: str
    object_area: str
    object_type: str
    key_columns: tuple[str, ...]
    sql: str
    requires: dict[str, frozenset[str]]
    params: dict[str, object] = field(default_factory=dict)
    client_column: str | None = None
    company_column: str | None = None
    requirement: str = ""
    duplicate: dict | None = None

    def facts(self) -> dict[str, str]:
        return {"rule_id": self.id, "rule_version": self.version, "rule_name": self.name, "category": self.category, "severity": self.severity, "object_area": self.object_area, "object_type": self.object_type, "requirement": self.requirement}


def parse_rule(raw: dict) -> Rule:
    unknown = set(raw) - FACTS
    finder = raw.get("duplicate") if raw.get("kind") == "duplicate" else None
    if finder is not None:
        raw = raw | {"sql": finder.get("source", "")}
        strange = set(finder) - {"source", *duplicates.Finder.__dataclass_fields__}
        if strange or not finder.get("key_columns"):
            raise RuleError(f"{raw.get('id')}: duplicate needs source and key_columns, and knows no {sorted(strange)}")
    missing = [k for k in ("id", "name", "category", "severity", "version", "object_area", "key_columns", "requires", "sql") if not raw.get(k)]
    if unknown or missing:
        raise RuleError(f"{raw.get('id')}: unknown {sorted(unknown)}, missing {missing}")
    if not ID.match(raw["id"]) or raw["category"] not in CATEGORIES or raw["severity"] not in fnd.SEVERITIES:
        raise RuleError(f"{raw['id']}: id, category or severity is not valid")
    needs = {t: frozenset((raw["requires"].get("fields") or {}).get(t, ())) for t in raw["requires"].get("tables", ())}
    used = set(re.findall(r"\$\{(\w+)\}", raw["sql"]))
    if used - set(raw.get("params") or {}):
        raise RuleError(f"{raw['id']}: undefined parameters {sorted(used - set(raw.get('params') or {}))}")
    return Rule(raw["id"], raw["name"], raw["category"], raw["severity"], str(raw["version"]), raw["object_area"], raw.get("object_type", ""), tuple(raw["key_columns"]), raw["sql"], needs, dict(raw.get("params") or {}), raw.get("client_column"), raw.get("company_column"), raw.get("requirement", ""), finder)


@dataclass
class Catalog:
    rules: list[Rule]
    version: str
    digest: str
    problems: list[str]
    disabled: dict[str, str] = field(default_factory=dict)

    def select(self, enabled: list[str] | None = None, disabled: list[str] = (), categories_off: list[str] = (), severity: dict[str, str] | None = None, params: dict[str, dict] | None = None, external: bool = False) -> Catalog:
        kept, off = [], dict(self.disabled)
        for rule in self.rules:
            why = "not enabled" if enabled is not None and rule.id not in enabled else "disabled" if rule.id in disabled else "category off" if rule.category in categories_off else "external" if rule.category == "external" and not external else None
            if why:
                off[rule.id] = why
            else:
                kept.append(replace(rule, severity=(severity or {}).get(rule.id, rule.severity), params=rule.params | (params or {}).get(rule.id, {})))
        return replace(self, rules=kept, disabled=off)


def read_catalog(folder: str | Path, version: str = "1") -> Catalog:
    """All rules below a folder, in order of file and position; the digest covers the files' names and contents."""
    import yaml

    digest, rules, problems, seen = hashlib.sha256(version.encode()), [], [], set()
    for path in sorted(Path(folder).rglob("*.yaml")):
        text = path.read_bytes()
        digest.update(path.name.encode() + b"\0" + text)
        for raw in (yaml.safe_load(text) or {}).get("rules") or []:
            try:
                rule = parse_rule(raw)
                if rule.id in seen:
                    raise RuleError(f"{rule.id}: defined twice")
                seen.add(rule.id)
                rules.append(rule)
            except RuleError as problem:
                problems.append(str(problem))
    return Catalog(rules, version, digest.hexdigest(), problems)


def literal(value: object) -> str:
    """A SQL literal; a list becomes a tuple, an empty list one that contains nothing."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple, set, frozenset)):
        items = sorted(value, key=str) if isinstance(value, (set, frozenset)) else value
        return "(" + ", ".join(literal(v) for v in items) + ")" if items else "(SELECT NULL WHERE FALSE)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render(sql: str, params: dict[str, object]) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in params:
            raise RuleError(f"unknown parameter {m[1]}")
        return literal(params[m[1]])

    return re.sub(r"\$\{(\w+)\}", one, sql)


def lint(spark: SparkSession, rule: Rule, schemas: dict[str, T.StructType]) -> list[str]:
    """Problems that analysis finds when only the declared fields exist: an undeclared field does not resolve."""
    for table in rule.requires:
        fields = [f for f in schemas.get(table, T.StructType()).fields if f.name in rule.requires[table]]
        spark.createDataFrame([], T.StructType(fields)).createOrReplaceTempView(table)
    try:
        spark.sql(render(rule.sql, rule.params)).schema  # noqa: B018
    except Exception as problem:  # the analyser's own message says what is missing
        return [f"{rule.id}: {str(problem).splitlines()[0]}"]
    return []


def missing_for(rule: Rule, delivered: dict[str, set[str]]) -> dict[str, list[str]]:
    """Table -> missing fields; a missing table has all of its fields missing."""
    gaps = {t: sorted(fields - delivered.get(t, set())) for t, fields in rule.requires.items()}
    return {t: g for t, g in gaps.items() if g or t not in delivered}


def coverage(rules: list[Rule], delivered: dict[str, set[str]]) -> dict[str, dict[str, list[str]]]:
    """Rule id -> what is missing; empty where the rule can run."""
    return {r.id: missing_for(r, delivered) for r in rules}


def demand(rules: list[Rule], delivered: dict[str, set[str]], limit: int = 10) -> list[tuple[str, int]]:
    """Which table to ask for next: greedily the one that unlocks most rules given those before; ties by name."""
    have = {t: set(f) for t, f in delivered.items()}
    asked: list[tuple[str, int]] = []
    while len(asked) < limit:
        open_rules = [(r, missing_for(r, have)) for r in rules if missing_for(r, have)]
        wanted = sorted({t for _, gaps in open_rules for t in gaps})
        gains = [(-sum(set(gaps) == {t} for _, gaps in open_rules), -sum(t in gaps for _, gaps in open_rules), t) for t in wanted]
        if not gains:
            break
        gain, _, table = min(gains)
        asked.append((table, -gain))
        have.setdefault(table, set()).update(f for r, gaps in open_rules for f in (r.requires[table] if table in gaps else ()))
    return asked


@dataclass
class Outcome:
    findings: DataFrame
    status: dict[str, str]


def run_rule(spark: SparkSession, rule: Rule, multi_client: bool = False) -> DataFrame:
    rows = spark.sql(render(rule.sql, rule.params))
    if rule.duplicate is not None:  # one finding per cluster; its members may be of several clients
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in rule.duplicate.items() if k != "source"}
        clusters = duplicates.duplicate_clusters(rows, duplicates.Finder(**options))
        return fnd.as_findings(clusters, rule.facts(), ["cluster"])
    return fnd.as_findings(rows, rule.facts(), list(rule.key_columns), rule.client_column, rule.company_column, multi_client)


def run(spark: SparkSession, rules: list[Rule], tables: dict[str, DataFrame], path: str | None = None, runner: Callable[[SparkSession, Rule], DataFrame] = run_rule, at_once: int = 4) -> Outcome:
    """All executable rules, each written apart below path (the scratch folder without one); some run side by side. What fails is recorded and left out."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    delivered = {n: set(df.columns) for n, df in tables.items()}
    path = path or Scratch(spark, "rules").path

    def one(rule: Rule) -> str:
        gaps = missing_for(rule, delivered)
        if gaps:
            return f"skipped: {gaps}"
        place = f"{path}/rule_id={rule.id}"
        try:
            runner(spark, rule).drop("rule_id").write.mode("overwrite").parquet(place)
            return "ok"
        except Exception as problem:
            _delete(spark, place)
            return f"error: {str(problem).splitlines()[0]}"

    with ThreadPoolExecutor(at_once) as pool:
        status = {rule.id: state for rule, state in zip(rules, pool.map(one, rules), strict=True)}
    if "ok" in status.values():
        found = spark.read.schema(FINDING_SCHEMA).parquet(path)
    else:
        found = spark.createDataFrame([], FINDING_SCHEMA)
    return Outcome(found.select(*FINDING_SCHEMA.names), status)


def qualify(rules: list[Rule], delivered: dict[str, set[str]]) -> dict:
    """What the result of a delivery can claim: the share of executable rules, by area and category, what is missing, and the caveat as a sentence."""
    gaps = coverage(rules, delivered)
    count = lambda of: {k: (sum(not gaps[r.id] for r in rules if of(r) == k), sum(of(r) == k for r in rules)) for k in sorted({of(r) for r in rules})}
    blocked = [r for r in rules if gaps[r.id]]
    by_table: dict[str, int] = {}
    fields: dict[str, set[str]] = {}
    for r in blocked:
        for table, names in gaps[r.id].items():
            by_table[table] = by_table.get(table, 0) + 1
            if table in delivered:
                fields.setdefault(table, set()).update(names)
    ranked = sorted(by_table, key=lambda t: (-by_table[t], t))
    done = len(rules) - len(blocked)
    if not rules:
        text = "No rule was active: the delivery was not checked."
    elif not blocked:
        text = f"All {len(rules)} active rules could run."
    else:
        text = f"{done} of {len(rules)} active rules could run ({done / len(rules):.0%}). {len(blocked)} lack tables or fields, mostly {', '.join(ranked[:5])}; about what they check nothing is said, neither good nor bad."
    return {
        "ratio": done / len(rules) if rules else 0.0, "by_area": count(lambda r: r.object_area), "by_category": count(lambda r: r.category), "blocking": {t: by_table[t] for t in ranked},
        "missing_tables": {t: by_table[t] for t in ranked if t not in delivered}, "incomplete_tables": {t: sorted(f) for t, f in sorted(fields.items())}, "text": text,
    }


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("severity_rank", "rule_id", "object_key", F.col("finding_id"))
