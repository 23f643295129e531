"""Configuration of a project: one YAML file; unknown sections and keys are errors, and its hash is its fingerprint."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass
class Delivery:
    expected_rows: dict[str, int] = field(default_factory=dict)
    clients: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    tolerance: float = 0.0
    reject_ratio: float = 0.05
    date: str | None = None
    must_tables: list[str] = field(default_factory=list)


@dataclass
class Ingestion:
    ignore: list[str] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)
    headers: dict[str, dict[str, str]] = field(default_factory=dict)
    alpha: dict[str, int] = field(default_factory=dict)
    manifest: str = "manifest.yaml"


@dataclass
class Rules:
    folders: list[str] = field(default_factory=list)
    enabled: list[str] | None = None
    disabled: list[str] = field(default_factory=list)
    categories_off: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)
    external: bool = False


@dataclass
class Findings:
    exceptions: str | None = None
    status: str | None = None
    owners: list[dict] = field(default_factory=list)
    default_owner: str = "data office"
    baseline: str | None = None


@dataclass
class Privacy:
    salt_file: str = "salt.txt"
    retention_days: int = 365
    fields: dict[str, str] = field(default_factory=dict)


@dataclass
class Project:
    name: str = "project"
    as_of: str = "2025-01-01"
    input: str = "input"
    output: str = "output"
    delivery: Delivery = field(default_factory=Delivery)
    ingestion: Ingestion = field(default_factory=Ingestion)
    rules: Rules = field(default_factory=Rules)
    findings: Findings = field(default_factory=Findings)
    privacy: Privacy = field(default_factory=Privacy)
    fingerprint: str = ""
    base: Path = Path(".")

    def path(self, name: str) -> Path:
        return self.base / name


_SECTIONS = {"delivery": Delivery, "ingestion": Ingestion, "rules": Rules, "findings": Findings, "privacy": Privacy}


def read_project(path: str | Path) -> Project:
    import yaml

    text = Path(path).read_text(encoding="utf-8")
    raw = yaml.safe_load(text) or {}
    known = {f.name for f in fields(Project)} - {"fingerprint", "base"}
    if set(raw) - known:
        raise ConfigError(f"unknown sections: {sorted(set(raw) - known)}")
    made = dict(raw)
    for name, kind in _SECTIONS.items():
        section = raw.get(name) or {}
        extra = set(section) - {f.name for f in fields(kind)}
        if extra:
            raise ConfigError(f"{name}: unknown keys: {sorted(extra)}")
        made[name] = kind(**section)
    return Project(**made, fingerprint=hashlib.sha256(text.encode()).hexdigest(), base=Path(path).parent)
