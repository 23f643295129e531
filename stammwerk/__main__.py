"""Command line. Exit codes: 0 fine, 1 the delivery is not usable, 2 wrong use or configuration, 3 critical findings remain."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import time
from pathlib import Path

from stammwerk.plans import pipeline, state
from stammwerk.plans import rules as rl
from stammwerk.plans.config import ConfigError, read_project
from stammwerk.session import any_session
from stammwerk.sources.registry import Registry


def _registry(spark, path: str) -> Registry:
    return Registry.from_rows([r.asDict() for r in spark.read.parquet(path).collect()])


def _init(folder: Path) -> int:
    """Writes a project with its folders; an existing one is left alone."""
    if (folder / "project.yaml").exists():
        raise ConfigError(f"{folder} holds a project already")
    for name in ("input", "output", "rules"):
        (folder / name).mkdir(parents=True, exist_ok=True)
    (folder / "project.yaml").write_text(f"name: {folder.name}\ninput: input\noutput: output\nrules: {{folders: [rules]}}\nfindings: {{exceptions: exceptions.yaml, status: status.csv}}\n", encoding="utf-8")
    (folder / "exceptions.yaml").write_text("[]\n", encoding="utf-8")
    (folder / "status.csv").write_text("finding_id;status;note\n", encoding="utf-8")
    print(folder / "project.yaml")
    return 0


def _whitelist(project, args, log: Path) -> int:
    path = project.path(project.findings.exceptions or "exceptions.yaml")
    if args.end:
        state.end_exception(path, args.end, dt.date.fromisoformat(args.expires) if args.expires else dt.date.today(), log)
    elif args.reason or any(getattr(args, c) for c in state.CONDITIONS):
        entry = {f: getattr(args, f) for f in state.FIELDS if getattr(args, f, None)}
        print(json.dumps(state.add_exception(path, entry, log), default=str))
    else:
        print(json.dumps(state.read_exceptions(path), default=str, indent=1))
    return 0


def _status(project, args, log: Path) -> int:
    path = project.path(project.findings.status or "status.csv")
    if args.set:
        state.set_status(path, args.finding_ids, args.set, args.note, log)
    else:
        known = state.read_status(path)
        print(json.dumps({i: known[i] for i in args.finding_ids or known if i in known}, indent=1))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stammwerk")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "run", "coverage", "rules", "delta", "pseudonymize", "purge"):
        sub = commands.add_parser(name)
        sub.add_argument("project")
        if name in ("validate", "run", "coverage"):
            sub.add_argument("--registry", required=True, help="Parquet table of known fields")
        if name == "run":
            sub.add_argument("--force", action="store_true")
        if name == "delta":
            sub.add_argument("now"), sub.add_argument("before")
        if name == "pseudonymize":
            sub.add_argument("stage"), sub.add_argument("target")
        if name == "purge":
            sub.add_argument("--yes", action="store_true")
    sub = commands.add_parser("init", help="a new project folder")
    sub.add_argument("folder")
    sub = commands.add_parser("whitelist", help="list, add or end exceptions")
    sub.add_argument("project")
    for option in ("finding-id", "rule-id", "object-key", "pattern", "mandt", "reason", "expires", "created-by", "end"):
        sub.add_argument(f"--{option}")
    sub = commands.add_parser("status", help="list or set the status of findings")
    sub.add_argument("project")
    sub.add_argument("finding_ids", nargs="*")
    sub.add_argument("--set"), sub.add_argument("--note", default="")
    args = parser.parse_args(argv)
    try:
        if args.command == "init":
            return _init(Path(args.folder))
        project = read_project(args.project)
        log = project.path(project.output) / "audit.jsonl"
        if args.command in ("whitelist", "status"):
            log.parent.mkdir(parents=True, exist_ok=True)
            return _whitelist(project, args, log) if args.command == "whitelist" else _status(project, args, log)
        if args.command == "rules":
            for folder in project.rules.folders:
                for r in rl.read_catalog(project.path(folder)).rules:
                    print(r.id, r.category, r.severity, r.name, sep="\t")
            return 0
        if args.command == "purge":
            print(json.dumps(pipeline.purge(project, time.time(), args.yes)))
            return 0
        spark = any_session()
        if args.command == "delta":
            from stammwerk.operators.findings import delta_by_rule

            delta_by_rule(spark.read.parquet(f"{args.now}/findings"), spark.read.parquet(f"{args.before}/findings")).orderBy("rule_id").show(1000, False)
            return 0
        if args.command == "pseudonymize":
            print(json.dumps(pipeline.pseudonymise(spark, project, args.stage, args.target)))
            return 0
        registry = _registry(spark, args.registry)
        if args.command == "run":
            result = pipeline.execute(spark, project, registry, args.force)
            print(json.dumps(result, default=str))
            return 3 if result["by_severity"].get("critical") else 0
        ingested = pipeline.ingest(spark, project, registry, str(Path(project.path(project.output)) / "checked"))
        if args.command == "coverage":
            delivered = {n: set(df.columns) for n, df in ingested.tables.items()}
            rules = [r for f in project.rules.folders for r in rl.read_catalog(project.path(f)).rules]
            print(json.dumps({"coverage": rl.coverage(rules, delivered), "demand": rl.demand(rules, delivered)}))
            return 0
        checks = pipeline.validate(ingested, project, registry)
        print(json.dumps([vars(c) for c in checks]))
        return int(any(c.level == "error" for c in checks))
    except (ConfigError, state.StateError) as problem:
        print(problem, file=sys.stderr)
        return 2
    except pipeline.DeliveryError as problem:
        print(problem, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
