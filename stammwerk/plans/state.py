"""State that outlives a run: exceptions and the status of findings, in files that people can read. Every change is appended to an audit log beside them."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterable
from pathlib import Path

from stammwerk.operators.findings import STATES

FIELDS = ["entry_id", "finding_id", "rule_id", "object_key", "pattern", "mandt", "reason", "expires", "created_by", "created_at"]
CONDITIONS = FIELDS[1:6]


class StateError(ValueError):
    """An entry that cannot be kept."""


def _write(path: Path, text: str) -> None:
    """Whole or not at all: a reader never sees half a file."""
    draft = path.with_name(path.name + ".new")
    draft.write_text(text, encoding="utf-8")
    os.replace(draft, path)


def audit(path: Path, action: str, **facts: object) -> None:
    """One line of JSON per action; lines are only ever appended."""
    entry = {"at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "action": action, **facts}
    with open(path, "a", encoding="utf-8") as log:
        log.write(json.dumps(entry, default=str, sort_keys=True) + "\n")


def read_exceptions(path: Path) -> list[dict]:
    import yaml

    entries = yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else []
    for e in entries or []:
        if set(e) - set(FIELDS) or not str(e.get("reason") or "").strip():
            raise StateError(f"exception {e.get('entry_id')}: needs a reason and knows no {sorted(set(e) - set(FIELDS))}")
    return entries or []


def _save(path: Path, entries: list[dict]) -> None:
    import yaml

    _write(path, yaml.safe_dump(entries, allow_unicode=True, sort_keys=False))


def add_exception(path: Path, entry: dict, log: Path | None = None) -> dict:
    """Adds an entry; it needs a reason and at least one condition, and gets the next id."""
    entries = read_exceptions(path)
    if not str(entry.get("reason") or "").strip() or not any(entry.get(c) for c in CONDITIONS) or set(entry) - set(FIELDS):
        raise StateError("an exception needs a reason and a finding, a rule, an object key, a pattern or a client")
    if entry.get("expires"):
        entry = entry | {"expires": dt.date.fromisoformat(str(entry["expires"]))}
    taken = [int(e["entry_id"][1:]) for e in entries if str(e.get("entry_id", "")).startswith("e") and e["entry_id"][1:].isdigit()]
    made = {"entry_id": f"e{max(taken, default=0) + 1}"} | {k: entry[k] for k in FIELDS[1:] if entry.get(k)} | {"created_at": dt.date.today()}
    _save(path, [*entries, made])
    if log:
        audit(log, "exception added", **made)
    return made


def end_exception(path: Path, entry_id: str, day: dt.date, log: Path | None = None) -> None:
    """An exception ends by its date, it is not deleted: what was excepted then stays explained."""
    entries = read_exceptions(path)
    if entry_id not in [e.get("entry_id") for e in entries]:
        raise StateError(f"no exception {entry_id}")
    _save(path, [e | {"expires": day} if e.get("entry_id") == entry_id else e for e in entries])
    if log:
        audit(log, "exception ended", entry_id=entry_id, expires=day)


def read_status(path: Path) -> dict[str, dict]:
    """finding id -> status and note; a file of lines finding_id;status;note."""
    import csv

    if not path.exists():
        return {}
    with open(path, encoding="utf-8-sig", newline="") as f:
        return {r["finding_id"]: {"status": r["status"], "note": r.get("note") or ""} for r in csv.DictReader(f, delimiter=";") if r.get("finding_id")}


def set_status(path: Path, finding_ids: Iterable[str], status: str, note: str = "", log: Path | None = None) -> None:
    import csv
    import io

    if status not in STATES:
        raise StateError(f"{status} is none of {STATES}")
    known = read_status(path)
    ids = list(finding_ids)
    known.update({i: {"status": status, "note": note} for i in ids})
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["finding_id", "status", "note"])
    writer.writerows([i, v["status"], v["note"]] for i, v in sorted(known.items()))
    _write(path, out.getvalue())
    if log:
        audit(log, "status set", finding_ids=ids, status=status, note=note)
