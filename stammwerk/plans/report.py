"""What a run leaves for people: a summary in Markdown and a list of what each rule lacks. Both only hold counts, never rows of findings."""

from __future__ import annotations

import csv
import io

from stammwerk.operators.findings import SEVERITIES


def _table(head: list[str], rows: list[list]) -> list[str]:
    plain = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(head) + " |", "|" + " - |" * len(head), *("| " + " | ".join(map(plain, r)) + " |" for r in rows), ""]


def summary(result: dict) -> str:
    """The summary of what `pipeline.execute` returns; a blocked run says why and no more."""
    lines = [f"# Run {result['run_id']}", ""]
    checks = result.get("checks", [])
    blocking = [c for c in checks if c["level"] == "error"]
    said = result.get("qualification")
    if said:
        lines += [said["text"], ""]
    if "n_findings" in result:
        lines += [f"{result['n_findings']} findings, {result['n_effective']} without exceptions.", ""]
        lines += _table(["severity", "findings"], [[s, result["by_severity"].get(s, 0)] for s in SEVERITIES])
        lines += _table(["area", "records", "score"], [[s["area"], s["n_records"], "-" if s["score"] is None else s["score"]] for s in sorted(result.get("scores", []), key=lambda s: s["area"])])
        failed = {r: s for r, s in result["rules"].items() if s.startswith("error")}
        if failed:
            lines += ["## Rules that failed", "", *_table(["rule", "problem"], [[r, s.removeprefix("error: ")] for r, s in sorted(failed.items())])]
    elif blocking:
        lines += ["The run stopped: the delivery cannot be used as it is.", ""]
    if checks:
        lines += ["## Delivery", "", *_table(["check", "level", "table", "text"], [[c["check"], c["level"], c["table"], c["text"]] for c in sorted(checks, key=lambda c: (c["level"] != "error", c["check"], c["table"]))])]
    if result.get("demand"):
        lines += ["## To ask for next", "", *_table(["table", "rules it unlocks"], [list(d) for d in result["demand"]])]
    return "\n".join(lines)


def coverage_csv(coverage: dict[str, dict[str, list[str]]]) -> str:
    """rule_id;executable;table;missing_fields: one line per missing table of a rule, one for a rule that can run."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["rule_id", "executable", "table", "missing_fields"])
    for rule, gaps in sorted(coverage.items()):
        writer.writerows([rule, "no", table, " ".join(fields)] for table, fields in sorted(gaps.items()))
        if not gaps:
            writer.writerow([rule, "yes", "", ""])
    return out.getvalue()
