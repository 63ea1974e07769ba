"""Reports of a run: small texts and JSON from aggregated frames."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from tidyloom.operators.names import RID, col, mask
from tidyloom.plans import cleaner
from tidyloom.plans.build import Built
from tidyloom.sources.tables import TablePair, run_folder, write_json, write_table, write_text


def _round(x: object) -> object:
    return round(x, 4) if isinstance(x, float) else x


def rows_of(df: DataFrame) -> list[dict]:
    return [{k: _round(v) for k, v in r.asDict().items()} for r in df.collect()]  # one row a column


def text_table(rows: list[dict]) -> str:
    if not rows:
        return "(nothing)"
    names = list(rows[0])
    cells = [names, *[["-" if r[n] is None else str(r[n]) for n in names] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip() for c in cells)


def cascade_report(built: Built) -> str:
    counted = rows_of(built.trail)
    lines = ["# Cascade", "", "| column | marked | code | dependency | unresolved |", "|-|-|-|-|-|"]
    for r in counted:
        lines.append(f"| {r['col_name']} | {r['marked']} | {r['code']} | {r['dependency']} | {r['unresolved']} |")
        if r["marked"] != r["code"] + r["dependency"] + r["unresolved"]:
            lines.append(f"| {r['col_name']}: the layers do not add up | | | | |")
    lines += ["", "## Gates", ""]
    for w in built.columns:
        kind = w.correction.kind if w.correction else "-"
        found = w.repairs.determinant if w.repairs else "-"
        lines.append(f"- {w.name}: correction {kind} ({_gate(w.code_gate)}), dependency on {found}" + "".join(f"; {x}" for x in w.log))
    return "\n".join(lines) + "\n"


def _gate(passed: bool | None) -> str:
    return {None: "not asked", True: "passed", False: "failed"}[passed]


def detection_report(built: Built) -> str:
    by_name = {r["col_name"]: r for r in rows_of(built.detection)}
    lines = ["# Detection"]
    for w in built.columns:
        m = by_name.get(w.name, {})
        lines += ["", f"## {w.name}", "", f"precision {m.get('precision')}, recall {m.get('recall')}, f1 {m.get('f1')}", ""]
        lines += [w.detector.reasoning or "(no reasoning)", "", "```python", w.detector.code.rstrip(), "```"]
        if w.detector.pattern:
            lines.append(f"- pattern: `{w.detector.pattern}`")
        for step in w.detector.history:
            lines.append(f"- iteration {step['iteration']}: {step['status']}; looked at {step['sampled']}")
            if step["changed"]:
                lines += ["  before:", "```python", step["before"].rstrip(), "```", "  after:", "```python", step["after"].rstrip(), "```"]
        if w.found:
            lines.append(f"- deviations from {w.found.determinant}: {w.found.reasoning}")
        if w.correction:
            said = {k: v for k, v in asdict(w.correction).items() if v not in (None, "", "none") and k in ("kind", "pattern", "replacement", "mapping", "value", "guard", "code", "reasoning")}
            lines.append(f"- correction ({_gate(w.code_gate)}): {json.dumps(said, ensure_ascii=False)}")
    return "\n".join(lines) + "\n"


def write_run(spark: SparkSession, pair: TablePair, built: Built, base: str, stamp: str, mode: str = "offline") -> str:
    """Mask, repaired table, flags, plan, metrics and reports in one folder."""
    folder = run_folder(base, stamp, mode)
    names = list(pair.columns)
    write_table(built.applied.select(RID, *[col(mask(c)).alias(c) for c in pair.targets]), f"{folder}/mask", "csv")
    write_table(cleaner.corrected(built.applied, pair.targets, [RID, *names]), f"{folder}/corrected", "csv")
    write_table(cleaner.flags(built.applied, pair.targets, [RID]), f"{folder}/flags", "csv")
    write_text(spark, f"{folder}/plan.json", built.plan.to_json())
    write_json(spark, f"{folder}/detection.json", rows_of(built.detection))
    write_json(spark, f"{folder}/correction.json", rows_of(built.correction))
    write_json(spark, f"{folder}/repair.json", {"columns": rows_of(built.repair), "total": rows_of(built.total)[0] if pair.targets else {}})
    write_text(spark, f"{folder}/cascade.md", cascade_report(built))
    write_text(spark, f"{folder}/detection.md", detection_report(built))
    return folder
