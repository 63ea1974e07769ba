"""Refining a detector against an oracle on a bounded number of values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.detector import NOTHING, RuleRejected, compile_detector, marks_nothing
from tidyloom.operators.names import told
from tidyloom.operators.sampling import oracle_sample
from tidyloom.plans.agents import OracleLabel, RuleAgent
from tidyloom.plans.model import DetectorRule

FLOOR = 0.8


def feedback_text(labels: Sequence[OracleLabel]) -> str:
    """All labels so far: missed errors, false alarms, and what was right."""
    lines = []
    for x in labels:
        if x.is_error and not x.marked:
            lines.append(f"MISSED {x.value!r}: it is an error and was not marked")
        elif x.marked and not x.is_error:
            lines.append(f"FALSE ALARM {x.value!r}: it is correct and was marked")
        else:
            lines.append(f"OK {x.value!r}: {'an error, marked' if x.marked else 'correct, left alone'}")
    return "\n".join(lines)


def precision(labels: Sequence[OracleLabel]) -> float | None:
    marked = [x for x in labels if x.marked]
    return sum(x.is_error for x in marked) / len(marked) if marked else None


def classify(dictionary: DataFrame, code: str, values: Sequence[str]) -> dict[str, bool]:
    """What the rule says of each value; a rule that fails marks nothing."""
    if not values:
        return {}
    try:
        rows = dictionary.where(F.col("value").isin(list(values))).select("value", compile_detector(code, F.col("value")).alias("m")).distinct().collect()
    except (RuleRejected, PySparkException):
        return dict.fromkeys(values, False)
    return dict.fromkeys(values, False) | {r["value"]: r["m"] for r in rows}


def usable(dictionary: DataFrame, rule: DetectorRule) -> str | None:
    """Why a rule can't be used, or None. It is compiled, and run on five values."""
    try:
        dictionary.limit(5).select(compile_detector(rule.code, F.col("value"))).collect()
    except (RuleRejected, PySparkException) as e:
        return told(e)
    return None


def refine(
    column: str,
    rule: DetectorRule,
    vectors: DataFrame,
    oracle: DataFrame,
    frequencies: dict[str, int],
    agent: RuleAgent,
    iterations: int = 5,
    per_iteration: int = 2,
    floor: float = FLOOR,
    bonus: bool = True,
    used: Sequence[str] = (),
) -> DetectorRule:
    """vectors: value, vector of the column's distinct values; oracle: value,
    is_error. Each iteration labels new values, shows all labels so far to the
    agent, and takes its revision unless that is less precise on the labels than
    ``floor``. A final rule under the floor is replaced by one that marks nothing."""
    if iterations <= 1 or marks_nothing(rule.code):
        return rule
    seen, known, history = list(used), {}, []
    for number in range(1, iterations + 1):
        sampled = oracle_sample(vectors, compile_detector(rule.code, F.col("value")), seen, per_iteration, frequencies, bonus)
        step = {"iteration": number, "sampled": sampled, "before": rule.code, "after": rule.code, "changed": False}
        if not sampled:
            history.append(step | {"status": "no_sample"})
            continue
        seen += sampled
        known |= {r["value"]: r["is_error"] for r in oracle.where(F.col("value").isin(sampled)).collect()}
        marked = classify(vectors, rule.code, list(known))
        labels = [OracleLabel(v, e, marked[v]) for v, e in known.items()]
        try:
            revised = agent.revise_detector(column, rule, labels, feedback_text(labels))
            problem = usable(vectors, revised)
        except Exception as e:  # whatever an agent does wrong, the rule stays
            revised, problem = rule, told(e)
        if problem:
            history.append(step | {"status": f"rejected: {problem}"})
            continue
        now = classify(vectors, revised.code, list(known))
        p = precision([OracleLabel(v, e, now[v]) for v, e in known.items()])
        if p is not None and p < floor:
            history.append(step | {"status": f"rejected: precision {p:.2f}"})
            continue
        changed = revised.code != rule.code
        rule = replace(revised, history=rule.history)
        history.append(step | {"after": rule.code, "changed": changed, "status": "kept"})
    final = classify(vectors, rule.code, list(known))
    p = precision([OracleLabel(v, e, final[v]) for v, e in known.items()])
    if p is not None and p < floor:
        rule = DetectorRule(NOTHING, f"precision {p:.2f} on the oracle's labels is under {floor}")
    return replace(rule, history=tuple(history), oracle_labels=len(known))
