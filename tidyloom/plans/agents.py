"""Who proposes rules: a protocol, fixed rules, an offline miner, a chat model.

Agents live on the driver and see small things only: representatives with their
counts, labelled values, candidate names. What they propose passes the gates
before it is used.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from tidyloom.functions.detector import NOTHING, gate
from tidyloom.plans.model import CorrectionRule, Dependency, DetectorRule


@dataclass(frozen=True)
class OracleLabel:
    value: str
    is_error: bool
    marked: bool = False


@dataclass(frozen=True)
class Item:
    dirty: str
    frequency: int
    clean: str
    ambiguous: bool
    distinct_clean: int
    examples: tuple[str, ...]


class RuleAgent(Protocol):
    def propose_detector(self, column: str, values: Sequence[tuple[str, int]]) -> DetectorRule: ...

    def revise_detector(self, column: str, rule: DetectorRule, labels: Sequence[OracleLabel], feedback: str) -> DetectorRule: ...

    def propose_correction(self, column: str, items: Sequence[Item], problem: str = "") -> CorrectionRule: ...

    def propose_dependency(self, column: str, candidates: Sequence[str], profile: dict) -> Dependency | None: ...


def rule(expression: str, reasoning: str = "", pattern: str | None = None) -> DetectorRule:
    return DetectorRule(f"def detectar(col):\n    return {expression}\n", reasoning, pattern)


class StaticAgent:
    """Rules that the user wrote; replays fixtures."""

    def __init__(self, detectors: dict | None = None, corrections: dict | None = None, dependencies: dict | None = None):
        self.detectors, self.corrections, self.dependencies = detectors or {}, corrections or {}, dependencies or {}

    def propose_detector(self, column, values):
        return self.detectors.get(column, DetectorRule(NOTHING))

    def revise_detector(self, column, rule, labels, feedback):
        return rule

    def propose_correction(self, column, items, problem=""):
        return self.corrections.get(column, CorrectionRule(error_found=False))

    def propose_dependency(self, column, candidates, profile):
        found = self.dependencies.get(column)
        return Dependency(found, column) if found in candidates else None


SENTINELS = ("N/A", "n/a", "NA", "null", "NULL", "None", "nan", "NaN", "-", "?", "unknown", "Unknown")


def shape(text: str) -> str:
    """Digits as 9, letters as A, runs once."""
    return re.sub(r"A+", "A", re.sub(r"[^\W\d_]", "A", re.sub(r"\d+", "9", text)))


def shape_pattern(form: str) -> str:
    return "".join({"9": r"\d+", "A": r"[^\W\d_]+"}.get(c, re.escape(c)) for c in form)


class OfflineMiner:
    """Finds what errors share and clean values lack: a sentinel, an affix, a rare
    character, a shape; and for repairs a constant, an affix to strip, a mapping."""

    floor = 0.8

    def propose_detector(self, column, values):
        """Dirty values only: well-known sentinels are all that can be told."""
        held = [v for v, _ in values]
        found = [s for s in SENTINELS if s in held]
        if found and len(found) < len(held):
            return rule(f"col.isin({found!r})", "well-known sentinels among the values")
        return DetectorRule(NOTHING, "no form of error can be told from the values alone")

    def revise_detector(self, column, rule_now, labels, feedback):
        wrong = [x.value for x in labels if x.is_error]
        right = [x.value for x in labels if not x.is_error]
        if not wrong:
            return rule_now
        best, score = rule_now, sum(x.marked == x.is_error for x in labels)
        for expression, test in self._markers(wrong):
            hits = [test(v) for v in wrong]
            false = [test(v) for v in right]
            if sum(hits) and sum(hits) / (sum(hits) + sum(false)) >= self.floor and (now := sum(hits) + false.count(False)) > score:
                best, score = rule(expression, f"marks {sum(hits)} of {len(wrong)} labelled errors and {sum(false)} of {len(right)} others"), now
        return best

    def _markers(self, wrong: Sequence[str]):
        for v, _ in Counter(wrong).most_common():
            yield f"col.eq({v!r})", lambda x, v=v: x == v
        for ends, method in ((str.endswith, "endswith"), (str.startswith, "startswith")):
            affixes = Counter(a for v in set(wrong) for a in self._affixes(v, method))
            for a, _ in sorted(affixes.items(), key=lambda p: (-p[1], -len(p[0]), p[0]))[:20]:
                yield f"col.str.{method}({a!r}, na=False)", lambda x, a=a, ends=ends: ends(x, a)
        for c, _ in Counter(c for v in set(wrong) for c in set(v) if not c.isalnum() and not c.isspace()).most_common(10):
            yield f"col.str.contains({c!r}, regex=False, na=False)", lambda x, c=c: c in x
        for form, _ in Counter(map(shape, wrong)).most_common(5):
            if form:
                pattern = shape_pattern(form)
                yield f"col.str.fullmatch({pattern!r}, na=False)", lambda x, p=pattern: re.fullmatch(p, x) is not None

    @staticmethod
    def _affixes(v: str, method: str):
        parts = [m.start() for m in re.finditer(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)|(?<=\d)(?=\D)|(?<=\D)(?=\d)", v)]
        return {v[i:] for i in parts} if method == "endswith" else {v[:i] for i in parts}

    def propose_correction(self, column, items, problem=""):
        wrong = [i for i in items if i.dirty != i.clean]
        if not wrong:
            return CorrectionRule(error_found=False)
        clear = [i for i in wrong if not i.ambiguous and i.dirty != ""]
        tries = []
        tails = Counter(i.dirty.removeprefix(i.clean) for i in clear if i.clean and i.dirty.startswith(i.clean))
        if tails:
            pattern = r"\s*(?:" + "|".join(sorted((re.escape(t.strip()) for t in tails if t.strip()), key=lambda t: (-len(t), t))) + ")$"
            tries.append(CorrectionRule("regex_sub", pattern, "", guard=pattern, error_kind="affix"))
        heads = Counter(i.dirty.removesuffix(i.clean) for i in clear if i.clean and i.dirty.endswith(i.clean))
        if heads:
            pattern = "^(?:" + "|".join(sorted((re.escape(h) for h in heads if h), key=lambda t: (-len(t), t))) + ")"
            tries.append(CorrectionRule("regex_sub", pattern, "", guard=pattern, error_kind="affix"))
        targets = {i.clean for i in clear}
        if len(targets) == 1 and clear:
            guard = "^(?:" + "|".join(sorted(re.escape(i.dirty) for i in clear)) + ")$"
            tries.append(CorrectionRule("constant", value=targets.pop(), guard=guard, error_kind="sentinel"))
        if clear:
            guard = "^(?:" + "|".join(sorted(re.escape(i.dirty) for i in clear)) + ")$"
            tries.append(CorrectionRule("mapping", mapping={i.dirty: i.clean for i in clear}, guard=guard, error_kind="inconsistent_abbreviation"))
        for t in tries:
            if all(self._applied(t, i.dirty) == i.clean for i in items if not i.ambiguous and i.dirty != ""):
                return t
        return CorrectionRule(error_found=bool(wrong))

    @staticmethod
    def _applied(t: CorrectionRule, v: str) -> str:
        if t.guard and not re.search(t.guard, v):
            return v
        if t.kind == "constant":
            return t.value or ""
        if t.kind == "mapping":
            return (t.mapping or {}).get(v, v)
        return re.sub(t.pattern or "", t.replacement or "", v)

    def propose_dependency(self, column, candidates, profile):
        return Dependency(candidates[0], column, "the candidate with the most mutual information") if candidates else None


class ChatAgent(OfflineMiner):
    """Asks a chat endpoint (OpenAI's or Ollama's wire format) for rules as JSON
    and falls back to the miner's answer when it gives none. Nothing is sent
    unless the user builds one."""

    TIMEOUTS = {"openai": 180, "ollama": 900}

    def __init__(self, provider: str, model: str, url: str, key: str = "", role_models: dict[str, str] | None = None, timeout: float | None = None):
        if provider not in self.TIMEOUTS:
            raise ValueError(f"unknown provider: {provider}")
        self.provider, self.model, self.url, self.key = provider, model, url.rstrip("/"), key
        self.role_models, self.timeout = role_models or {}, timeout or self.TIMEOUTS[provider]

    def model_of(self, role: str) -> str:
        return self.role_models.get(role) or self.model

    def ask(self, role: str, task: str, facts: object) -> dict:
        from urllib.request import Request, urlopen

        messages = [{"role": "system", "content": task + " Answer with one JSON object."}, {"role": "user", "content": json.dumps(facts, ensure_ascii=False)}]
        body = {"model": self.model_of(role), "messages": messages, "stream": False}
        if self.provider == "openai":
            path, body = "/v1/chat/completions", body | {"temperature": 0, "response_format": {"type": "json_object"}}
        else:
            path, body = "/api/chat", body | {"options": {"temperature": 0}, "format": "json"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(self.url + path, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            got = json.load(answer)
        text = got["choices"][0]["message"]["content"] if self.provider == "openai" else got["message"]["content"]
        return json.loads(text)

    def propose_detector(self, column, values):
        task = "Write a Python function detectar(col) over a pandas string column that marks malformed values by their shared form. Keys: code, reasoning."
        return self._detector(self.ask("detection", task, {"column": column, "values": values}), super().propose_detector(column, values))

    def revise_detector(self, column, rule_now, labels, feedback):
        task = "Change at most one thing in the function so that it agrees with the feedback. Keys: code, reasoning."
        return self._detector(self.ask("detection", task, {"column": column, "code": rule_now.code, "feedback": feedback}), rule_now)

    @staticmethod
    def _detector(answer: dict, otherwise: DetectorRule) -> DetectorRule:
        return DetectorRule(answer["code"], str(answer.get("reasoning", ""))) if isinstance(answer.get("code"), str) and answer["code"].strip() else otherwise

    def propose_correction(self, column, items, problem=""):
        task = "Give a repair. Keys: kind (regex_sub, mapping, constant, none), pattern, replacement, mapping, value, guard, reasoning."
        answer = self.ask("specifier", task, {"column": column, "items": [i.__dict__ for i in items], "problem": problem})
        known = {k: v for k, v in answer.items() if k in CorrectionRule.__dataclass_fields__}
        return CorrectionRule(**known)

    def propose_dependency(self, column, candidates, profile):
        answer = self.ask("dependency", "Which candidate determines the column? Keys: determinant (or None), reasoning.", {"column": column, "candidates": candidates, "rows": profile})
        return Dependency(str(answer.get("determinant")), column, str(answer.get("reasoning", "")))


def _detects(agent: RuleAgent) -> bool:
    found = agent.propose_detector("weight", [("12 kg", 40), ("12", 30), ("15 kg", 9), ("15", 8)])
    gate(found.code)
    return True


def _revises(agent: RuleAgent) -> bool:
    labels = [OracleLabel("12 kg", True, False), OracleLabel("12", False, False)]
    found = agent.revise_detector("weight", DetectorRule(NOTHING), labels, "MISSED '12 kg': it is an error and was not marked")
    gate(found.code)
    return True


def _repairs(agent: RuleAgent) -> bool:
    found = agent.propose_correction("weight", [Item("12 kg", 40, "12", False, 1, ("12",)), Item("15 kg", 9, "15", False, 1, ("15",))])
    return OfflineMiner._applied(found, "17 kg") == "17"


def _depends(agent: RuleAgent) -> bool:
    found = agent.propose_dependency("region", ["town", "colour"], {"town": [["Ulm", "south"]], "colour": [["red", "south"]]})
    return found is not None and found.determinant in ("town", "colour")


#: A case for each role: the answer's form is right if it raises nothing, and it passes the gate if true.
CASES = [("detection", _detects), ("revision", _revises), ("specifier", _repairs), ("dependency", _depends)]


def suitability(agent: RuleAgent, cases: Sequence[tuple[str, object]], repetitions: int = 3) -> dict[str, dict[str, int]]:
    """How often each role's answer has the right form, and how often it passes
    a check: cases are (role, callable(agent) -> bool)."""
    out: dict[str, dict[str, int]] = {}
    for role, case in cases:
        score = out.setdefault(role, {"form": 0, "gate": 0, "tries": 0})
        for _ in range(repetitions):
            score["tries"] += 1
            try:
                passed = case(agent)
            except Exception:  # a model's answer may fail in any way
                continue
            score["form"] += 1
            score["gate"] += bool(passed)
    return out
