"""What a cleaning plan consists of; plain data, written as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# The kinds of error and of change that rules may name.
ERROR_KINDS = ("affix", "number_format", "sentinel", "missing", "inconsistent_abbreviation", "none", "other")
CHANGE_KINDS = ("regex_sub", "mapping", "constant", "none", "code")


@dataclass(frozen=True)
class DetectorRule:
    code: str
    reasoning: str = ""
    pattern: str | None = None
    history: tuple = ()
    oracle_labels: int = 0


@dataclass(frozen=True)
class CorrectionRule:
    kind: str = "none"
    pattern: str | None = None
    replacement: str | None = None
    mapping: dict[str, str] | None = None
    value: str | None = None
    guard: str | None = None
    code: str | None = None  # Python, for kind "code" alone; runs in batches on the executors
    error_kind: str = "none"
    error_found: bool = True
    reasoning: str = ""
    confidence: float = 1.0

    def __post_init__(self):
        if self.kind not in CHANGE_KINDS:
            raise ValueError(f"unknown kind of change: {self.kind}")
        if self.error_kind not in ERROR_KINDS:
            raise ValueError(f"unknown kind of error: {self.error_kind}")
        if not 0.0 <= self.confidence <= 1.0:
            raise ValueError("confidence must be between 0 and 1")


@dataclass(frozen=True)
class Dependency:
    """determinant -> dependent, one column each."""

    determinant: str
    dependent: str
    reasoning: str = ""


@dataclass(frozen=True)
class CleanerPlan:
    """detect: dependencies whose deviations are marked; correct: dependencies
    that repair. They may differ in both directions."""

    columns: tuple[str, ...]
    detectors: dict[str, DetectorRule] = field(default_factory=dict)
    correctors: dict[str, CorrectionRule] = field(default_factory=dict)
    detect: tuple[Dependency, ...] = ()
    correct: tuple[Dependency, ...] = ()
    dataset: str = ""
    origin: str = ""

    def both_layers(self) -> list[str]:
        """Columns repaired by a rule and by a dependency."""
        by_dependency = {d.dependent for d in self.correct}
        return [c for c in self.columns if c in self.correctors and self.correctors[c].kind != "none" and c in by_dependency]

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"both_layers": self.both_layers(), "warning": "rules generalise the form of the errors that were seen; review before use"}, ensure_ascii=False, indent=1)

    @staticmethod
    def from_json(text: str) -> CleanerPlan:
        raw = json.loads(text)
        return CleanerPlan(
            columns=tuple(raw["columns"]),
            detectors={k: DetectorRule(**v | {"history": tuple(v.get("history", ()))}) for k, v in raw["detectors"].items()},
            correctors={k: CorrectionRule(**v) for k, v in raw["correctors"].items()},
            detect=tuple(Dependency(**d) for d in raw["detect"]),
            correct=tuple(Dependency(**d) for d in raw["correct"]),
            dataset=raw.get("dataset", ""),
            origin=raw.get("origin", ""),
        )
