"""From a table pair to a cleaning plan, column by column, then measured.

Detection reads the dirty table; of the clean one, gates and labels read the
labelled rows and the oracle's answers, and only measuring reads it whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.detector import NOTHING, marks_nothing
from tidyloom.operators import cascade, dependency, metrics, profile, refinement, sampling
from tidyloom.operators.names import RID, col, mask, told
from tidyloom.plans import cleaner
from tidyloom.plans.agents import Item, OfflineMiner, RuleAgent
from tidyloom.plans.model import CleanerPlan, CorrectionRule, Dependency, DetectorRule
from tidyloom.sources.tables import TablePair


@dataclass(frozen=True)
class Settings:
    iterations: int = 5
    per_iteration: int = 2
    precision_floor: float = 0.8
    artifact_bonus: bool = True
    information_threshold: float = dependency.THRESHOLD
    clusters: int = 6
    representatives: int = 12
    correction_tries: int = 3
    model_folder: str | None = None
    seed: int = 0
    python: bool = False  # run rules of kind "code" and detectors outside the compiled language


@dataclass
class ColumnWork:
    name: str
    values: list[str] = field(default_factory=list)
    labels: list[dict] = field(default_factory=list)
    detector: DetectorRule = field(default_factory=lambda: DetectorRule(NOTHING))
    correction: CorrectionRule | None = None
    code_gate: bool | None = None
    found: Dependency | None = None  # marks deviations
    repairs: Dependency | None = None
    dependency_gate: bool | None = None
    log: list[str] = field(default_factory=list)


@dataclass
class Built:
    plan: CleanerPlan
    columns: list[ColumnWork]
    applied: DataFrame
    repair: DataFrame
    total: DataFrame
    detection: DataFrame
    trail: DataFrame
    correction: DataFrame


def _labels(pair: TablePair, work: ColumnWork) -> DataFrame:
    return pair.dirty.sparkSession.createDataFrame([tuple(r.values()) for r in work.labels], f"{RID} long, dirty string, clean string, is_error boolean")


def sample_column(pair: TablePair, name: str, settings: Settings) -> tuple[ColumnWork, DataFrame]:
    dictionary = profile.value_profile(pair.dirty, [name]).select("value", "n")
    vectors = sampling.embedded(dictionary, settings.model_folder).cache()
    work = ColumnWork(name, sampling.representatives(vectors, settings.clusters, settings.representatives, settings.seed))
    asked = pair.dirty.sparkSession.createDataFrame([(v,) for v in work.values], "value string")
    rows = profile.labelled(pair.dirty, pair.clean, name, asked).orderBy(RID).collect()  # at most the labelling budget
    work.labels = [r.asDict() for r in rows]
    return work, vectors


def detect_column(pair: TablePair, work: ColumnWork, vectors: DataFrame, agent: RuleAgent, settings: Settings) -> None:
    try:
        counted = {r["value"]: r["n"] for r in vectors.where(F.col("value").isin(work.values)).select("value", "n").collect()}
        first = agent.propose_detector(work.name, [(v, counted.get(v, 0)) for v in work.values])
        if not first.code.strip():
            first = DetectorRule(NOTHING, first.reasoning)
        if problem := refinement.usable(vectors, first):
            work.log.append(f"detector rejected: {problem}")
            first = DetectorRule(NOTHING, problem)
        work.detector = first
        if settings.iterations > 1 and not marks_nothing(first.code):
            oracle = profile.oracle_labels(pair.dirty, pair.clean, work.name)
            frequencies = {r["char"]: r["df"] for r in profile.character_frequency(pair.dirty, work.name).collect()}  # characters
            work.detector = refinement.refine(
                work.name, first, vectors, oracle, frequencies, agent, settings.iterations, settings.per_iteration, settings.precision_floor, settings.artifact_bonus
            )
    except Exception as e:  # a column's failure stays in the column
        work.log.append(f"detection failed: {told(e)}")


def find_dependency(pair: TablePair, work: ColumnWork, masked: DataFrame, candidates: list[str], agent: RuleAgent) -> Dependency | None:
    """A proposed dependency that passes the gate, under the masks given."""
    tried = list(candidates)
    while tried:
        proposed = agent.propose_dependency(work.name, tried, {})
        if proposed is not None:
            proposed = Dependency(proposed.determinant, work.name, proposed.reasoning)
        if not dependency.valid_names(proposed, pair.columns) or proposed.determinant == work.name:
            return None
        if dependency.gate(masked, _labels(pair, work), proposed):
            return proposed
        work.log.append(f"dependency on {proposed.determinant} failed the gate")
        if not isinstance(agent, OfflineMiner):
            return None
        tried.remove(proposed.determinant)
    return None


def correct_column(pair: TablePair, work: ColumnWork, agent: RuleAgent, settings: Settings) -> None:
    asked = pair.dirty.sparkSession.createDataFrame([(v,) for v in work.values], "dirty string")
    items = [
        Item(r["dirty"], r["frequency"], r["clean"], r["ambiguous"], r["distinct_clean"], tuple(r["examples"]))
        for r in profile.ambiguity_items(pair.dirty.join(F.broadcast(asked), col(work.name) == F.col("dirty"), "left_semi"), pair.clean, work.name).orderBy("dirty").collect()
    ]
    labels, problem = _labels(pair, work), ""
    for _ in range(settings.correction_tries):
        rule = agent.propose_correction(work.name, items, problem)
        if not rule.error_found or rule.kind == "none":
            rule = CorrectionRule("none", reasoning=rule.reasoning, error_found=rule.error_found)
        work.correction = rule
        try:
            work.code_gate = cascade.code_gate(labels, rule, settings.python)
            return
        except Exception as e:  # the rule can't be compiled or run: ask once more
            problem = told(e)
            work.log.append(f"correction rejected: {problem}")
    work.correction, work.code_gate = None, False


def build(pair: TablePair, agent: RuleAgent | None = None, settings: Settings = Settings(), stamp: str = "") -> Built:
    agent = agent or OfflineMiner()
    works: list[ColumnWork] = []
    for name in pair.targets:
        work, vectors = sample_column(pair, name, settings)
        detect_column(pair, work, vectors, agent, settings)
        vectors.unpersist()
        works.append(work)
    detectors = {w.name: w.detector for w in works}
    plan = CleanerPlan(tuple(pair.targets), detectors, dataset=pair.dataset, origin=stamp)

    candidates: dict[str, list[str]] = {w.name: [] for w in works}
    if works:
        place = {c: i for i, c in enumerate(pair.columns)}
        for r in dependency.determinant_candidates(pair.dirty, pair.columns, settings.information_threshold).collect():  # pairs of columns
            if r["target"] in candidates:
                candidates[r["target"]].append((-r["ratio"], place[r["candidate"]], r["candidate"]))
    candidates = {k: [c for *_, c in sorted(v)] for k, v in candidates.items()}
    intra = cleaner.masked(pair.dirty, plan, python=settings.python).cache()
    for w in works:
        if candidates[w.name]:
            try:
                w.found = find_dependency(pair, w, intra, candidates[w.name], agent)
                w.dependency_gate = w.found is not None
            except Exception as e:
                w.log.append(f"dependency failed: {told(e)}")
    plan = CleanerPlan(plan.columns, detectors, detect=tuple(w.found for w in works if w.found), dataset=pair.dataset, origin=stamp)
    both = cleaner.masked(pair.dirty, plan, python=settings.python).cache()
    marked = both.agg(*[F.count_if(col(mask(w.name))).alias(w.name) for w in works]).first().asDict() if works else {}

    for w in works:
        try:
            if marked[w.name]:
                correct_column(pair, w, agent, settings)
                w.repairs = w.found if w.found and dependency.gate(both, _labels(pair, w), w.found) else None
                if not w.found and candidates[w.name]:
                    w.repairs = find_dependency(pair, w, both, candidates[w.name], agent)
        except Exception as e:
            w.correction = w.repairs = None
            w.log.append(f"correction failed: {told(e)}")
    plan = CleanerPlan(
        plan.columns,
        detectors,
        {w.name: w.correction for w in works if w.correction and w.code_gate},
        plan.detect,
        tuple(w.repairs for w in works if w.repairs),
        pair.dataset,
        stamp,
    )
    applied = cleaner.repaired(both, plan, settings.python)
    pairs = metrics.paired(applied, pair.clean, pair.targets)
    holdout = pair.dirty.sparkSession.createDataFrame([(r[RID],) for w in works for r in w.labels], f"{RID} long")
    repair = metrics.repair_metrics(pairs, pair.targets)
    return Built(plan, works, applied, repair, metrics.repair_total(repair), metrics.detection_metrics(pairs, pair.targets, holdout), cleaner.trail_counts(applied, pair.targets), metrics.correction_metrics(pairs, pair.targets, holdout))
