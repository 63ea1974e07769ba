from tidyloom.operators import cascade, metrics, profile, refinement, sampling
from tidyloom.operators.names import RID
from tidyloom.plans.agents import Item, OfflineMiner, OracleLabel, StaticAgent, rule, suitability
from tidyloom.plans.model import CorrectionRule


def pairs(spark):
    rows = [(0, "x", "x", True), (1, "b", "B", True), (2, "c", "C", False), (3, "d", "d", False), (4, "e", "e", False)]
    df = spark.createDataFrame(rows, f"{RID} long, v string, k__v string, m__v boolean")
    return df.selectExpr("*", "case when v = 'b' then 'B' else v end as x__v", "m__v and v = 'x' as f__v")


def test_detection(spark):
    r = metrics.detection_metrics(pairs(spark), ["v"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (1, 1, 1, 2, 0.5, 0.5, 0.5)
    held = spark.createDataFrame([(0,)], f"{RID} long")
    r = metrics.detection_metrics(pairs(spark), ["v"], held).first()
    assert (r.precision, r.recall) == (1.0, 0.5)


def test_no_errors_gives_no_ratio(spark):
    clean = spark.createDataFrame([(0, "a", "a", True)], f"{RID} long, v string, k__v string, m__v boolean")
    r = metrics.detection_metrics(clean, ["v"]).first()
    assert (r.precision, r.recall, r.f1, r.fp, r.measurable) == (None, None, None, 1, False)
    r = metrics.repair_metrics(clean, ["v"]).first()
    assert (r.precision, r.recall, r.f1) == (None, None, None)
    assert metrics.repair_total(metrics.repair_metrics(clean, ["v"])).first().recall == 0.0


def test_repair_and_correction(spark):
    r = metrics.repair_metrics(pairs(spark), ["v"]).first()
    assert (r.errors, r.changes, r.tp, r.flags, r.precision, r.recall) == (2, 1, 1, 1, 1.0, 0.5)
    c = metrics.correction_metrics(pairs(spark), ["v"]).first()
    assert (c.wrong, c.right, c.hits, c.damage, c.hit_rate, c.damage_rate) == (2, 3, 1, 0, 0.5, 0.0)


def test_code_gate(spark):
    labels = spark.createDataFrame([("12 oz", "12"), ("13", "13")], "dirty string, clean string")
    assert cascade.code_gate(labels, CorrectionRule("regex_sub", " oz$", ""))
    assert not cascade.code_gate(labels, CorrectionRule("constant", value="12"))
    assert not cascade.code_gate(labels, None)


def test_profiles(spark):
    df = spark.createDataFrame([(i, "9") for i in range(10)] + [(10, "3")], f"{RID} long, v string")
    assert {r.char: r.df for r in profile.character_frequency(df, "v").collect()} == {"9": 10, "3": 1}
    score = df.select("v", profile.artifact_score(df.v, {"9": 10, "3": 1}).alias("s")).distinct()
    assert {r.v: r.s for r in score.collect()} == {"9": 0.1, "3": 1.0}
    clean = df.selectExpr(RID, "case when _rid < 2 then 'z' else v end as v")
    item = profile.ambiguity_items(df, clean, "v").where("dirty = '9'").first()
    assert (item.frequency, item.clean, item.ambiguous, item.distinct_clean, item.examples) == (10, "z", True, 2, ["z", "9"])
    assert {r.value: r.is_error for r in profile.oracle_labels(df, clean, "v").collect()} == {"9": True, "3": False}


def test_precision_and_feedback():
    labels = [OracleLabel("A", True, True), OracleLabel("B", True), OracleLabel("C", False, True), OracleLabel("D", False, True)]
    assert refinement.precision(labels) == 1 / 3
    assert refinement.precision([OracleLabel("A", True)]) is None
    text = refinement.feedback_text(labels)
    assert "MISSED 'B'" in text and "FALSE ALARM 'C'" in text


def test_sampling(spark):
    few = sampling.embedded(spark.createDataFrame([(f"v{i}",) for i in range(5)], "value string"))
    assert sampling.representatives(few) == [f"v{i}" for i in range(5)]
    many = sampling.embedded(spark.createDataFrame([(f"{i}.0 oz",) for i in range(40)] + [("N/A",), ("",)], "value string"))
    picks = sampling.representatives(many)
    assert len(picks) <= 12 and picks == sampling.representatives(many)
    line = spark.createDataFrame([(str(x), [float(x)]) for x in (0, 1, 2, 10)], "value string, vector array<float>")
    assert sampling.diverse(line, [[0.0]], 2) == ["10", "2"]
    assert sampling.diverse(line, [], 9) == ["0", "1", "10", "2"]
    odd = sampling.suspicious(line, [[0.0]], 1, {})
    assert odd == ["10"]


def test_refinement_keeps_the_floor(spark):
    values = [f"{i}.0 oz" for i in range(6)] + [f"{i}.0" for i in range(6)]
    vectors = sampling.embedded(spark.createDataFrame([(v,) for v in values], "value string"))
    oracle = spark.createDataFrame([(v, v.endswith("oz")) for v in values], "value string, is_error boolean")
    wide = rule("col.str.contains('.', regex=False, na=False)")
    kept = refinement.refine("ounces", wide, vectors, oracle, {}, StaticAgent(), iterations=4)
    assert "isin([])" in kept.code and kept.oracle_labels > 0 and len(kept.history) == 4
    mined = refinement.refine("ounces", wide, vectors, oracle, {}, OfflineMiner(), iterations=4)
    assert "oz" in mined.code
    assert refinement.refine("ounces", wide, vectors, oracle, {}, StaticAgent(), iterations=1) is wide


def test_miner_and_suitability():
    miner = OfflineMiner()
    item = lambda dirty, clean, ambiguous=False: Item(dirty, 1, clean, ambiguous, 1, (clean,))
    assert miner.propose_correction("c", [item("12 oz", "12"), item("13", "13")]).kind == "regex_sub"
    assert miner.propose_correction("c", [item("N/A", ""), item("3", "3")]).kind == "constant"
    assert miner.propose_correction("c", [item("a", "x"), item("b", "y")]).kind == "mapping"
    assert not miner.propose_correction("c", [item("a", "a")]).error_found

    def fails(agent):
        raise ValueError

    assert suitability(miner, [("fd", lambda a: True), ("code", fails)], 2) == {"fd": {"form": 2, "gate": 2, "tries": 2}, "code": {"form": 0, "gate": 0, "tries": 2}}
