from tidyloom.operators import dependency
from tidyloom.operators.names import RID, col, fixed, flag, mask
from tidyloom.plans import cleaner
from tidyloom.plans.agents import rule
from tidyloom.plans.model import CleanerPlan, CorrectionRule, Dependency
from tidyloom.streaming.cleaner import clean_stream, mode_snapshot

EMPTY = rule("col.eq('')")


def frame(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{RID} long, " + ", ".join(f"`{c}` string" for c in columns))


def values(df, name):
    return [r[0] for r in df.orderBy(RID).select(col(name)).collect()]


def test_basic_plan(spark):
    df = frame(spark, ["depot", "weight", "load", "zone"], [("north", "7 kg", "30 pct", "Z1"), ("north", "9 kg", "30", ""), ("south", "5", "45 pct", "Z4"), ("south", "6", "50", "Z4")])
    plan = CleanerPlan(
        ("weight", "load", "zone", "absent"),
        {"weight": rule("col.str.contains('kg', na=False)"), "load": rule("col.str.contains(' pct', regex=False, na=False)"), "zone": EMPTY},
        {"weight": CorrectionRule("regex_sub", r"\s*kg$", "")},
        correct=(Dependency("depot", "zone"),),
    )
    out = cleaner.apply_plan(df, plan)
    assert values(out, fixed("weight")) == ["7", "9", "5", "6"]
    assert values(out, fixed("zone")) == ["Z1", "Z1", "Z4", "Z4"]
    assert values(out, flag("load")) == [True, False, True, False]
    for r in cleaner.trail_counts(out, ["weight", "load", "zone"]).collect():
        assert r.marked == r.code + r.dependency + r.unresolved
    assert CleanerPlan.from_json(plan.to_json()) == plan


def test_code_goes_before_dependency_and_both_read_the_original(spark):
    df = frame(spark, ["port", "sea"], [("Lund#", ""), ("Lund", "Baltic"), ("Lund", "Baltic"), ("Oban", "Minch")])
    plan = CleanerPlan(("port", "sea"), {"port": rule("col.str.endswith('#', na=False)"), "sea": EMPTY}, {"port": CorrectionRule("regex_sub", "#$", "")}, correct=(Dependency("port", "sea"),))
    out = cleaner.apply_plan(df, plan)
    assert values(out, fixed("port"))[0] == "Lund"
    assert values(out, fixed("sea"))[0] == "" and values(out, flag("sea"))[0]  # its port, as it came, has no group
    assert plan.both_layers() == [] and '"both_layers": []' in plan.to_json()


def test_both_cells_must_be_unmarked(spark):
    df = frame(spark, ["crew", "boat"], [("red", "")] * 4 + [("red", "Tern")] * 3)
    out = cleaner.apply_plan(df, CleanerPlan(("boat",), {"boat": EMPTY}, correct=(Dependency("crew", "boat"),)))
    assert set(values(out, fixed("boat"))) == {"Tern"}
    alone = frame(spark, ["crew", "boat"], [("blue", ""), ("grey", "Gull"), ("grey", "Gull")])
    out = cleaner.apply_plan(alone, CleanerPlan(("boat",), {"boat": EMPTY}, correct=(Dependency("crew", "boat"),)))
    assert values(out, flag("boat")) == [True, False, False]


def test_ties_take_the_smallest_and_chains_read_the_rules_marks(spark):
    tie = frame(spark, ["shelf", "aisle"], [("s9", "right"), ("s9", "left"), ("s9", "right"), ("s9", "left")])
    assert values(dependency.deviations(tie, [Dependency("shelf", "aisle")]), "d__aisle") == [True, False, True, False]
    chain = frame(spark, ["shelf", "aisle", "floor"], [("s1", "left", "two")] + [("s1", "right", "one")] * 2 + [("s2", "left", "one")] * 5)
    marks = dependency.deviations(chain, [Dependency("shelf", "aisle"), Dependency("aisle", "floor")])
    assert values(marks, "d__aisle") == [True] + [False] * 7
    assert values(marks, "d__floor") == [True] + [False] * 7


def test_lists_of_dependencies_may_differ(spark):
    """One marks and doesn't repair, the other repairs what a rule marks."""
    df = frame(spark, ["shelf", "aisle", "floor"], [("s1", "left", "one")] * 3 + [("s1", "right", "")] + [("s2", "up", "two")] * 2)
    plan = CleanerPlan(("aisle", "floor"), {"floor": EMPTY}, detect=(Dependency("shelf", "aisle"),), correct=(Dependency("shelf", "floor"),))
    out = cleaner.apply_plan(df, plan)
    assert values(out, flag("aisle")) == [False] * 3 + [True] + [False] * 2 and values(out, fixed("aisle"))[3] == "right"
    assert values(out, fixed("floor"))[3] == "one" and values(out, "t__floor")[3] == cleaner.BY_DEPENDENCY


def test_mutual_information(spark):
    import math

    df = frame(spark, ["hue", "code", "tag"], [("red", "r", "t1"), ("red", "r", "t2"), ("red", "r", "t3"), ("tan", "t", "t4"), ("tan", "t", "t5"), ("tan", "t", "t6")])
    got = {(r.target, r.candidate): r.mi for r in dependency.mutual_information(df, ["hue", "code", "tag"]).collect()}
    assert math.isclose(got["hue", "hue"], math.log(2)) and math.isclose(got["hue", "code"], math.log(2)) and ("hue", "tag") not in got
    assert [(r.target, r.candidate) for r in dependency.determinant_candidates(df, ["hue", "code", "tag"]).orderBy("target").collect()] == [("code", "hue"), ("hue", "code")]


def test_gate_leaves_a_clean_row_out(spark):
    df = frame(spark, ["bay", "kind"], [("b1", "wet"), ("b1", "wet"), ("b1", "dyr"), ("b2", "dry")]).withColumn(mask("kind"), col("kind") == "dyr")
    labels = lambda rows: spark.createDataFrame(rows, f"{RID} long, clean string, is_error boolean")
    assert dependency.gate(df, labels([(2, "wet", True), (1, "wet", False), (3, "dry", False)]), Dependency("bay", "kind"))
    assert not dependency.gate(df, labels([(2, "dry", True)]), Dependency("bay", "kind"))
    assert dependency.gate(df, labels([]), Dependency("bay", "kind"))


def test_stream_with_a_snapshot(spark, tmp_path):
    rows = [("red", "Tern"), ("red", "Tern"), ("red", ""), ("blue", "Gull")]
    table = frame(spark, ["crew", "boat"], rows)
    table.write.parquet(str(tmp_path / "in"))
    fd = Dependency("crew", "boat")
    plan = CleanerPlan(("boat",), {"boat": EMPTY})
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = clean_stream(stream, plan, mode_snapshot(table, plan, [fd]), [fd])
    q = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("cleaned"), fixed("boat")) == ["Tern", "Tern", "Tern", "Gull"]
    assert values(spark.table("cleaned"), "t__boat") == [None, None, "dependency", None]
