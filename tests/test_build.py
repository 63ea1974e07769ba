import json

import pytest

from tidyloom.cli import main
from tidyloom.plans.model import CleanerPlan, CorrectionRule
from tidyloom.sources.tables import InvalidData, dataset_name, load_pair, read_literal_csv, with_row_key


def write(path, rows):
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def files(tmp_path):
    clean = [f"{i},{'ab'[i % 2]},{12 + i % 3}" for i in range(20)]
    dirty = [f"{i},{'ab'[i % 2]},{'N/A' if i % 4 == 0 else 12 + i % 3}" for i in range(20)]
    blank = [c if i % 4 else f"{i},{'ab'[i % 2]}," for i, c in enumerate(clean)]
    return write(tmp_path / "t_dirty.csv", ["index,group,size", *dirty]), write(tmp_path / "t_clean.csv", ["index,group,size", *blank]), tmp_path


def test_literal_reading(spark, tmp_path):
    path = write(tmp_path / "x.csv", ["a,b-c,d.e", 'N/A,,"q ""x"" \\n"', " null,NaN,\"two\nlines\"", "1"])
    rows = read_literal_csv(spark, path).orderBy("_rid").collect()
    assert [tuple(r)[:3] for r in rows] == [("N/A", "", 'q "x" \\n'), (" null", "NaN", "two\nlines"), ("1", "", "")]
    assert [r["_rid"] for r in rows] == [0, 1, 2]
    assert dataset_name("/x/beers_dirty_300.csv") == "beers_300"


def test_row_keys_over_partitions(spark):
    df = with_row_key(spark.range(100).repartition(3))
    assert sorted(r["_rid"] for r in df.select("_rid").collect()) == list(range(100))


def test_invalid_data(spark, files):
    dirty, clean, folder = files
    with pytest.raises(InvalidData):
        load_pair(spark, dirty, str(folder / "absent.csv"))
    with pytest.raises(InvalidData):
        load_pair(spark, dirty, clean, ["absent"])
    assert load_pair(spark, dirty, clean).targets == ("group", "size")
    assert load_pair(spark, dirty, clean, []).targets == ()
    assert main(["build", "--dirty", dirty, "--clean", str(folder / "absent.csv")], spark) == 1


def test_build_apply_and_score(spark, files, capsys):
    dirty, clean, folder = files
    assert main(["build", "--dirty", dirty, "--clean", clean, "--out", str(folder / "runs"), "--iterations", "2"], spark) == 0
    run = next((folder / "runs").iterdir())
    plan = CleanerPlan.from_json((run / "plan.json").read_text())
    assert plan.correctors["size"].kind == "constant"
    total = json.loads((run / "repair.json").read_text())["total"]
    assert (total["errors"], total["tp"], total["precision"], total["recall"]) == (5, 5, 1.0, 1.0)
    assert "size" in (run / "cascade.md").read_text() and "isin" in (run / "detection.md").read_text()
    assert main(["apply", "--plan", str(run / "plan.json"), dirty], spark) == 0
    fixed = spark.read.option("header", True).csv(dirty.removesuffix(".csv") + "_corrected.csv").na.fill("")
    assert fixed.where("size = 'N/A'").count() == 0 and fixed.count() == 20
    assert main(["score", "--plan", str(run / "plan.json"), "--dirty", dirty, "--clean", clean], spark) == 0
    assert main(["apply", "--plan", "p"], spark) == 2
    with pytest.raises(ValueError):
        CorrectionRule("guess")
