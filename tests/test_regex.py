import random
import re

import pytest

from tidyloom.functions import regex

PATTERNS = [r"\d+", r"^\w+$", r"x$", r"a.b", r"(?i)À", r"\s+$", r"(?P<a_b>a)(?P=a_b)", r"[^\s]x", r"[a-z&]+", r"a\Z", r"\bword\b", r"[]a]+", r"(?#note)ab"]
TEXTS = ["٣", "é1", "x\r", "x\n", "a\x85b", "à", "a\x1c", "aa", " x", "&", "a", "word", "]a", "ab", "", "A", "x", "\x1fx"]


def test_search_agrees_with_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in PATTERNS:
        got = {r.t: r.m for r in rows.select("t", rows.t.rlike(regex.search(p)).alias("m")).collect()}
        assert got == {t: re.search(p, t) is not None for t in TEXTS}, p


def test_match_and_fullmatch(spark):
    rows = spark.createDataFrame([("ab",), ("ab\n",), ("xab",)], "t string")
    assert [r[0] for r in rows.select(rows.t.rlike(regex.fullmatch("ab"))).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(rows.t.rlike(regex.match("a"))).collect()] == [True, True, False]


def test_random_replacements_agree_with_python(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(1), []
    for _ in range(400):
        text = "".join(rng.choice("ab $\\1{}") for _ in range(rng.randrange(6)))
        try:
            rows.append((regex.java_replacement(text), re.sub("(a)", text, "xay")))
        except (re.error, regex.UnsupportedPattern):
            continue
    df = spark.createDataFrame(rows, "java string, want string")
    assert len(rows) > 100 and df.where(F.regexp_replace(F.lit("xay"), F.lit("(a)"), F.col("java")) != F.col("want")).collect() == []


def test_replacements_in_spark(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("ab1",)], "t string")
    for pattern, new in [(r"([a-z]+)([0-9])", r"\1_\2"), (r"(?P<x>[a-z]+)", r"<\g<x>>"), ("ab", "$1"), ("(b)", r"\g<1>0")]:
        assert one.select(F.regexp_replace("t", F.lit(regex.search(pattern)), F.lit(regex.java_replacement(new)))).first()[0] == re.sub(pattern, new, "ab1")


@pytest.mark.parametrize("bad", ["(", "a(?i)b", "(a)(?(1)b|c)"])
def test_refused(bad):
    with pytest.raises(regex.UnsupportedPattern):
        regex.search(bad)
