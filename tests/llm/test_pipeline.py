import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidyloom.llm import queries, tokencount

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_rows(spark, tmp_path):
    rng = __import__("random").Random(1)
    pool = "the of and to in is that it was for on with as his they be at one have this from or had by word but what some".split()
    clean = [(i, " ".join(rng.choice(pool) for _ in range(80)), "en", "s", 1) for i in range(40)]
    base = clean[0][1]
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(6)) for _ in range(80))
    rows = clean + [(100, None, "en", "s", 0), (101, "123 !!", "en", "s", 0), (102, base.upper(), "en", "s", 0), (103, gibberish, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "documents.parquet")
    docs.write.parquet(folder)
    docs = spark.read.parquet(folder)
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language_id"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in identified.collect()} == {*range(40), 102} and identified.columns == docs.columns
    exact = stages["exact_dedup"](spark, identified, str(tmp_path))
    assert {r.doc_id for r in exact.collect()} == {*range(1, 40), 102}
    near = stages["near_dedup"](spark, exact, str(tmp_path))
    assert {r.doc_id for r in near.collect()} == {*range(1, 40), 102} and near.columns == docs.columns
    mixed = stages["source_mixing"](spark, near, str(tmp_path))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed_documents(packed) == Counter(r.doc_id for r in mixed.collect())
    assert_brute_force_packing(packed, {i: t for i, t, *_ in rows})


def packed_documents(packed):
    return Counter(r.doc_id for r in packed if r.piece == 0)


def assert_brute_force_packing(packed, texts, capacity=4096):
    """Every document whole as the tokenizer has it, every sequence gapless."""
    import zlib

    from tokenizers import Tokenizer

    tokenizer, sequences = Tokenizer.from_file(tokencount.vocabulary(queries.WORDS)), {}
    for r in packed:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.start == r.piece * capacity
        assert r.length == min(capacity, len(ids) - r.start)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({queries.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()))) == sorted(map(str, want))
