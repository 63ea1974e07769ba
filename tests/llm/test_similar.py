"""The near-duplicate stage against all pairs."""

import random

import pytest

import corpus_pipeline
from tidyloom.llm import simhash, similar

POOL = [f"w{i}" for i in range(400)]


def shingles(text, width=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def expected(rows):
    """The smallest doc_id of each component of pairs at 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = " ".join(rng.choice(POOL) for _ in range(40))
    texts = [None, "", "one two", "One two", "one two three"]
    for _ in range(30):
        base = [rng.choice(POOL) for _ in range(rng.choice([8, 60, 200, 900]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits * max(1, len(base) // 200)):
                copy[rng.randrange(len(copy))] = rng.choice(POOL)
            texts.append(" ".join(copy))
    crowd = [rng.choice(POOL) for _ in range(150)]
    for _ in range(60):
        copy = list(crowd)
        copy[rng.randrange(150)] = rng.choice(POOL)
        texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(POOL) for _ in range(n)) for n in range(1, 60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [3, 50])
def test_components_are_those_of_all_pairs(spark, rows, crowd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(9, rows[9][1], 1)], "doc_id long, text string, node int")
    got = [(r.doc_id, r.component_id) for r in similar.similar_documents(docs, crowd=crowd).collect()]
    want = expected(rows)
    assert sorted(got) == sorted([*want.items(), (9, want[9])])
    assert 20 < len(set(want.values())) < len(want) - 60
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected(rows).values()))


def test_no_task_holds_a_group(spark, rows, monkeypatch):
    """Whatever texts a passage ties together, tasks that get them by key get few."""
    from pyspark.sql import GroupedData

    apply = GroupedData.applyInArrow

    def bounded(self, function, schema):
        def checked(key, group):
            assert group.num_rows <= 50
            return function(key, group)

        return apply(self, checked, schema)

    monkeypatch.setattr(similar, "BLOCK", 8, raising=False)
    monkeypatch.setattr(GroupedData, "applyInArrow", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.similar_documents(docs, crowd=3).collect()
    assert {r.doc_id: r.component_id for r in got} == expected(rows)


def test_stage_gets_links_from_the_fingerprint_index(spark, rows, monkeypatch):
    """SimHash connects what three bits allow; the prefixes add the rest."""
    asked, index = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda distinct, *a: asked.append(distinct.count()) or index(distinct, *a))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected(rows).values()))
    prints = {i: simhash.fingerprint(t, 5) & (1 << 64) - 1 for i, t in rows}
    assert asked == [len(set(prints.values()))]

    described = similar.described(docs.select("doc_id", "text", docs.doc_id.alias("node")), 5, 0.8)
    got = {(r.a, r.b) for r in similar.fingerprint_pairs(described).collect()}
    close = {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3}
    assert got and connected(got) == connected(close)


def connected(pairs):
    root = {}
    for a, b in sorted(pairs):
        one, two = root.setdefault(a, a), root.setdefault(b, b)
        root.update({k: min(one, two) for k, v in root.items() if v in (one, two)})
    return root
