"""Operators on documents against brute force, with nulls, empties, ties,
repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.llm import cube, exactdedup, langid, license, packing, queries, repeats, simhash, tokencount

ODD = ", __id long, __sha string, text_sha256 string, size string, digest string, n long, fp string, content string, kept string, copies string, __n string"
EXTRA = (7,) + ("z", "z", "z", "z") + (7,) + ("z",) * 5


def documents(spark, rows):
    """doc_id, text, source with columns that clash with inner names."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id long, text string, source string" + ODD)


def words(rng, n, pool=None):
    pool = pool or ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "no id", "a"), (1, None, None), (2, "", "a"), (3, "", None), (4, "12 34 -- !!", "b"), (5, "Same Text", "b"), (6, "same text", "b"), (7, "SAME TEXT", "a"), (7, "SAME TEXT", "a")]
    out += [(10 + i, words(rng, rng.randrange(1, 60)), rng.choice(["a", "b", None])) for i in range(60)]
    out += [(100, words(rng, 30_000), "long"), (101, "É" * 500, "a"), (102, "É" * 500 + "x", "a"), (103, "é" * 500, "a")]
    return out


def test_large_ids_beside_nulls(spark):
    """Ids over 2**53 stay exact where others are null."""
    big = 2**62 + 1
    docs = documents(spark, [(big, "the one text", "a"), (None, "an other text", "a"), (big + 1, None, "a")])
    pieces, words = tokencount.vocabulary(queries.PIECES), tokencount.vocabulary(queries.WORDS)
    runs = [
        exactdedup.duplicate_groups(docs), license.license_scan(docs), simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs), cube.mix(docs), repeats.cut_repeats(docs),
        tokencount.token_counts(docs, pieces), packing.pack_documents(docs, words), langid.identify(docs.withColumn("lang", F.lit("en")), pieces), exactdedup.drop_duplicates(docs),
    ]
    for r in runs:
        assert {x.doc_id for x in r.select("doc_id").collect()} == {big, None, big + 1}


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[ascii_lower(text)].append(doc_id)
    return groups


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, rows, bits):
    digest = exactdedup.sha256 if bits == 256 else (lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1)))
    got = exactdedup.duplicate_groups(documents(spark, rows), digest, files_per_batch=1).collect()
    groups = expected_groups(rows)
    assert len(got) == len(rows)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max(ids, key=lambda i: (i is not None, i)), len(ids)) for t, ids in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == keep[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_drops_rows(spark, rows):
    docs = documents(spark, rows)
    kept = exactdedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids) == Counter(max(g, key=lambda i: (i is not None, i)) for g in expected_groups(rows).values())


@pytest.mark.parametrize("operator", [exactdedup.duplicate_groups, exactdedup.drop_duplicates, simhash.near_duplicates, simhash.drop_near_duplicates, license.license_scan, cube.mix, cube.mix_documents, repeats.cut_repeats])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_license_scan(spark, rows):
    texts = ["All rights reserved.", "x\nReleased under the MIT license, and more words here\ny", "cc by cc BY", "cc\nby", None, "general public license all rights reserved", "license mit the under released", "acc by", "Licensed under the Apache License, Version 2.0."]
    got = {r.doc_id: r for r in license.license_scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert (got[0].base_labels, got[0].labels, got[0].n_base, got[0].first_word, got[0].last_word, got[0].score) == ("reserved", "reserved", 1, 0, 0, 1.0)
    assert (got[1].base_labels, got[1].labels, got[1].n_words, got[1].score) == ("", "mit", 11, 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 2, "cc-by")
    assert got[3].base_labels == "cc-by"
    assert (got[4].n_words, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[5].base_labels == "gpl,reserved"
    assert got[6].labels == "mit" and got[7].n_base == 0 and got[8].labels == "apache-2.0"
    assert license.license_scan(documents(spark, rows)).count() == len(rows)


def test_wrapped_license_notices(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal'
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one"
    filler = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) for i in range(30))
    texts = [mit, bsd, mpl, f"{filler}\n{mit}\n{filler}", f"{filler} {mpl.replace(' ', chr(10))} {filler}", mit[:76] + "\n\n" + mit[77:], filler]
    got = {r.doc_id: (r.labels, r.score) for r in license.license_scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mpl-2.0", 1.0), 3: ("mit", 1.0), 4: ("mpl-2.0", 1.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_whole_licenses(spark):
    """Paragraphs of the licenses as they are wrapped in source files, and words of them scattered in one long line."""
    import textwrap

    wrapped = {(label, k): "\n".join(f" * {x}" for x in textwrap.wrap(text, 40)) for k, (label, text) in enumerate(license.TEMPLATES)}
    filler = " ".join(f"word{k}" for k in range(300))
    texts = [f"{filler}\n\n{text}\n\n{filler}" for text in wrapped.values()]
    scattered = [filler.replace("word90 ", "all ").replace("word170 ", "rights ").replace("word250 ", "reserved ")]
    got = {r.doc_id: r.labels.split(",") for r in license.license_scan(documents(spark, [(i, t, None) for i, t in enumerate(texts + scattered)])).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(wrapped))
    assert got[len(texts)] == [""]


def test_similarity_join_is_exact(spark):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.sample(pool, rng.randrange(2, 9)))) for i in range(12)]
    blocks = [(i, rng.sample(pool, rng.randrange(1, 12))) for i in range(150)]
    df = spark.createDataFrame(blocks, "k int, tokens array<string>")
    for threshold in (0.5, 0.75, 1.0):
        got = {(r.k, r.label) for r in license.similar_blocks(df, templates, threshold).collect()}
        want = {(k, label) for k, ts in blocks for label, t in templates if len(set(ts) & set(t.split())) >= license.needed(len(t.split()), threshold)}
        assert got == want


def test_simhash(spark, rows):
    rng = random.Random(2)
    base = words(rng, 300)
    near = [(200 + i, base + " " + words(rng, 1), "a") for i in range(12)] + [(300, base.upper(), "a")]
    docs = documents(spark, rows + near)
    got = simhash.near_duplicates(docs).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    groups = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            if (a ^ b).bit_count() <= 3 and groups[i] != groups[j]:
                old, new = groups[j], groups[i]
                groups = [new if g == old else g for g in groups]
    want = {}
    for g, r in zip(groups, got):
        if r.doc_id is not None:
            want[g] = min(want.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [want.get(g) for g in groups]
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + near)
    crowded = simhash.near_duplicates(docs, crowd=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, crowded))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))


def test_fingerprints_by_brute_force(spark, rows):
    import xxhash

    def brute(text):
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", ascii_lower(text)) if w]
        shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    odd = [(800, "a\u00a0b\x0bc\x1cd e f É", "a"), (801, "x " * 9000, "a"), (802, "One TWO", "a")]
    texts = {(i, t) for i, t, _ in rows + odd}
    got = Counter((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(documents(spark, rows + odd)).collect())
    assert set(got) == {(i, f"{brute(t):016x}") for i, t in texts}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(16)
    texts = [" \n".join(rng.choice(["a", "Bé", "ccc", "d\u00a0e"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 19_999, 20_000, 20_001, 20_002, 60_003)] + [" " * 50, "x" * 900]
    for width in (3, 5):
        whole = [simhash._hashes(t.encode().lower().split(), width).tolist() for t in texts]
        monkeypatch.setattr(simhash, "LONG_BYTES", 0)
        assert [simhash.hashes(t, width).tolist() for t in texts] == whole
        monkeypatch.undo()


def test_fingerprint_is_sparks_hash(spark):
    text = "One two  three\tFOUR five"
    hs = [r[0] & (2**64 - 1) for r in spark.createDataFrame([("one two three",), ("two three four",), ("three four five",)], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 3)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (500, 500)] + [(200, 200 + i) for i in range(1, 30)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got[i] for i in (101, 102)} == {100} and {got[200 + i] for i in range(1, 30)} == {200}


def test_cube_targets_and_balance(spark, rows):
    rng = random.Random(4)
    more = [(1000 + i, words(rng, rng.randrange(1, 80)), "big") for i in range(900)]
    docs = documents(spark, rows + more)
    got = cube.mix(docs, block=100).collect()
    again = cube.mix(docs.repartition(7), block=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows) + len(more) and all(r.taken <= 2 * r.size for r in got)
    by_size = defaultdict(list)
    for r in got:
        by_size[r.source_size].append(r)
    total = sum(len((t or "").split()) for _, t, _ in rows + more)
    assert abs(sum(rs[0].target for rs in by_size.values()) - 1.5 * total) < 1e-6
    big = by_size[max(by_size)] if len(by_size) > 1 else []
    for rs in by_size.values():
        assert rs[0].target <= 2 * rs[0].source_size + 1e-9
        if len(rs) > 500:
            assert abs(sum(r.taken for r in rs) - rs[0].target) <= 40
    assert big
    mixed = cube.mix_documents(docs, block=100)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in got)
    assert mixed.select(F.sum(cube.word_count(F.col("text")))).first()[0] == taken


def test_targets_by_brute_force(spark):
    """Sharing by weight in small steps: a source that is full takes no more."""
    rng = random.Random(14)
    for _ in range(5):
        names = sorted({rng.choice("abcdefgh") for _ in range(8)})
        rows = [(i, words(rng, rng.choice([1, 5, 40, 300]) if s == names[0] else rng.randrange(1, 30)), s) for i, s in enumerate(rng.choice(names) for _ in range(120))]
        sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {s for _, _, s in rows}}
        order = sorted(sizes)
        want, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
        while left > 1e-9:
            free = [s for s in order if want[s] < 2 * sizes[s] - 1e-9]
            unit = left / sum((5, 2, 1)[order.index(s) % 3] for s in free)
            unit = min([unit, *((2 * sizes[s] - want[s]) / (5, 2, 1)[order.index(s) % 3] for s in free)])
            for s in free:
                want[s] += unit * (5, 2, 1)[order.index(s) % 3]
                left -= unit * (5, 2, 1)[order.index(s) % 3]
        source = {i: s for i, _, s in rows}
        taken = Counter()
        got = cube.mix(documents(spark, rows)).collect()
        for r in got:
            assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]] and r.taken in (0, r.size, 2 * r.size)
            taken[source[r.doc_id]] += r.taken
        longest = {s: max(len(t.split()) for _, t, x in rows if x == s) for s in order}
        assert len(got) == 120 and all(abs(taken[s] - want[s]) <= longest[s] for s in order)


def test_flight_keeps_the_totals():
    rng = random.Random(6)
    p, sizes = [rng.random() for _ in range(300)], [rng.randrange(0, 50) for _ in range(300)]
    before = sum(p), sum(a * b for a, b in zip(p, sizes))
    p = cube.flight(p, sizes, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - before[0]) < 1e-6 and abs(sum(a * b for a, b in zip(p, sizes)) - before[1]) < 1e-4


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batch_bytes", [1_000_000, 300])
def test_repeats(spark, rows, batch_bytes):
    rng = random.Random(7)
    passage = words(rng, 40)
    texts = [t for _, t, _ in rows if t is None or len(t) < 2000]
    texts += [words(rng, 20) + passage[:150] + words(rng, 10) for _ in range(12)] + ["ab" * 200, "x" * 41, passage + "é" + passage, "WORD!! " * 30]
    got = repeats.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hash", F.lit("clash")), 40, batch_bytes).collect()
    want = brute_repeats(texts, 40)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], texts[r.doc_id]
    assert len(got) == len(texts) and sum(r.n_removed for r in got) > 0


def test_repeats_of_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "q" * 30 + "r" * 30)] * 2 + [(None, "z" * 9)], "doc_id long, text string")
    assert sorted((r.n_removed, r.n_spans) for r in repeats.cut_repeats(twice, 50).collect()) == [(0, 0), (60, 1), (60, 1)]


def test_400_bytes_decide(spark, tmp_path):
    """The query counts bytes, not words: 80 shared words of 399 bytes stay, 400 bytes go."""
    stays, goes = " ".join(f"s{i:03d}" for i in range(80)), " ".join(f"g{i:03d}" for i in range(80)) + "!"
    texts = {1: f"a{stays}b", 2: f"c{stays}d", 3: f"a{goes}b", 4: f"c{goes}d"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.text) for r in queries.op6_repeat_removal(spark, str(tmp_path)).collect()}
    assert got == {1: (401, 0, 0, texts[1]), 2: (401, 0, 0, texts[2]), 3: (402, 400, 1, "ab"), 4: (402, 400, 1, "cd")}


def test_run_length_index():
    rng = random.Random(8)
    for _ in range(100):
        length, base = rng.choice([3, 6, 17]), bytes(rng.choice(b"ab") for _ in range(50))
        texts = [b"".join(rng.choice([base[rng.randrange(40) :][: rng.randrange(50)], bytes(rng.choice(b"abc") for _ in range(8))]) for _ in range(4)) for _ in range(rng.randrange(1, 7))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, flags in zip(texts, repeats.repeated_windows(texts, length)):
            assert flags.tolist() == [seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]
    index = repeats.RunLengthIndex([b"abcabc" * 30] * 5)
    assert index.lengths.sum() == 5 * 181 and len(index.symbols) < 60  # repetitive texts have few runs
    once = repeats.RunLengthIndex([b"abcabc" * 30, b"xyz"], [5, 1])  # copies lengthen the runs and match to their ends
    assert once.lengths.sum() == 5 * 181 + 4 and len(once.symbols) < 60
    assert once.matching_statistics()[:180].tolist() == list(range(180, 0, -1)) and not once.matching_statistics()[181:].any()


def test_digests_alone_remove_nothing(spark, monkeypatch):
    rows = [(1, "a" * 20 + "b" * 40), (2, "c" * 20 + "d" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = repeats.document_runs
    monkeypatch.setattr(repeats, "document_runs", lambda d, n: plain(d, n).withColumn("hash", F.lit(1).cast("long")).withColumn("same", F.lit(2).cast("long")).withColumn("looped", F.lit(False)).where("start = 0"))
    assert [r.n_removed for r in repeats.cut_repeats(docs, 50).collect()] == [0, 0]


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.vocabulary(queries.PIECES))


def test_token_counts(spark, rows, sentencepiece_model):
    path = tokencount.vocabulary(queries.PIECES)
    extra = [(900, "  two  spaces\n\n and\ttabs ", None), (901, "<s> </s> <unk> <0x0A>", None), (902, "日本語 ▁x", None), (903, "a" * 5000, None)]
    got = tokencount.token_counts(documents(spark, rows + extra), path).collect()
    texts = {r[0]: r[1] or "" for r in rows + extra}
    assert len(got) == len(rows) + len(extra)
    for r in got:
        want = len(sentencepiece_model.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(texts[r.doc_id].encode()), want > 4096)


@pytest.mark.parametrize("chunk", [1, 7, 400])
def test_long_texts_are_counted_by_a_scan(spark, rows, sentencepiece_model, chunk):
    rng = random.Random(12)
    texts = [(i, t) for i, t, _ in rows if t is None or len(t) < 3000]
    texts += [(500 + k, "".join(rng.choice("aabcdeehst   \n\té日01.!▁x") for _ in range(rng.randrange(30, 300)))) for k in range(40)]
    texts += [(600, "a" * 2500), (600, "a" * 2500), (601, " " * 300), (602, "née " * 300)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id long, text string, row int, chunk string, n_bytes string")
    got = tokencount.token_counts(docs, tokencount.vocabulary(queries.PIECES), long_chars=25, chunk_chars=chunk).collect()
    want = Counter((i, len((t or "").encode()), len(sentencepiece_model.encode(t or ""))) for i, t in texts)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


@pytest.mark.parametrize("operator", [tokencount.token_counts, packing.pack_documents, packing.sequences])
def test_empty_table_of_tokens(spark, operator):
    path = tokencount.vocabulary(queries.PIECES if operator is tokencount.token_counts else queries.WORDS)
    assert operator(documents(spark, []), path).count() == 0


def test_chunks_compose(sentencepiece_model):
    t = tokencount.PieceTransducer(tokencount.vocabulary(queries.PIECES), state_limit=50, word_limit=20)
    rng = random.Random(9)
    for _ in range(1500):
        text = "".join(rng.choice("aabcdeehst   \n\té日01.!▁x") for _ in range(rng.randrange(40)))
        want = len(sentencepiece_model.encode(text))
        assert {t.count(text, n) for n in (1, 2, 5, 1000)} == {want}, text


def brute_forward(word, probability):
    alpha = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        alpha[end] = sum(alpha[start] * probability(word[start:end]) for start in range(end))
    return alpha[-1]


def test_forward_sums_all_segmentations():
    table = langid.piece_table(tokencount.vocabulary(queries.PIECES))
    rng = np.random.default_rng(0)
    p = rng.random((table.size, 2)) / table.size
    padded = np.vstack([p, np.zeros((1, 2))])
    for word in ("the", "straße", "日x", "antidisestablishmentarianism"):
        total = langid.forward(table.lattice([word]), padded)[0, -1]
        for k in range(2):
            known = lambda s, k=k: p[table.ids[s], k] if s in table.ids else (p[table.unknown, k] if len(s) == 1 else 0.0)
            assert np.isclose(total[k], brute_forward("▁" + word, known))


def test_forward_of_words_of_any_length():
    from decimal import Decimal

    table = langid.piece_table(tokencount.vocabulary(queries.PIECES))
    rng = np.random.default_rng(1)
    p = rng.random((table.size, 2)) / table.size
    for word in ("the", "Ж" * 64, "ontheroad" * 56):  # 504 letters, far below the smallest double
        edges = list(table.edges("▁" + word))
        got = langid.log_sums(edges, len(word) + 1, np.log(p))
        assert np.allclose(got[-1], langid.log_sums(edges, len(word) + 1, np.log(p), reverse=True)[0])
        for k in range(2):
            alpha = [Decimal(1)] + [Decimal(0)] * (len(word) + 1)
            for end in range(1, len(word) + 2):
                for start in range(max(0, end - table.longest), end):
                    piece = ("▁" + word)[start:end]
                    if piece in table.ids or end - start == 1:
                        alpha[end] += alpha[start] * Decimal(float(p[table.ids.get(piece, table.unknown), k]))
            assert abs(float(alpha[-1].ln()) - got[-1, k]) < 1e-6 * abs(got[-1, k])


def test_lattice_holds_every_piece():
    table, rng = langid.piece_table(tokencount.vocabulary(queries.PIECES)), random.Random(13)
    for n in (1, 2, 7, 20):
        group = ["".join(rng.choice("aeinstéßЖ日x") for _ in range(n)) for _ in range(50)]
        lattice = table.lattice(group)
        for k, word in enumerate(group):
            got = {(int(i), int(i + j + 1), int(lattice[k, i, j])) for i, j in zip(*np.nonzero(lattice[k] >= 0))}
            assert got == set(table.edges("▁" + word))


def test_long_words_and_ties(spark):
    docs = spark.createDataFrame([(1, "q" * 3000 + " the cat", "aa"), (2, "ü" * 3000 + " der hund", "bb"), (3, "Ж" * 100_000, None), (4, "q" * 90_000, None)], "doc_id long, text string, lang string")
    model = langid.train(docs, tokencount.vocabulary(queries.PIECES))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[1][0] == got[4][0] == "aa" and got[2][0] == "bb"
    same = spark.createDataFrame([(1, "one text", "bb"), (2, "one text", "aa")], "doc_id long, text string, lang string")
    ties = langid.predict(same, langid.train(same, tokencount.vocabulary(queries.PIECES))).collect()
    assert all(r.lang_pred == "aa" and abs(r.score - 0.5) < 1e-9 for r in ties)
    assert langid.identify(same.limit(0), tokencount.vocabulary(queries.PIECES)).count() == 0
    assert langid.keep_identified(same.limit(0), tokencount.vocabulary(queries.PIECES)).count() == 0


def test_language_stage_rejects_what_no_language_fits(spark):
    rng = random.Random(10)
    pools = {"en": "the of and to in is that it was for on with as his they be at one have this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    data = [(i, words(rng, 30, pools[lang]), lang) for i, lang in enumerate(["en", "de"] * 100)]
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(6)) for _ in range(30))
    bad = [(900, gibberish, None), (901, "правительство объявило сегодня о новых правилах", None), (902, words(rng, 30, pools["de"]), "en"), (903, words(rng, 30, pools["en"]), "de")]
    good = [(910, words(rng, 30, pools["en"]), None), (911, "the", "en"), (912, "the", None)]
    docs = spark.createDataFrame(data + bad + good, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.keep_identified(docs, tokencount.vocabulary(queries.PIECES)).collect()}
    assert kept == {i for i, _, _ in data + good}


def test_language_id(spark):
    rng = random.Random(10)
    pools = {"en": "the of and to in is that it was for on with as his they be at one have this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    data = [(i, words(rng, 30, pools[lang]), lang) for i, lang in enumerate(["en", "de"] * 150)]
    data += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", None), (1003, "the of and", None), (1003, "der die und", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("x"))
    got = langid.identify(docs, tokencount.vocabulary(queries.PIECES)).collect()
    assert len(got) == len(data)
    want = {i: lang for i, _, lang in data[:300]}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id < 300)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.lang_pred for r in got if r.doc_id == 1003) == ["de", "en"]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = langid.keep_identified(docs, tokencount.vocabulary(queries.PIECES))
    assert kept.columns == docs.columns and kept.count() == 302
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), tokencount.vocabulary(queries.PIECES))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_packing(spark, rows):
    import zlib

    from tokenizers import Tokenizer

    path = tokencount.vocabulary(queries.WORDS)
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(documents(spark, rows), path, 128, per_partition=40).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text, _ in rows:
        if doc_id == 7:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, a, min(128, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 128))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    assert len(pieces[7]) == 2
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= packing.lower_bound(np.array([r.length for r in got]), 128) + 1


def test_sequences_hold_the_ids(spark, rows):
    from tokenizers import Tokenizer

    path = tokencount.vocabulary(queries.WORDS)
    tokenizer = Tokenizer.from_file(path)
    got = packing.sequences(documents(spark, rows), path, 256).collect()
    want = Counter(i for _, text, _ in rows for i in [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert Counter(i for r in got for i in r.ids) == want and max(len(r.ids) for r in got) <= 256


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    assert packing.lower_bound(np.array([60, 60, 60, 40]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(0, 80))
        bins, offsets, count = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= count
        assert count == 0 or np.bincount(bins, lengths).max() <= 100


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = tokencount.vocabulary(queries.WORDS)
    tokenizer, ids, rng = Tokenizer.from_file(path), packing.WordIds(path, 50), random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice([*"aABcdÉ́eh  \n\té日0123,.!$<'s\xa0　Σ İ", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", ".,!"]) for _ in range(rng.randrange(25)))
        assert np.frombuffer(ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_predictions_by_brute_force(spark):
    """Every row's language and score from the model's own probabilities, summed
    over all segmentations word by word."""
    import math

    rng = random.Random(15)
    pools = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit straße".split(), "fr": "le la les des une été où que qui dans".split()}
    data = [(i, words(rng, rng.randrange(1, 12), sum((pools[x] for x in rng.sample(list(pools), rng.choice([1, 1, 2]))), [])), rng.choice([*pools, None])) for i in range(120)]
    data += [(500, None, "en"), (501, "1 2 3", "de"), (502, "ONE Two-three x²", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2), tokencount.vocabulary(queries.PIECES))
    table = langid.piece_table(model.vocabulary)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i, text, _ in data:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            assert got[i] == ("und", 0.0)
            continue
        logs = []
        for k in range(len(model.languages)):
            known = lambda s, k=k: model.probability[table.ids[s], k] if s in table.ids else (model.probability[table.unknown, k] if len(s) == 1 else 0.0)
            logs.append(model.prior[k] + sum(math.log(brute_forward("▁" + w, known)) for w in found))
        best = max(range(len(logs)), key=lambda k: (logs[k], -k))
        assert got[i][0] == model.languages[best] and abs(got[i][1] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-9


def test_rare_languages_are_learned(spark):
    rng = random.Random(8)
    pools = {"aa": "the of and to in is that it was for".split(), "bb": "der die und von zu das mit sich auf ist".split()}
    rows = [(i, words(rng, 12, pools["aa"]), "aa") for i in range(1000)] + [(2000 + i, words(rng, 12, pools["bb"]), "bb") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, tokencount.vocabulary(queries.PIECES), max_docs=100)
    assert model.languages == ["aa", "bb"] and np.allclose(np.exp(model.prior), [1000 / 1002, 2 / 1002])
    assert {r.lang_pred for r in langid.predict(docs.where("lang = 'bb'"), model).collect()} == {"bb"}
    assert langid.level([1000, 2], 100) == 98 and langid.level([10, 20], 100) == 50 and langid.level([4000] * 4, 8000) == 2000


def test_documents_stay_without_a_model(spark):
    docs = spark.createDataFrame([(1, "some clean text", None), (2, "12 !!", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, tokencount.vocabulary(queries.PIECES))
    assert [r.doc_id for r in kept.collect()] == [1]
