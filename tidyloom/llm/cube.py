"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a target number of words: weights over the sources share the
budget, no target is above ``ceiling`` times the source's size, and the excess
is shared again by weight. target / size is the expected number of copies of
each of the source's documents; its whole part is certain, the rest is an
inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null space of the two balancing constraints
(documents and words of the source stay as expected) until one of them is 0 or
1. Blocks of bounded size fly apart and leave at most two undecided documents
each; those fly again in fewer blocks, level by level, until one block a source
is left and its last two documents land on the rounding nearest to the target.
A large source is so split over many tasks.

Null texts have size 0. A null source is a source, the last in order. Reruns
agree: blocks, order and random choices depend on the rows alone. Rows that are
the same in doc_id, size and source are interchangeable. Columns other than
doc_id, source and text are carried along by ``mix_documents`` and ignored by
``mix``. A source of size 0 has target 0.
"""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidyloom.llm._shared import release, stash, whole_rows

WEIGHTS = (5, 2, 1)
EPSILON = 1e-9
BROADCAST_ROWS = 500_000  # an id, a source, a size and a number: under 64 MB


def word_count(text: Column) -> Column:
    """Number of runs of anything but the ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n + F.when(part != "", 1).otherwise(0))


def targets(sizes: dict, weights: dict, budget: Fraction, ceiling: int = 2) -> dict:
    """Share the budget by weight; sources over the ceiling stop there and the
    rest is shared again. Exact arithmetic, so the result has no order."""
    out, active = {}, set(sizes)
    while active:
        unit = budget / sum(weights[s] for s in active)
        over = {s for s in active if unit * weights[s] > ceiling * sizes[s]}
        if not over:
            return out | {s: unit * weights[s] for s in active}
        for s in over:
            out[s] = Fraction(ceiling * sizes[s])
            budget -= out[s]
        active -= over
    return out


def flight(probabilities: list[float], sizes: list[int], rng: random.Random) -> list[float]:
    """Decide all but at most two units; sums of p and of p * size stay."""
    p = probabilities
    waiting = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 2:
            return p
        a, b = active[0], active[1]
        if len(active) == 3:
            c = active[2]
            u = [sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]]
            if not any(u):
                u = [1, -1, 0]
        elif sizes[a] == sizes[b]:
            u = [1, -1]
        else:
            return p
        up = down = float("inf")
        for i, x in zip(active, u):
            if x > 0:
                up, down = min(up, (1.0 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1.0 - p[i]) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            moved = p[i] + step * x
            p[i] = 0.0 if moved < EPSILON else 1.0 if moved > 1.0 - EPSILON else moved
        active = [i for i in active if 0.0 < p[i] < 1.0]


def land(p: list[float], sizes: list[int]) -> list[float]:
    """Of the two units that are left, give up the number of documents and move
    along the words alone, then round to the nearest sum of words. What rounding
    a long document leaves is made good by single documents of about that size,
    changed over while that brings the sum nearer."""
    wished = sum(a * b for a, b in zip(p, sizes))
    left = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    if len(left) == 2 and all(sizes[i] for i in left):
        a, b = left
        step = min((1.0 - p[a]) / sizes[b], p[b] / sizes[a])
        p[a], p[b] = p[a] + step * sizes[b], p[b] - step * sizes[a]
        for i in left:
            p[i] = 0.0 if p[i] < EPSILON else 1.0 if p[i] > 1.0 - EPSILON else p[i]
        left = [i for i in left if 0.0 < p[i] < 1.0]
    wanted = sum(p[i] * sizes[i] for i in left)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(sum(v * sizes[i] for v, i in zip(x, left)) - wanted), x))
    for i, v in zip(left, best):
        p[i] = v
    for _ in range(8):
        over = sum(a * b for a, b in zip(p, sizes)) - wished
        gains = [(abs(over - size if p[i] == 1.0 else over + size), i) for i, size in enumerate(sizes)]
        if not gains or min(gains)[0] >= abs(over):
            break
        i = min(gains)[1]
        p[i] = 1.0 - p[i]
    return p


def _fly(seed: int, level: int):
    def one(key: tuple, rows: pa.Table) -> pa.Table:
        release()
        rows = rows.sort_by([("size", "descending"), ("order", "ascending"), ("doc_id", "ascending")])  # small documents decide last
        p, sizes = rows["p"].to_pylist(), rows["size"].to_pylist()
        p = flight(p, sizes, random.Random(f"{seed}/{level}/{key[0].as_py()}/{key[1].as_py()}"))
        if rows["blocks"][0].as_py() == 1:
            p = land(p, sizes)
        return pa.table({"doc_id": rows["doc_id"], "size": rows["size"], "source_no": rows["source_no"], "p": pa.array(p, pa.float64()), "order": rows["order"]})

    return one


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def copies(rows: DataFrame, factor: Fraction = Fraction(3, 2), ceiling: int = 2, block: int = 4_000, seed: int = 0, max_sources: int = 1_000_000) -> DataFrame:
    """rows: doc_id, source, size. Adds source_size, target and copies."""
    spark = rows.sparkSession
    rows = stash(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = {k: r["size"] for k, r in enumerate(totals)}
    goal = targets(size, {k: WEIGHTS[k % len(WEIGHTS)] for k in size}, factor * sum(size.values()), ceiling)
    expected = {k: goal[k] / size[k] if size[k] else Fraction(0) for k in size}
    kinds = "source string, source_no int, source_size long, target double, base int, p double"
    plan = spark.createDataFrame([(r["source"], k, size[k], float(goal[k]), int(expected[k]), float(expected[k] % 1)) for k, r in enumerate(totals)], kinds)
    if len(totals) <= 10_000:  # its size is known here
        plan = F.broadcast(plan)
    doc_kind = dict(rows.dtypes)["doc_id"]
    joined = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    placed = joined.select("doc_id", "size", "source_no", "p", F.xxhash64("doc_id", "size", F.lit(seed)).alias("order"))
    schema = f"doc_id {doc_kind}, size long, source_no int, p double, order long"
    decided, undecided, number, level = [placed.where("p <= 0 or p >= 1")], placed.where("p > 0 and p < 1"), {k: r["n"] for k, r in enumerate(totals) if expected[k] % 1}, 0
    while number:
        blocks = {k: max(1, -(-n // block)) for k, n in number.items()}
        counts = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "source_no int, blocks long")) if len(blocks) <= 10_000 else spark.createDataFrame(sorted(blocks.items()), "source_no int, blocks long")
        flown = stash(
            undecided.join(counts, "source_no")
            .withColumn("part", F.pmod(F.xxhash64("order", "doc_id", F.lit(level)), F.col("blocks")))
            .groupBy("source_no", "part")
            .applyInArrow(_fly(seed, level), schema),
            f"flight{level}",
        )
        decided.append(flown.where("p <= 0 or p >= 1"))
        undecided = flown.where("p > 0 and p < 1")
        number = {r["source_no"]: r["count"] for r in undecided.groupBy("source_no").count().collect()} if max(blocks.values()) > 1 else {}
        level += 1
    picks = decided[0]
    for d in decided[1:]:
        picks = picks.unionByName(d)
    names = plan.select("source_no", "source", "source_size", "target", "base")
    picks = picks.join(names, "source_no")
    return picks.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return copies(sized(docs), **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns as they came."""
    picked = stash(copies(sized(docs), **options), "picked")
    key = [F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("words")]
    lists = picked.groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    few = picked.count() <= BROADCAST_ROWS
    rows = whole_rows(docs, "doc_id", "source", word_count(F.col("text")).alias("size")).join(
        F.broadcast(lists) if few else lists, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("size") == F.col("words"))
    )
    single = rows.where(F.size("copies") == 1).select("row", F.element_at("copies", 1).alias("n"))
    place = F.row_number().over(Window.partitionBy("id", "from", "words").orderBy("row.text"))
    repeated = rows.where(F.size("copies") > 1).withColumn("place", place).select("row", F.element_at("copies", F.col("place")).alias("n"))
    taken = single.unionByName(repeated).where("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")
