"""Exact top-k search by the threshold algorithm over sorted lists.

Vectors become integers, floor(scale * x), and score by inner product. Candidates
are dealt into blocks of bounded size; a block keeps, for every dimension, its
candidates in sorted order. A query walks all lists downwards at once (from the
other end where its own component is negative), scores each candidate when it
is first met, and stops as soon as the bound, the product of the query with the
components at the current depth, is below its kth score: then nothing unseen
can reach the result. On equal bounds it goes on, since ties go to the smaller
vec_id. One block is searched first, and the kth score that a query has there is
its floor in all others, where it stops once the bound is below the floor. The
blocks' short results are merged by rank, cut to k before they are shuffled.

Arithmetic is exact: the largest possible score decides whether doubles (below
2^53), 64-bit or unbounded integers are used. Components and scores beyond the
range of a long are given as its nearest end; ranks go by the exact score.

Vectors that are null, or hold a null or non-finite component, take no part;
vectors of different lengths don't meet. Candidates are all rows but the query's
own, so of repeated rows the others are candidates, and each of them is a query
with its own result rows; a vec_id with several vectors is as many rows. A null
vec_id is no query, and no candidate. A vector without components has no score
and takes no part. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm._shared import stash

FIRST_DEPTH = 8


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v, dim and n (how often the row comes) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    taken = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return taken.select("vec_id", quantised(F.col("embedding"), scale).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))


def widest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))


class SortedLists:
    """A block of candidates with one sorted list per dimension. ``times`` says
    how often each candidate comes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id].astype(np.int64)
        self.times = np.ones(len(ids), np.int64) if times is None else times[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.widest, self.kinds = widest(self.vectors), {}

    def kind(self, query: np.ndarray) -> type:
        """The cheapest numbers in which no score of the query is rounded."""
        most = len(query) * widest(query) * self.widest
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, vec_id), of those that reach the floor, and how
        deep the lists were read."""
        kind = self.kind(query)
        if kind not in self.kinds:
            self.kinds[kind] = self.vectors.astype(kind), self.values.astype(kind)
        vectors, values = self.kinds[kind]
        n, dims = len(vectors), np.flatnonzero(query)
        exact = query.astype(kind)
        weight, falling = exact[dims], query[dims] > 0
        times = np.where((self.ids == own) & (self.vectors == query).all(1), self.times - 1, self.times)  # the query's own row is none
        met = times == 0
        best_scores, best_ids = np.zeros(0, kind), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            if len(dims):
                to = min(n, depth + step)
                fresh = np.zeros(n, bool)
                fresh[self.order[dims[~falling], depth:to].ravel()] = True
                fresh[self.order[dims[falling], n - to : n - depth].ravel()] = True
                fresh &= ~met
            else:
                to, fresh = n, ~met  # a zero query: every score is zero
            new = np.flatnonzero(fresh)
            met |= fresh
            scores = vectors[new] @ exact if len(new) < n // 2 else (vectors @ exact)[new]
            each = np.minimum(times[new], k)
            best_scores, best_ids = np.concatenate([best_scores, np.repeat(scores, each)]), np.concatenate([best_ids, np.repeat(self.ids[new], each)])
            top = np.lexsort((best_ids, -best_scores))[:k] if kind is not object else np.array(sorted(range(len(best_ids)), key=lambda i: (-best_scores[i], best_ids[i]))[:k], np.int64)
            best_scores, best_ids = best_scores[top], best_ids[top]
            depth, step = to, 2 * step
            if met.all():
                break
            least = max((x for x in (floor, int(best_scores[-1]) if len(best_scores) == k else None) if x is not None), default=None)
            if least is not None and depth < n and int(np.where(falling, values[dims, n - depth], values[dims, depth - 1]) @ weight) < least:
                break
        found = [(int(s), int(i)) for s, i in zip(best_scores, best_ids)]
        return [x for x in found if floor is None or x[0] >= floor], depth


BASE = 10**18
FOUND = "query long, query_id long, vec_id long, score string, high string, low long, depth long"  # digits, as exact scores may have too many for any number type


def _block_search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), np.array(candidates["v"].tolist(), np.int64).reshape(len(candidates), -1), candidates["n"].to_numpy(np.int64))
            for number, own, q, floor in zip(queries["query"], queries["vec_id"], queries["v"], queries["floor"]):
                found, depth = lists.search(own, np.asarray(q, np.int64), k, int(floor) if isinstance(floor, str) else None)
                out += [(number, own, vec_id, str(score), str(score // BASE), score % BASE, depth) for score, vec_id in found]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "high", "low", "depth"]).astype({c: "int64" for c in ("query", "query_id", "vec_id", "low", "depth")})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 8_192, query_block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of vectors;
    both frames have vec_id and embedding."""
    rows = stash(usable(vectors, scale), "vectors")
    asked = stash(usable(queries, scale).withColumn("query", F.monotonically_increasing_id()), "queries")
    n, m = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    spread = lambda parts, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(parts)).cast("int")
    numbers = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    dealt = rows.withColumn("c", spread(blocks, 1))
    asked = asked.withColumn("q", spread(query_blocks, 2))
    high = F.col("high").cast("decimal(38,0)")  # of 2^126 times any length it has 20 digits and the length's
    by = Window.partitionBy("query").orderBy(high.desc(), F.col("low").desc(), "vec_id")

    def search(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        left = candidates.withColumn("q", numbers(0, query_blocks))
        return left.groupBy("dim", "c", "q").cogroup(asking.groupBy("dim", "c", "q")).applyInPandas(_block_search(k), FOUND)

    found = search(dealt.where("c = 0"), asked.withColumns({"floor": F.lit(None).cast("string"), "c": F.lit(0)}))
    if blocks > 1:
        found = stash(found, "firstblock")
        floors = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select(F.col("query").alias("number"), F.col("score").alias("floor"))
        rest = asked.join(floors, F.col("query") == F.col("number"), "left_outer").drop("number").withColumn("c", numbers(1, blocks))
        found = found.unionByName(search(dealt.where("c > 0"), rest))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    within = F.coalesce(F.expr("try_cast(score as long)"), F.when(high > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))
    copies = asked.where("n > 1").select(F.col("query").alias("number"), "n")
    again = ranked.join(copies, F.col("query") == F.col("number"), "left_outer").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("n"), F.lit(1)).cast("int"))))
    return again.select("query_id", "rank", "vec_id", within.alias("score"))
