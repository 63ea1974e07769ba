"""Which values to look at: embeddings, representatives, diverse and odd ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.operators.profile import artifact_score

MOST, CLUSTERS, WIDTH = 12, 6, 256


def ngram_vector(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashed character n-grams, L2-normalised; an empty text reads as a space."""
    import zlib

    padded = f"\x02{text or ' '}\x03"
    out = np.zeros(width, np.float32)
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            out[zlib.crc32(padded[i : i + n].encode("utf-8", "surrogatepass")) % width] += 1.0
    return out / max(float(np.linalg.norm(out)), 1e-12)


class SentenceEncoder:
    """A sentence model from a folder with model.onnx and tokenizer.json: first
    128 tokens, mean of the token vectors under the mask, L2-normalised."""

    def __init__(self, folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(128)
        self.tokenizer.enable_padding()
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        self.inputs = {i.name for i in self.session.get_inputs()}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        rows = []
        for i in range(0, len(texts), 64):
            encoded = self.tokenizer.encode_batch([t or " " for t in texts[i : i + 64]])
            feed = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
            states = next((o for o in self.session.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in self.inputs}) if o.ndim == 3), None)
            if states is None:
                raise ValueError("the model has no output per token")
            weight = np.array(feed["attention_mask"], np.float32)[:, :, None]
            mean = (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
            rows.append(mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12))
        return np.concatenate(rows) if rows else np.zeros((0, 0), np.float32)


_encoders: dict[str, SentenceEncoder] = {}


def embedded(values: DataFrame, model_folder: str | None = None) -> DataFrame:
    """values (value, ...) with ``vector``; the model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            if model_folder is None:
                yield pd.Series([ngram_vector(t) for t in texts])
            else:
                if model_folder not in _encoders:
                    _encoders[model_folder] = SentenceEncoder(model_folder)
                yield pd.Series(list(_encoders[model_folder](texts)))

    return values.withColumn("vector", encode("value"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x))


def representatives(vectors: DataFrame, clusters: int = CLUSTERS, most: int = MOST, seed: int = 0) -> list[str]:
    """vectors: value, vector. All values if there are few; else of each cluster
    the farthest from and the nearest to its centre (ties: smallest value)."""
    first = [r["value"] for r in vectors.select("value").orderBy("value").limit(most + 1).collect()]
    if len(first) <= most:
        return first
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    prepared = vectors.select("value", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(clusters, n)), seed=seed, maxIter=100, tol=1e-6).fit(prepared)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(prepared).withColumn("away", distance(F.col("vector").cast("array<double>"), F.element_at(centres, F.col("prediction") + 1)))
    picks = placed.groupBy("prediction").agg(F.min(F.struct((-F.col("away")).alias("d"), "value")).alias("far"), F.min(F.struct("away", "value")).alias("near"))
    out: list[str] = []
    for r in picks.orderBy("prediction").collect():  # one row a cluster
        out += [r["far"]["value"], r["near"]["value"]]
    return list(dict.fromkeys(out))[:most]


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _away(candidates: DataFrame, anchors: Sequence[Sequence[float]]) -> Column:
    """Distance to the nearest anchor, or without anchors to the centroid."""
    if anchors:
        each = [distance(F.col("vector").cast("array<double>"), _literal(a)) for a in anchors]
        return F.least(*each) if len(each) > 1 else each[0]
    width = candidates.select(F.max(F.size("vector"))).first()[0] or 0
    centre = candidates.agg(*[F.avg(F.element_at("vector", i + 1)).alias(f"c{i}") for i in range(width)]).first()
    return distance(F.col("vector").cast("array<double>"), _literal(centre))


def diverse(candidates: DataFrame, anchors: Sequence[Sequence[float]], n: int) -> list[str]:
    """The n values farthest from the anchors and each other, greedily; all if
    there are no more. Each pick is one aggregate over distributed vectors."""
    candidates, chosen, anchors = candidates.dropDuplicates(["value"]).persist(), [], list(anchors)
    few = [r["value"] for r in candidates.select("value").orderBy("value").limit(n + 1).collect()]
    for _ in range(n if len(few) > n else 0):
        left = candidates.where(~F.col("value").isin(chosen)) if chosen else candidates
        best = left.withColumn("away", _away(candidates, anchors)).agg(F.min(F.struct((-F.col("away")).alias("d"), "value", "vector")).alias("b")).first()["b"]
        chosen.append(best["value"])
        anchors.append(best["vector"])
    candidates.unpersist()
    return chosen or few


def suspicious(candidates: DataFrame, anchors: Sequence[Sequence[float]], n: int, frequencies: dict[str, int], bonus: bool = True) -> list[str]:
    """The n values with the largest sum of diversity and artifact score, both
    relative to the largest among the values left; picked one by one."""
    scored, chosen, anchors = candidates.dropDuplicates(["value"]).withColumn("odd", artifact_score(F.col("value"), frequencies, bonus)).persist(), [], list(anchors)
    candidates = scored  # vectors are computed once, for all picks
    few = [r["value"] for r in candidates.select("value").orderBy("value").limit(n + 1).collect()]
    for _ in range(n if len(few) > n else 0):
        left = (scored.where(~F.col("value").isin(chosen)) if chosen else scored).withColumn("away", _away(candidates, anchors))
        top = left.agg(F.max("away").alias("away"), F.max("odd").alias("odd")).first()
        score = sum((F.col(c) / F.lit(top[c]) if top[c] else F.col(c)) for c in ("away", "odd"))
        best = left.withColumn("score", score).agg(F.min(F.struct((-F.col("score")).alias("s"), "value", "vector")).alias("b")).first()["b"]
        chosen.append(best["value"])
        anchors.append(best["vector"])
    scored.unpersist()
    return chosen or few


def oracle_sample(vectors: DataFrame, marked: Column, used: Sequence[str], n: int, frequencies: dict[str, int], bonus: bool = True) -> list[str]:
    """n new values: half diverse ones that the rule marks, half suspicious ones
    that it doesn't, and diverse ones from the rest if either runs short."""
    fresh = vectors.where(~F.col("value").isin(list(used))) if used else vectors
    anchors = [r["vector"] for r in vectors.where(F.col("value").isin(list(used))).select("vector").collect()] if used else []  # labelled values only
    picked = diverse(fresh.where(marked), anchors, n // 2) if n // 2 else []
    picked += suspicious(fresh.where(~marked), anchors, n - n // 2, frequencies, bonus)
    if len(picked) < n:
        rest = fresh.where(~F.col("value").isin(picked)) if picked else fresh
        picked += diverse(rest, anchors, n - len(picked))
    return picked
