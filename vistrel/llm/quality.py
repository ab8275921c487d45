"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words and runs of punctuation hash to a fixed number of buckets. Every bucket has a sparse ternary index vector; its
word vector is the sum of the index vectors seen within two tokens of it, over the whole corpus. The sums are integers, so
they do not depend on the order in which tasks end. A document's features are the mean and spread of its word vectors
and the mean agreement of neighbouring ones. The network is trained on a bounded sample of labelled rows, and its
temperature is fitted on a part of the sample that the training did not see.

Null texts count as empty; an empty text has zero features and gets the network's score for them. Without labels of
both kinds the score is the share of label 1, or 0.5 without any label. Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import bounded_batches, free_name
from vistrel.llm.labelled import training_sample

#: Buckets, dimensions and non-zeros of an index vector, tokens that a scan task gathers before it adds them up.
BUCKETS, DIMS, NONZERO, CHUNK_TOKENS = 1 << 14, 32, 4, 200_000
#: Hidden units, passes, rows of a step and step size of the network.
HIDDEN, EPOCHS, STEP_ROWS, RATE = 24, 40, 128, 3e-3
CACHE_WORDS = 150_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Tokens:
    """Bucket numbers of a text's tokens."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def ids(self, text: str | None) -> np.ndarray:
        words = TOKEN.findall(text or "")
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def index_vectors(buckets: int, dims: int) -> np.ndarray:
    """A sparse ternary vector for each bucket, and a zero one for the gap between documents."""
    rng = np.random.default_rng(20)
    out = np.zeros((buckets + 1, dims), np.float32)
    for _ in range(NONZERO):
        out[np.arange(buckets), rng.integers(0, dims, buckets)] = rng.choice(np.float32([-1, 1]), buckets)
    return out


def _context_sums(buckets: int, dims: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, index = Tokens(buckets), index_vectors(buckets, dims)
        total = np.zeros((buckets, dims))
        count = np.zeros(buckets)
        gap = np.full(2, buckets, np.int32)
        held, n = [gap], 0

        def add() -> np.ndarray:
            """Adds up all tokens but the last two, which wait for what follows; returns these and their own context."""
            ids = np.concatenate(held)
            v = index[ids]
            near = v[:-4] + v[1:-3] + v[3:-1] + v[4:]
            mid = ids[2:-2]
            for k in range(dims):
                total[:, k] += np.bincount(mid, near[:, k], buckets + 1)[:buckets]
            count[:] += np.bincount(mid, minlength=buckets + 1)[:buckets]
            return ids[-4:]

        for frame in frames:
            for text in frame["text"]:
                ids = tokens.ids(text)
                for at in range(0, len(ids), CHUNK_TOKENS):  # a very long text goes in parts that continue each other
                    held.append(ids[at : at + CHUNK_TOKENS])
                    n += len(held[-1])
                    if at + CHUNK_TOKENS >= len(ids):
                        held.append(gap)
                    if n >= CHUNK_TOKENS:
                        held, n = [add()], 0
        if n:
            add()
        seen = np.flatnonzero(count)
        out = pd.DataFrame(total[seen].astype(np.int64), columns=[f"v{k}" for k in range(dims)])
        out.insert(0, "n", count[seen].astype(np.int64))
        out.insert(0, "bucket", seen)
        yield out

    return run


def word_vectors(docs: DataFrame, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Centred unit vectors of all buckets, from every text; the table's size is fixed by the parameters."""
    names = [f"v{k}" for k in range(dims)]
    sums = (
        docs.select("text")
        .mapInPandas(_context_sums(buckets, dims), ", ".join(["bucket long", "n long", *(f"{v} long" for v in names)]))
        .groupBy("bucket")
        .agg(*(F.sum(v).alias(v) for v in ["n", *names]))
        .toPandas()
    )
    out = np.zeros((buckets, dims))
    if len(sums):
        raw = sums[names].to_numpy(float)
        n = sums["n"].to_numpy(float)[:, None]
        raw = raw / n - raw.sum(0) / n.sum()
        out[sums["bucket"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def features(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    dims = vectors.shape[1]
    out = np.zeros(2 * dims + 3, np.float32)
    if len(ids):
        v = vectors[ids]
        mean = v.mean(0)
        out[:dims] = mean
        out[dims : 2 * dims] = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, v) / len(v) - mean * mean, 0))
        if len(ids) > 1:
            out[2 * dims] = np.einsum("ij,ij->", v[1:], v[:-1]) / (len(ids) - 1)
        if len(ids) > 2:
            out[2 * dims + 1] = np.einsum("ij,ij->", v[2:], v[:-2]) / (len(ids) - 2)
        out[2 * dims + 2] = np.log1p(len(ids)) / 10
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _feature_rows(vectors):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(len(vectors.value))
        for frame in frames:
            x = [features(tokens.ids(t), vectors.value).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": x})

    return run


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Adam on the log loss of four fifths of the rows; the temperature that suits the other fifth best."""
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(vectors, np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(10)
    order = rng.permutation(len(y))
    aside, learn = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x.mean(0), x.std(0) + 1e-3
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = QualityModel(vectors, centre, scale, layers, 1.0)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // STEP_ROWS)):
            z = (x[part] - centre) / scale
            h = np.tanh(z @ layers[0] + layers[1])
            d = 1 / (1 + np.exp(-(h @ layers[2] + layers[3]))) - y[part]
            d /= len(part)
            back = np.outer(d, layers[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ d + 1e-4 * layers[2], np.array([d.sum()]))):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                layers[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(aside):
        z = model.logits(x[aside])
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=lambda t: _log_loss(z / t, y[aside])))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> QualityModel:
    spark = docs.sparkSession
    bounded_batches(spark)
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)
    rows = training_sample(docs, labels, "quality", folds, fold).mapInPandas(_feature_rows(shared), "doc_id long, label int, x binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(float) if len(rows) else np.zeros((0, 2 * DIMS + 3))
    return train_network(vectors, x, rows["label"].to_numpy(float))


def quality_score(model: QualityModel, spark) -> callable:
    """A function of the text column to the score, in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, tokens = shared.value, Tokens(len(shared.value.vectors))
        for texts in batches:
            x = np.stack([features(tokens.ids(t), model.vectors) for t in texts]) if len(texts) else np.zeros((0, 2 * DIMS + 3))
            yield pd.Series(model.scores(x.astype(float)), dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")

    def score(text: Column) -> Column:
        return udf(text)

    return score


#: A document is good enough from this score on.
GOOD_FROM = 0.3


def drop_low_quality(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    """docs without those that the classifier rejects; all columns are kept."""
    score = quality_score(fit_quality(docs, labels), docs.sparkSession)
    name = free_name(docs, "_score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= good_from).select(docs.columns)
