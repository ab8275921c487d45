"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is a logistic function of the hashed words in it; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are needed: the gradient of the document's loss reaches every sentence
in the share it has in the noisy-or. The learnt sentence probabilities then locate the offending sentences.
Training runs on a bounded sample of labelled rows.

Null texts count as empty; a text without words scores 0. Without labels of both kinds all scores are the share of
label 1 (0 without any label). Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import bounded_batches
from vistrel.llm.labelled import training_sample

#: Buckets of the hashed words; steps, step size and pull to zero of the training; sentence probability that offends.
BUCKETS, STEPS, RATE, PULL, OFFENDS = 1 << 16, 160, 0.15, 2e-5, 0.5
#: Labelled documents that are trained on at most, with their whole texts.
TRAINING_ROWS = 9_000
#: Where a sentence starts: its log odds without words.
BIAS = -5.0
CACHE_WORDS = 100_000
#: Besides itself a word has its beginnings of these lengths as features, so inflected forms share what is learnt.
STEMS = (4, 5, 6)
TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def buckets_of(word: str) -> list[int]:
    word = word.lower()
    keys = [word, *(f"{n}:{word[:n]}" for n in STEMS if len(word) >= n)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys]


class Bags:
    """Numbers of a text's words in a list of known words, with -1 at the end of each sentence."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = dict.fromkeys(_ENDS, -1)
        self.words: list[str] = []

    def ids(self, text: str | None) -> np.ndarray:
        words = TOKEN.findall(text or "")
        for w in set(words).difference(self.numbers):
            self.numbers[w] = len(self.words)
            self.words.append(w)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))


def sentence_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The words, the number of the sentence that each belongs to, and how many sentences have words."""
    ends = ids < 0
    sentence = np.cumsum(ends)[~ends]
    words = ids[~ends]
    if not len(words):
        return words, sentence, 0
    fresh = np.diff(sentence, prepend=sentence[0]) > 0
    return words, np.cumsum(fresh), int(fresh.sum()) + 1


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def word(self, word: str) -> float:
        return float(self.weights[buckets_of(word)].sum())

    def sentences(self, ids: np.ndarray, word_weights: np.ndarray) -> np.ndarray:
        """Probability of each sentence that has words."""
        words, sentence, n = sentence_of(ids)
        z = self.bias + np.bincount(sentence, word_weights[words], n) if n else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def document(self, p: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def train_noisy_or(texts: list[str | None], labels: np.ndarray) -> ToxicityModel:
    if len(labels) == 0 or labels.min() == labels.max():
        return ToxicityModel(np.zeros(BUCKETS), BIAS, float(labels.mean()) if len(labels) else 0.0)
    bags, parts, sizes = Bags(), [], []
    for text in texts:
        w, s, m = sentence_of(bags.ids(text))
        parts.append(np.stack([w, s]).astype(np.int32))
        sizes.append(m)
    n = sum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.cumsum(sizes) - sizes
    words = np.concatenate([p[0] for p in parts]).astype(np.int64)
    sentence = np.concatenate([p[1] + k for p, k in zip(parts, shift, strict=True)])
    flat, lengths = array("i"), array("i")
    for word in bags.words:
        keys = buckets_of(word)
        flat.extend(keys)
        lengths.append(len(keys))
    n_words = len(bags.words)
    del parts, bags
    owner = np.repeat(np.arange(n_words), np.frombuffer(lengths, np.int32))
    used, feature = np.unique(np.frombuffer(flat, np.int32), return_inverse=True)
    w, bias = np.zeros(len(used)), BIAS
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, np.bincount(owner, w[feature], n_words)[words], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)))
        some = np.maximum(1 - none, 1e-9)
        share = np.where(labels == 1, -none / some, 1.0) / len(labels)
        d = p * share[document]
        g, gb = np.bincount(feature, np.bincount(words, d[sentence], n_words)[owner], len(used)), d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.999**step
        rate = RATE / (np.sqrt(v / b) + 1e-6)
        w -= rate * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PULL, 0)
        bias -= 0.3 * RATE * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return ToxicityModel(weights, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> ToxicityModel:
    bounded_batches(docs.sparkSession)
    rows = training_sample(docs, labels, "toxic", folds, fold, TRAINING_ROWS).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return train_noisy_or(rows["text"].tolist(), rows["label"].to_numpy(float))


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that has words, in code points."""
    out, start, end = [], None, 0
    for t in TOKEN.finditer(text):
        if t.group() in _ENDS:
            if start is not None:
                out.append((start, t.end() if t.group() != "\n" else end))
            start = None
        else:
            start, end = t.start() if start is None else start, t.end()
    if start is not None:
        out.append((start, end))
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, offends: float = OFFENDS) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences as (start, end, p), likeliest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, bags, weights = shared.value, Bags(), np.zeros(0)
        for frame in frames:
            score, count, found = [], [], []
            if len(bags.words) > CACHE_WORDS:
                bags.forget()
                weights = np.zeros(0)
            for text in frame["text"]:
                ids = bags.ids(text)
                if len(bags.words) > len(weights):
                    weights = np.concatenate([weights, [model.word(w) for w in bags.words[len(weights) :]]])
                p = model.sentences(ids, weights)
                score.append(model.document(p))
                count.append(len(p))
                bad = np.flatnonzero(p >= offends)
                at = spans(text) if len(bad) else []
                found.append([{"start": at[k][0], "end": at[k][1], "p": float(p[k])} for k in sorted(bad, key=lambda k: -p[k])])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": np.array(score, float), "n_sentences": np.array(count, np.int64), "offending": found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,p:double>>")
