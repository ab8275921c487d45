from __future__ import annotations

import zlib

import numpy as np
import pytest

from vistrel.llm.labelled import held_out, training_sample
from vistrel.llm.quality import drop_low_quality, features, fit_quality, quality_score, train_network, word_vectors
from vistrel.llm.queries import QUERIES
from vistrel.llm.toxicity import fit_toxicity, score_toxicity, sentence_of, spans, train_noisy_or

BIG = "/root/testdata/sf0.1"


def tables(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_folds(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_sample_is_bounded_and_leaves_the_fold_out(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    got = training_sample(docs, labels.unionByName(labels), "toxic", 3, 1, rows=20).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == 20
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)


def quality_of(got, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return np.array(held)


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark, BIG)
    got = QUERIES["op10_quality"](spark, BIG).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = quality_of(got, labels, "quality")
    assert (held[:, 0] == held[:, 1]).mean() > 0.97
    assert held[held[:, 1] == 1][:, 0].mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark, BIG)
    got = QUERIES["op1_toxicity"](spark, BIG).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = quality_of(got, labels, "toxic")
    assert held[held[:, 1] == 1][:, 0].mean() > 0.75
    assert held[held[:, 1] == 0][:, 0].mean() < 0.02


def test_edges(spark, sf_dir, documents, edge_rows):
    train, labels = tables(spark, sf_dir)
    docs = documents(edge_rows)
    model = fit_toxicity(train, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(edge_rows) and {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    score = quality_score(fit_quality(train, labels), spark)
    got = docs.select("doc_id", score(docs["text"]).alias("s")).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["s"] <= 1 for r in got)
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("which", ["none", "one kind"])
def test_without_labels_of_both_kinds(spark, sf_dir, which):
    docs, labels = tables(spark, sf_dir)
    labels = labels.limit(0) if which == "none" else labels.where("toxic = 0 and quality = 1")
    assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()} == {0.0}
    score = quality_score(fit_quality(docs, labels), spark)
    assert {r["s"] for r in docs.select(score(docs["text"]).alias("s")).collect()} == {0.5 if which == "none" else 1.0}
    assert drop_low_quality(docs.limit(0), labels).count() == 0


def test_offending_sentences_are_located():
    rng = np.random.default_rng(0)
    words = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(300):
        s = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if k % 3 == 0:
            s[k % 5] = s[k % 5] + " vilething"
        texts.append(". ".join(s) + ".")
        labels.append(k % 3 == 0)
    model = train_noisy_or(texts, np.array(labels, float))
    from vistrel.llm.toxicity import Bags

    bags = Bags()
    ids = bags.ids(texts[3])
    p = model.sentences(ids, np.array([model.word(w) for w in bags.words]))
    bad = int(p.argmax())
    start, end = spans(texts[3])[bad]
    assert p[bad] > 0.5 > np.delete(p, bad).max() and "vilething" in texts[3][start:end]
    assert sentence_of(ids)[2] == len(spans(texts[3])) == 5


def test_word_vectors_ignore_partitioning(spark, sf_dir):
    docs, _ = tables(spark, sf_dir)
    np.testing.assert_array_equal(word_vectors(docs.repartition(2)), word_vectors(docs.repartition(5)))


def test_temperature_calibrates():
    """Overconfident logits get a temperature above one."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 67))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    model = train_network(np.zeros((4, 32), np.float32), x, y)
    p = model.scores(x)
    assert abs(p.mean() - y.mean()) < 0.05 and model.temperature > 1


def test_features_of_nothing():
    assert not features(np.zeros(0, np.int32), np.zeros((4, 32), np.float32)).any()


def sums_of(texts, buckets, dims, chunk=None):
    """Context sums and counts by bucket, from the scan function over the texts in one task."""
    import pandas as pd

    from vistrel.llm import quality

    before = quality.CHUNK_TOKENS
    quality.CHUNK_TOKENS = chunk or before
    try:
        (out,) = quality._context_sums(buckets, dims)(iter([pd.DataFrame({"text": texts})]))
    finally:
        quality.CHUNK_TOKENS = before
    return {r[0]: tuple(r[1:]) for r in out.itertuples(index=False, name=None)}


def plain_sums(texts, buckets, dims):
    """Random indexing word by word."""
    from vistrel.llm import quality

    index, out = quality.index_vectors(buckets, dims), {}
    for text in texts:
        ids = [zlib.crc32(w.encode()) % buckets for w in quality.TOKEN.findall(text or "")]
        for k, w in enumerate(ids):
            near = [ids[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(ids)]
            n, total = out.get(w, (0, np.zeros(dims)))
            out[w] = (n + 1, total + sum((index[j] for j in near), np.zeros(dims)))
    return {w: (n, *(int(x) for x in total)) for w, (n, total) in out.items()}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50, None])
def test_random_indexing_against_word_by_word(chunk):
    """Wherever long texts are cut, no word loses its context and no text gets another's."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in (0, 1, 2, 3, 4, 5, 49, 50, 51, 200)] + [None, "one two, three!"]
    assert sums_of(texts, 64, 8, chunk) == plain_sums(texts, 64, 8)


def test_a_text_longer_than_a_part():
    text = " ".join(f"w{k % 977}x{k % 13}" for k in range(400_001))
    assert sums_of([text], 256, 4) == sums_of([text], 256, 4, 10**9)


def test_quality_scores_against_plain_scoring(spark, sf_dir, documents, edge_rows):
    """Each text's features and network written out, from the same model."""
    from vistrel.llm import quality

    docs, labels = tables(spark, sf_dir)
    model = fit_quality(docs, labels)
    w1, b1, w2, b2 = model.layers

    def plain(text):
        v = [model.vectors[zlib.crc32(w.encode()) % quality.BUCKETS].astype(float) for w in quality.TOKEN.findall(text or "")]
        x, d = np.zeros(2 * quality.DIMS + 3), quality.DIMS
        if v:
            x[:d] = sum(v) / len(v)
            x[d : 2 * d] = np.sqrt(np.maximum(sum(a * a for a in v) / len(v) - x[:d] ** 2, 0))
            x[2 * d : 2 * d + 2] = [sum(float(a @ b) for a, b in zip(v, v[s:], strict=False)) / (len(v) - s) if len(v) > s else 0 for s in (1, 2)]
            x[2 * d + 2] = np.log1p(len(v)) / 10
        z = np.tanh((x - model.centre) / model.scale @ w1 + b1) @ w2 + b2
        return float((1 / (1 + np.exp(-z / model.temperature)))[0])

    rows = edge_rows + [(900 + k, r["text"]) for k, r in enumerate(docs.limit(40).collect())]
    df = documents(rows)
    score = quality_score(model, spark)
    for r in df.select("text", score(df["text"]).alias("s")).collect():
        assert abs(r["s"] - plain(r["text"])) < 2e-4


def test_noisy_or_against_plain_scoring(spark, sf_dir, documents, edge_rows):
    """Each sentence's words added up one by one, from the same model."""
    import re

    from vistrel.llm import toxicity

    docs, labels = tables(spark, sf_dir)
    model = fit_toxicity(docs, labels)

    def plain(text):
        none = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(r"\w+", sentence)
            if words:
                z = model.bias + sum(model.weights[b] for w in words for b in toxicity.buckets_of(w))
                none *= 1 - min(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 - 1e-12)
        return 1 - none

    rows = edge_rows + [(900 + k, r["text"]) for k, r in enumerate(docs.limit(60).collect())]
    df = documents(rows)
    want = sorted((str(r["doc_id"]), round(plain(r["text"]), 7)) for r in df.collect())
    got = sorted((str(r["doc_id"]), round(r["score"], 7)) for r in score_toxicity(df, model).collect())
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=1e-6)


def test_training_follows_the_gradient_of_the_noisy_or(monkeypatch):
    """After one step from zero, each weight moves against the numeric gradient of the documents' log loss."""
    from vistrel.llm import toxicity

    texts = ["bad thing here. fine day", "good day. nice thing", "all bad! bad words", "nice words here"]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "PULL", 0.0)
    model = train_noisy_or(texts, labels)

    def loss(weights):
        out = 0.0
        for text, y in zip(texts, labels, strict=True):
            none = 1.0
            for sentence in text.replace("!", ".").split("."):
                words = sentence.split()
                if words:
                    z = toxicity.BIAS + sum(weights.get(b, 0.0) for w in words for b in toxicity.buckets_of(w))
                    none *= 1 - 1 / (1 + np.exp(-z))
            out -= np.log(1 - none) if y else np.log(none)
        return out / len(texts)

    used = {b for t in texts for w in t.replace("!", " ").replace(".", " ").split() for b in toxicity.buckets_of(w)}
    assert set(np.flatnonzero(model.weights)) <= used
    moved = 0
    for b in used:
        slope = (loss({b: 1e-4}) - loss({b: -1e-4})) / 2e-4
        if abs(slope) > 1e-6:
            assert np.sign(model.weights[b]) == -np.sign(slope)
            moved += 1
    assert moved > 10
