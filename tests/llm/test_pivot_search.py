"""Top-k search against every product in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from vistrel.llm import pivot_search
from vistrel.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v binary, d string, cell int, part long, norm double, least double"


def frame(spark, vectors, partitions=3):
    return spark.createDataFrame([(i, v, 1, 2, b"x", "d", 3, 4, 5.0, 6.0) for i, v in vectors], SCHEMA).repartition(partitions)


def plain(vectors, k, scale=64, every=20):
    usable = []
    for i, v in vectors:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        most = 2**63 - 1
        scored = [(-max(-most - 1, min(most, sum(a * b for a, b in zip(q, x, strict=False)))), j is None, j or 0, j) for m, (j, x) in enumerate(usable) if m != n]
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, vectors, k=20, **more):
    out = pivot_search.top_k(frame(spark, vectors), F.col("vec_id") % 20 == 0, k=k, scale=64.0, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_oracle(spark, sf_dir):
    assert_same(QUERIES["op12_pivot_search"](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES["op12_pivot_search"]).df())


def test_clusters_in_many_blocks(spark, monkeypatch):
    """Clusters apart from each other, one with a third of the rows, several blocks, lots and chunks of summaries."""
    monkeypatch.setattr(pivot_search, "QUERY_ROWS", 7)
    monkeypatch.setattr(pivot_search, "SUMMARY_ROWS", 5)
    monkeypatch.setattr(pivot_search, "STEP", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6)) * 8
    vectors = [(k, (centres[0 if k % 3 == 0 else k % 9] + rng.normal(size=6) * 0.3).tolist()) for k in range(900)]
    assert got(spark, vectors, block_rows=40, pivots=8) == plain(vectors, 20)


def test_chunks_meet_in_any_partition(spark, monkeypatch):
    """Shuffles keep all their partitions, as large ones do."""
    monkeypatch.setattr(pivot_search, "ASKING_ROWS", 7)
    monkeypatch.setattr(pivot_search, "SUMMARY_ROWS", 5)
    rng = np.random.default_rng(5)
    vectors = [(k, rng.normal(size=6).tolist()) for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, vectors, block_rows=20, pivots=8) == plain(vectors, 20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    for spread in (1.0, 1e3, 1e6):
        x = np.floor(rng.normal(size=(400, 5)) * spread) + np.floor(rng.normal(size=(1, 5)) * 1e6) * (rng.random((400, 1)) < 0.5)
        d = np.sqrt(((x[:, None] - x[None, :6]) ** 2).sum(2)).astype(np.float32)
        norm = (x**2).sum(1)
        bound = pivot_search._bound(norm, norm, pivot_search._apart(d, d), d, d)
        assert (bound >= x @ x.T).all()
        assert (bound < (norm[:, None] + norm) / 2 - 1).mean() > 0.3


def test_edges(spark):
    """Nulls, non-finite and missing components, short and empty vectors, ties, repeated rows and ids, missing ids, fewer than k."""
    tie = [0.5, 0.25, -1.0]
    vectors = [(0, tie), (20, None), (40, [1.0, None, 2.0]), (60, [1.0, float("nan"), 0.0]), (80, [float("inf"), 1.0, 0.0]), (100, []), (120, [0.3]), (140, tie), (140, tie), (140, [9.0, 9.0, 9.0]), (-20, [-0.01, 0.01, 0.0]), (None, tie), (None, None)]
    vectors += [(k, tie) for k in range(1, 12)] + [(7, tie)] * 2 + [(2**62 + 1, [2.0, 2.0]), (2**62 + 20, [1.0, 2.0])]
    for k in (3, 50):
        assert got(spark, vectors, k=k) == plain(vectors, k)


def test_hot_vector(spark):
    """A vector that more than a third of all rows repeat."""
    vectors = [(k, [1.0, 2.0, 3.0] if k % 5 < 2 else [math.sin(k), math.cos(k), k % 7 / 7]) for k in range(600)]
    assert got(spark, vectors, block_rows=50) == plain(vectors, 20)


def test_long_components(spark):
    """Products that need more than a double holds, and scores that no long holds."""
    vectors = [(k * 10, [float(2 ** (k % 40)) + 0.25, -float(3 ** (k % 25)), 1.0, float(k)]) for k in range(80)] + [(800, [3e30, 1.0, 1.0, 1.0]), (810, [3e30, 0.0, 0.0, 0.0]), (820, [-3e30, 5.0, 0.0, 0.0])]
    assert got(spark, vectors, k=5, block_rows=16) == plain(vectors, 5)


@pytest.mark.parametrize("vectors", [[], [(20, [1.0])], [(20, None), (40, None)]])
def test_nothing_to_find(spark, vectors):
    assert got(spark, vectors) == []
