from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrel.functions.vector import flip_merge
from vistrel.operators import blocks, metric, retrieval, runs, samples


def vectors(spark, n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = pd.DataFrame({"image_idx": np.arange(n), "pid": rng.integers(0, 6, n), "camid": rng.integers(0, 3, n).astype("int32"), "feat": x.tolist()})
    return frame, spark.createDataFrame(frame)


def test_small_blocks_agree_with_one(spark):
    _, df = vectors(spark, 60)
    q, g = df.where("image_idx < 20"), df.where("image_idx >= 20")
    one = blocks.nearest(q, g, 5).toPandas()

    def scan(left, right, fn, schema, **_):
        return old(left, right, fn, schema, block_rows=7)

    old = blocks.block_scan
    blocks.block_scan = scan
    try:
        many = blocks.nearest(q, g, 5).toPandas()
    finally:
        blocks.block_scan = old
    order = ["a_idx", "rn"]
    pd.testing.assert_frame_equal(one.sort_values(order, ignore_index=True), many.sort_values(order, ignore_index=True))


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep all their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_meet_in_any_partition(spark, uncoalesced):
    _, df = vectors(spark, 60)
    met = blocks.block_scan(df, df, lambda x, y: pd.DataFrame({"pairs": [len(x) * len(y)]}), "pairs long", block_rows=7)
    assert met.agg(F.sum("pairs")).first()[0] == 60 * 60


def test_copies_of_a_side_do_not_grow_with_it(spark, monkeypatch):
    """Blocks grow with the side, tiles do not, and a block leaves a left row's best only."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    monkeypatch.setattr(blocks, "TILE_ROWS", 4)
    frame, df = vectors(spark, 300)
    met = blocks.block_scan(df, df, lambda x, y: pd.DataFrame({"left": [len(x)], "right": [len(y)], "tiles": [1]}), "left long, right long, tiles long", fold=lambda f: f.assign(right=f["right"].sum(), tiles=len(f))[:1]).toPandas()
    assert (met["left"] * met["right"]).sum() == 300 * 300 and met["left"].max() <= 4
    assert met["left"].sum() <= 300 * blocks.GRID and met["tiles"].max() > 4
    x = np.stack(frame["feat"])
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -np.inf)
    near = blocks.nearest(df, df, 3, same_set=True, similarity=True).toPandas().sort_values(["a_idx", "rn"])
    assert (near["b_idx"].to_numpy().reshape(300, 3) == np.argsort(-sims, axis=1, kind="stable")[:, :3]).all()


def test_average_precision_by_hand(spark):
    frame, df = vectors(spark, 80)
    got = retrieval.per_query(df.where("image_idx < 20"), df.where("image_idx >= 20")).toPandas().set_index("q_idx")
    q, g = frame[:20], frame[20:]
    for i, row in q.iterrows():
        keep = g[~((g["pid"] == row["pid"]) & (g["camid"] == row["camid"]))]
        d = np.round(1 - np.stack(keep["feat"]) @ row["feat"], 6)
        order = np.lexsort((keep["image_idx"], d))
        hit = (keep["pid"].to_numpy() == row["pid"])[order]
        if not hit.any():
            assert i not in got.index
            continue
        ranks = np.flatnonzero(hit) + 1
        assert got.loc[i, "first_hit"] == ranks[0]
        assert abs(got.loc[i, "ap"] - np.mean(np.arange(1, len(ranks) + 1) / ranks)) < 1e-6


@pytest.mark.parametrize("distance", ["cosine", "sqeuclidean"])
def test_hits_counted_over_many_blocks(spark, uncoalesced, monkeypatch, distance):
    """Ranks by parts of the queries, of the hits and of the gallery, with ties and long distances, against one sorted list a query; no row is shuffled for a hit."""
    monkeypatch.setattr(retrieval, "MOST_ROWS", 9)
    monkeypatch.setattr(retrieval, "LEAST_ASKED", 4)
    frame, _ = vectors(spark, 90)
    frame.loc[40:60, "feat"] = pd.Series([frame["feat"][0]] * 21, index=range(40, 61))
    if distance == "sqeuclidean":
        frame["feat"] = [[v * 3e7 for v in x] if n % 11 == 0 else x for n, x in enumerate(frame["feat"])]
    df = spark.createDataFrame(frame)
    q, g = df.where("image_idx < 25"), df.where("image_idx >= 25")
    expected = []
    for _, row in frame[:25].iterrows():
        kept = frame[25:][~((frame["pid"][25:] == row["pid"]) & (frame["camid"][25:] == row["camid"]))]
        x, a = np.stack(kept["feat"]), np.array(row["feat"])
        d = np.round(1 - x @ a if distance == "cosine" else (x * x).sum(1) + (a * a).sum() - 2 * x @ a, 6)
        order = np.lexsort((kept["image_idx"], d))
        hit = (kept["pid"].to_numpy() == row["pid"])[order]
        expected += [(row["image_idx"], int(i), int(r) + 1, n) for n, (i, r) in enumerate(zip(kept["image_idx"].to_numpy()[order][hit], np.flatnonzero(hit), strict=True), 1)]
    assert sorted(map(tuple, retrieval.hit_ranks(q, g, distance).collect())) == sorted(expected)
    assert retrieval._counted(q, g, distance, ()).groupBy("q_idx", "hits").count().count() < len(expected)


def test_transport_plan_prefers_equal_sets():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 5))
    assert abs(metric.transport_distance(x, x[::-1])) < 0.02 < metric.transport_distance(x, rng.normal(size=(6, 5)))


def test_centring_changes_no_distance(spark):
    _, df = vectors(spark, 30)
    moved = metric.apply_transform(df, np.eye(8), np.full(8, 0.3)).toPandas()
    a, b = np.stack(df.toPandas()["feat"]), np.stack(moved["feat"])
    dist = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
    np.testing.assert_allclose(dist(a), dist(b), atol=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "domain string, x double, y double")
    assert runs.pearson(df, "x", "y", "domain").first()["r"] is None


def test_incomplete_splits_are_refused(spark):
    import pytest
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("a", 4, 0, s, 1.0) for s in range(9)], "domain string, k long, seed long, split long, mAP double")
    summary = runs.complete_summary(df, 10)
    assert not summary.first()["complete"] and summary.first()["std"] is None
    with pytest.raises(PySparkException):
        runs.require_complete(summary).collect()


def test_padding_carries_no_weight(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(3, 4))
    padded = metric.transport_distance(np.vstack([x, np.ones((2, 4))]), y, x_pad=np.array([False] * 5 + [True] * 2))
    assert abs(padded - metric.transport_distance(x, y)) < 1e-12
    assert metric.transport_distance(x, y, y_pad=np.ones(3, bool)) == 0.0
    rows = [(0, 1, x.tolist(), y.tolist(), [False] * 5), (1, 0, x.tolist(), y.tolist(), [False] * 4 + [True])]
    pairs = spark.createDataFrame(rows, "pair_id long, label long, xs array<array<double>>, ys array<array<double>>, x_pad array<boolean>")
    got = {r["pair_id"]: r["distance"] for r in metric.alignment(pairs).collect()}
    assert abs(got[0] - metric.transport_distance(x, y)) < 1e-12 and abs(got[1] - metric.transport_distance(x[:4], y)) < 1e-12


def test_a_split_with_one_noise_value_has_no_mean_spread(spark):
    rows = [("a", 4, s, c, v, v) for s in (0, 1) for c, v in (("random", 1.0), ("random", 3.0), ("first", 2.0), ("noise", 5.0))] + [("a", 4, 0, "noise", 7.0, 7.0)]
    got = runs.sensitivity_summary(spark.createDataFrame(rows, "domain string, k long, split long, condition string, mAP double, rank1 double")).first()
    assert got["noise_std"] != got["noise_std"] and (got["rand_r1_mean"], got["oracle_r1"], got["splits"]) == (2.0, 3.0, 2)


def test_columns_are_centred_by_themselves(spark):
    rows = [("a", 0, 1.0, 1.0), ("a", 0, 2.0, 9.0), ("a", 0, None, 100.0), ("a", 1, 5.0, 2.0), ("a", 1, 7.0, 8.0), ("a", 1, float("nan"), -50.0), ("b", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "domain string, split long, x double, y double")
    frame = pd.DataFrame(rows[:-1], columns=["d", "s", "x", "y"])
    frame["x"] -= frame.groupby("s")["x"].transform("mean")
    frame["y"] -= frame.groupby("s")["y"].transform("mean")
    both = frame.dropna()
    rho = both["x"].rank().corr(both["y"].rank())
    got = runs.spearman(df, "x", "y", ("split",), "domain").collect()
    assert [(r["domain"], r["n"]) for r in got] == [("a", 6)] and abs(got[0]["rho"] - rho) < 1e-6


def test_small_helpers(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "total double, noise double")
    assert df.select(runs.noise_corrected(F.col("noise"), F.col("total")).alias("v")).first()["v"] == 7.0**0.5
    assert df.select(runs.noise_corrected(F.col("total"), F.col("noise")).alias("v")).first()["v"] == 0.0
    assert runs.pick_columns(spark.createDataFrame([(1, 2, 3)], "p_a int, p_b_x int, q int"), "p_", "") == ["p_a", "p_b_x"]
    samples.check_budget(df, 1)
    with pytest.raises(ValueError, match="budget 2"):
        samples.check_budget(df, 2)
    merged = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0])], "a array<double>, b array<double>").select(flip_merge(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert np.allclose(merged, [0.6, 0.8])


def test_stage_decision_needs_both_runs(spark):
    from pyspark.errors import PySparkException

    scores = spark.createDataFrame([("old", 50.0), ("new", 50.0), ("small", 40.0)], "run string, score double")
    row = runs.stage_decision(scores, "old", "new", "full", "small").first()
    assert (row["chosen"], row["gain"], row["full_gain"]) == ("new", 0.0, None)
    with pytest.raises(PySparkException, match="needed"):
        runs.stage_decision(scores, "old", "other", "full", "small").collect()


def plain_transport(x, y, beta=0.5, iterations=50):
    """One pair, one iteration after another."""
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    cost = 1 - x @ y.T
    plan, b = np.ones_like(cost), np.full(len(y), 1 / len(y))
    for _ in range(iterations):
        q = np.exp(-cost / beta) * plan
        a = 1 / len(x) / (q @ b)
        b = 1 / len(y) / (q.T @ a)
        plan = a[:, None] * q * b[None]
    return (plan * cost).sum()


def test_plans_of_many_pairs_together(spark, monkeypatch):
    """Sets of all sizes, in batches filled up to the largest, against one pair at a time."""
    monkeypatch.setattr(metric, "PAIRS_TOGETHER", 7)
    rng = np.random.default_rng(12)
    sets = [(rng.normal(size=(n, 6)), rng.normal(size=(m, 6))) for n in (1, 2, 5, 9) for m in (1, 3, 8)]
    rows = [(k, 1, x.tolist(), y.tolist()) for k, (x, y) in enumerate(sets)] + [(99, 0, [], sets[0][1].tolist())]
    df = spark.createDataFrame(rows, "pair_id long, label long, xs array<array<double>>, ys array<array<double>>")
    got = {r["pair_id"]: r["distance"] for r in metric.alignment(df).collect()}
    assert got.pop(99) == 0
    assert all(abs(got[k] - plain_transport(x, y)) < 1e-9 for k, (x, y) in enumerate(sets)) and len(got) == len(sets)


def test_large_plans_are_never_held(spark, monkeypatch):
    """Plans of more cells than are held go by rows, with the same costs."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 6)), rng.normal(size=(70, 6))
    df = spark.createDataFrame([(k, 1, x[: 90 - k].tolist(), y.tolist()) for k in range(5)] + [(9, 1, [], y.tolist())], "pair_id long, label long, xs array<array<double>>, ys array<array<double>>")
    monkeypatch.setattr(metric, "CELLS_TOGETHER", 500)
    got = {r["pair_id"]: r["distance"] for r in metric.alignment(df).collect()}
    assert got.pop(9) == 0 and all(abs(got[k] - plain_transport(x[: 90 - k], y)) < 1e-9 for k in range(5))
    monkeypatch.undo()
    wide = rng.normal(size=(2000, 8))
    tracemalloc.start()
    metric.transport_cost_by_rows(wide, wide[:1500], iterations=2)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000  # a plan of these has 24 MB, and several were held
    tracemalloc.stop()


def test_spaces_share_one_shuffle_and_hits_are_not_shuffled(spark, uncoalesced, monkeypatch):
    """Scores in each space equal those of images moved there beforehand; a query's hits come as one row, whatever the gallery's parts."""
    monkeypatch.setattr(retrieval, "MOST_ROWS", 9)
    monkeypatch.setattr(retrieval, "LEAST_ASKED", 4)
    rng = np.random.default_rng(3)
    spaces = [metric.Space("raw", None, np.eye(8), np.zeros(8)), metric.Space("turned", 0.1, rng.normal(size=(8, 5)), rng.normal(size=8))]
    _, df = vectors(spark, 90)
    q, g = df.where("image_idx < 25"), df.where("image_idx >= 25")
    pieces = retrieval._counted(q, g, "sqeuclidean", ())
    assert pieces.count() == pieces.select("q_idx").distinct().count()
    moved = metric.in_spaces(df, spaces)
    expected = retrieval.per_query(moved.where("image_idx < 25"), moved.where("image_idx >= 25"), "sqeuclidean", by=("space",))
    got = retrieval.per_query(q, g, "sqeuclidean", spaces=spaces)
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect())) and got.count() > 30
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
