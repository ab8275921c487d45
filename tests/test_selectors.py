"""Selectors on a synthetic pool of 300 people, four images each from four cameras."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrel.operators import clusters, samples, selectors

K, SEED = 12, 3


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(300, 32))
    x = np.repeat(centres, 4, axis=0) + 0.05 * rng.normal(size=(1200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = pd.DataFrame({"image_idx": np.arange(1200), "pid": np.arange(1200) // 4, "camid": (np.arange(1200) % 4).astype("int32"), "path": [f"img{i}" for i in range(1200)], "feat": x.tolist(), "style": x[:, :8].tolist()})
    return spark.createDataFrame(frame).withColumn("domain", F.lit("synthetic")).cache()


@pytest.fixture(scope="module")
def picked(people):
    return selectors.select(people.drop("pid"), ["domain"], selectors.SELECTORS, K, SEED).toPandas()


def test_budget_distinct_valid(picked):
    for name, rows in picked.groupby("selector"):
        assert len(rows) == K and rows["image_idx"].nunique() == K, name
        assert rows["image_idx"].between(0, 1199).all()
        assert sorted(rows["pos"]) == list(range(1, K + 1))


def test_repeatable(people, picked):
    again = selectors.select(people.drop("pid").repartition(7), ["domain"], selectors.SELECTORS, K, SEED).toPandas()
    order = ["selector", "pos"]
    pd.testing.assert_frame_equal(picked.sort_values(order, ignore_index=True), again.sort_values(order, ignore_index=True))


@pytest.mark.parametrize("name", ["dedup", "pairable", "typical", "kcenter", "camera_balanced", "facility", "facility_camera"])
def test_different_people(picked, name):
    assert (picked[picked["selector"] == name]["image_idx"] // 4).nunique() == K


@pytest.mark.parametrize("name", ["camera_balanced", "facility_camera"])
def test_all_cameras(picked, name):
    assert (picked[picked["selector"] == name]["image_idx"] % 4).nunique() == 4


def test_dedup_anchors_all_pair(spark, people, picked):
    anchors = spark.createDataFrame(picked[picked["selector"] == "dedup"][["pos", "image_idx"]])
    counts = samples.annotation_counts(samples.annotate(anchors, people, SEED)).first()
    assert (counts["k"], counts["n_pairs"], counts["n_fail"], counts["n_dup"]) == (K, K, 0, 0)


def test_labels_are_hidden(people):
    with pytest.raises(ValueError, match="pid"):
        selectors.select(people, ["domain"], ["dedup"], K, SEED)
    with pytest.raises(ValueError, match="feat"):
        selectors.select(people.drop("pid", "feat"), ["domain"], ["dedup"], K, SEED)
    with pytest.raises(ValueError, match="unknown"):
        selectors.check_names(["dedup", "nonsense"])


def test_kcenter_against_its_definition(people, picked):
    frame = people.drop("pid").toPandas().sort_values("image_idx", ignore_index=True)
    x = np.stack(frame["feat"].to_list())
    rows = picked[picked["selector"] == "kcenter"].sort_values("pos")["image_idx"].to_list()
    for n in range(1, K):
        near = np.round(x @ x[rows[:n]].T, 6).max(1)
        near[rows[:n]] = 2
        assert near[rows[n]] == near.min()


def test_exhausted_pool_is_filled(spark):
    """All images of one person in one camera: every later pick is a probable duplicate, and still the budget is met. Pools of one row, and
    budgets beyond the pool, too."""
    one = [float(x) for x in np.eye(4)[0]]
    rows = [("a", k, 0, one, one) for k in range(6)] + [("b", 9, 1, one, one)]
    pools = spark.createDataFrame(rows, "domain string, image_idx long, camid int, feat array<double>, style array<double>")
    got = selectors.select(pools, ["domain"], selectors.SELECTORS, 8, 1).toPandas()
    for name in selectors.SELECTORS:
        own = got[got["selector"] == name]
        assert sorted(own[own["domain"] == "a"]["image_idx"]) == list(range(6)), name
        assert own[own["domain"] == "b"]["image_idx"].to_list() == [9], name


def test_several_pools_in_lots(spark, people, picked, monkeypatch):
    """Pools that go on together, or one after another, each give what they give alone."""
    monkeypatch.setattr(selectors, "LOT", 1)
    both = people.drop("pid").unionByName(people.drop("pid").where("image_idx < 200").withColumn("domain", F.lit("small")))
    names = ["dedup", "hard_negative", "facility_camera"]
    got = selectors.select(both, ["domain"], names, K, SEED).toPandas()
    for name in names:
        alone = picked[picked["selector"] == name].sort_values("pos")["image_idx"].to_list()
        assert got[(got["selector"] == name) & (got["domain"] == "synthetic")].sort_values("pos")["image_idx"].to_list() == alone
        assert len(got[(got["selector"] == name) & (got["domain"] == "small")]) == K


def test_bounded_pools_as_groups(people, picked):
    names = [n for n in selectors.SELECTORS if n not in ("typical", "style_cover")]
    got = selectors.select_within(people.drop("pid"), ["domain"], names, K, SEED).toPandas()
    for name in names:
        assert got[got["selector"] == name].sort_values("pos")["image_idx"].to_list() == picked[picked["selector"] == name].sort_values("pos")["image_idx"].to_list(), name
    with pytest.raises(ValueError, match="typical"):
        selectors.select_within(people.drop("pid"), ["domain"], ["typical"], K, SEED)


def test_failed_person_is_not_retried(spark):
    images = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 2, 0), (3, 2, 1)], "image_idx long, pid long, camid int")
    anchors = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "pos long, image_idx long")
    got = {r["pos"]: r["outcome"] for r in samples.annotate(anchors, images, 0).collect()}
    assert got == {1: "fail", 2: "dup", 3: "pair"}
    got = {r["pos"]: r["outcome"] for r in samples.annotate(anchors, images, 0, cross_camera=False).collect()}
    assert got == {1: "pair", 2: "dup", 3: "pair"}


def whole_matrix(frame, has_cameras=True):
    """What a pool holds, from the matrix of all similarities."""
    x = np.stack(frame["feat"].to_list())
    sim = np.round(x @ x.T, 6)
    far = sim.copy()
    np.fill_diagonal(far, -np.inf)
    near = -np.sort(-far, axis=1)[:, :20]
    cams = frame["camid"].to_numpy()
    if has_cameras:
        far[cams[:, None] == cams[None]] = -np.inf
    best = far.argmax(1)
    mutual = np.isfinite(far.max(1)) & (best[best] == np.arange(len(x)))
    tau = np.quantile(sim[np.triu_indices(len(x), 1)], 0.99)
    return sim, 1 / np.maximum(1 - near, 1e-4).mean(1), tau, np.where(mutual, best, -1)


def test_pool_by_blocks_is_the_whole_matrix(people):
    frame = people.drop("pid").toPandas().sort_values("image_idx", ignore_index=True)
    table, tau = selectors.local_table(frame, True, SEED, block=97)
    _, typical, whole, partner = whole_matrix(frame)
    assert np.allclose(-table["_sparse"], typical, atol=1e-5) and abs(tau / selectors.UNIT - whole) < 2e-6
    assert (table["_partner"].fillna(-1).to_numpy() == partner).all()


def drawn(seed, n):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_greedy_rules_against_plain_versions(people, picked):
    """dedup, pairable, facility and hard_negative written out anew over the whole matrix."""
    frame = people.drop("pid").toPandas().sort_values("image_idx", ignore_index=True)
    sim, _, tau, partner = whole_matrix(frame)
    got = {name: rows.sort_values("pos")["image_idx"].to_list() for name, rows in picked.groupby("selector")}
    cams = frame["camid"].to_numpy()
    far = np.where(cams[:, None] == cams[None], -np.inf, sim).max(1)

    def twin(i, j):
        return i == j or sim[i, j] > tau or partner[j] == i

    def greedy(order):
        out = []
        for i in order:
            if len(out) < K and not any(twin(i, j) for j in out):
                out.append(i)
        return out

    order = drawn(SEED, len(sim))
    assert got["dedup"] == greedy(order)
    assert got["pairable"] == greedy(sorted(order, key=lambda i: -far[i]))
    out = []
    for anchor in order:
        if len(out) < K and not any(twin(anchor, j) for j in out):
            out.append(anchor)
            alike = [i for i in range(len(sim)) if sim[anchor, i] <= tau and not any(twin(i, j) for j in out)]
            if len(out) < K and alike:
                out.append(max(alike, key=lambda i: (sim[anchor, i], -i)))
    assert got["hard_negative"] == out
    out, gain_of = [], np.clip(sim, 0, None)
    while len(out) < K:
        cover = gain_of[out].max(0) if out else np.zeros(len(sim))
        gain = [-1 if any(twin(i, j) for j in out) else np.maximum(gain_of[i] - cover, 0).sum() for i in range(len(sim))]
        out.append(int(np.argmax(np.round(gain, 6))))
    assert got["facility"] == out


def test_facility_covers_drawn_rows_by_drawn_candidates(people):
    pools = people.drop("pid")
    candidates = set(drawn(f"{SEED}:cand", 1200)[:300])
    got = selectors.select(pools, ["domain"], ["facility"], K, SEED, n_eval=200, n_cand=300).toPandas()
    assert set(got["image_idx"]) <= candidates
    few = selectors.select(pools, ["domain"], ["facility"], K, SEED, n_eval=200, n_cand=5).toPandas()
    assert len(set(few["image_idx"])) == K and len(set(few["image_idx"]) & set(drawn(f"{SEED}:cand", 1200)[:5])) >= 4


def plain_kmeans(x, k, seed):
    """The same draws, one row after another."""
    def u(*key):
        return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32

    def gaps(centres):
        return ((x[:, None] - centres[None]) ** 2).sum(2)

    best = None
    for start in range(clusters.STARTS):
        centres = x[drawn(f"{seed}:{start}", len(x))[:1]]
        for stage in range(clusters.SEED_ROUNDS):
            near = gaps(centres).min(1)
            if near.sum() > 0:
                p = clusters.OVERSAMPLING * k * near / near.sum()
                centres = np.vstack([centres, x[[i for i in range(len(x)) if u(f"{seed}:{start}:{stage}", i) < p[i]]]])
        weight = np.bincount(gaps(centres).argmin(1), minlength=len(centres)).astype(float)
        rng, chosen = np.random.default_rng(seed + start), []
        for _ in range(min(k, len(centres))):
            p = weight * (((centres[:, None] - centres[chosen][None]) ** 2).sum(2).min(1) if chosen else 1.0)
            chosen.append(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right")))
        c = centres[chosen]
        for _ in range(clusters.ROUNDS):
            d = gaps(c)
            cost, label = d.min(1).sum(), d.argmin(1)
            moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
            if np.abs(moved - c).max() <= 1e-8:
                break
            c = moved
        if best is None or cost < best[0] - 1e-9:
            best = (cost, c)
    return best


def test_kmeans_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(8, 3)) * 4, 60, axis=0) + rng.normal(size=(480, 3))
    points = spark.createDataFrame([("p", i, v.tolist()) for i, v in enumerate(x)] + [("q", i, v.tolist()) for i, v in enumerate(x[:50])], "domain string, image_idx long, x array<double>")
    for parts in (1, 5):
        got = clusters.kmeans(points.repartition(parts), ["domain"], 8, 7).toPandas()
        for pool, own in (("p", x), ("q", x[:50])):
            rows = got[got["domain"] == pool].sort_values("image_idx")
            cost, centres = plain_kmeans(own, 8, 7)
            d = ((own[:, None] - centres[None]) ** 2).sum(2)
            assert (rows["label"].to_numpy() == d.argmin(1)).all()
            assert abs(rows["gap"].sum() - cost) < 1e-6 and np.allclose(rows["gap"], d.min(1), atol=1e-6)


def test_kmeans_of_few_points(spark):
    points = spark.createDataFrame([("p", k, [1.0, 2.0]) for k in range(5)] + [("q", 0, [0.0, 0.0])], "domain string, image_idx long, x array<double>")
    got = clusters.kmeans(points, ["domain"], 3, 1).toPandas()
    assert len(got) == 6 and (got["gap"] == 0).all() and got["label"].between(0, 2).all()
    assert clusters.kmeans(points.where("false"), ["domain"], 3, 1).count() == 0


def test_style_is_needed_and_used(people):
    with pytest.raises(ValueError, match="style"):
        selectors.select(people.drop("pid", "style"), ["domain"], ["style_cover"], K, SEED)
    by_camera = people.drop("pid").withColumn("style", F.array((F.col("camid") * 10.0), (F.col("image_idx") / 1e6)))
    got = selectors.select(by_camera, ["domain"], ["style_cover"], 4, SEED).toPandas()
    assert (got["image_idx"] % 4).nunique() == 4


def test_rest_follows_the_picks(spark):
    pool = spark.createDataFrame([(0, k) for k in range(5)] + [(1, k) for k in range(3)], "batch long, image_idx long")
    picked = spark.createDataFrame([(0, "a", 1, 3), (0, "a", 2, 1), (1, "a", 1, 2)], "batch long, selector string, pos long, image_idx long")
    got = samples.with_rest(pool, picked, ["batch"]).orderBy("batch", "pos").collect()
    assert [(r["batch"], r["image_idx"], r["chosen"]) for r in got] == [(0, 3, True), (0, 1, True), (0, 0, False), (0, 2, False), (0, 4, False), (1, 2, True), (1, 0, False), (1, 1, False)]


@pytest.mark.parametrize("name", ["facility", "facility_camera"])
def test_facility_covers_every_row_of_a_large_pool(spark, name):
    """More rows than were once drawn for it, against the rule written out over the whole matrix."""
    rng = np.random.default_rng(5)
    n, k = 4300, 4
    x = rng.normal(size=(n, 6)) + np.repeat(rng.normal(size=(43, 6)), 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cams = np.arange(n) % 4
    pool = spark.createDataFrame(pd.DataFrame({"domain": "d", "image_idx": np.arange(n), "camid": cams.astype("int32"), "feat": x.tolist()}))
    got = selectors.select(pool, ["domain"], [name], k, SEED).orderBy("pos").toPandas()["image_idx"].to_list()
    u = np.rint(x @ x.T * 10**6).astype(np.int64)
    tau = np.quantile(u[np.triu_indices(n, 1)], 0.99)
    far = np.where(cams[:, None] == cams[None], -(10**9), u)
    best = far.argmax(1)
    open_, cover, out = np.ones(n, bool), np.zeros(n, np.int64), []
    for _ in range(k):
        gain = np.array([np.maximum(r - cover, 0).sum() for r in u])
        score = gain / gain[open_].max() + (selectors.CAMERA_BONUS * ~np.isin(cams, cams[out]) if name == "facility_camera" else 0)
        pick = int(np.where(open_, score, -1).argmax())
        out.append(pick)
        cover = np.maximum(cover, u[pick])
        open_ &= u[pick] <= tau
        open_[pick] = False
        if best[best[pick]] == pick:
            open_[best[pick]] = False
    assert got == out


@pytest.mark.parametrize("name", ["facility"])
def test_few_candidates_are_summed_in_whole_numbers(people, picked, monkeypatch, name):
    """Single-precision bounds leave few candidates a round, and the rows are those of the rule written out."""
    scanned, scan = [], selectors.block_scan

    def recorded(*args, **kwargs):
        scanned.append(kwargs["largest"])
        return scan(*args, **kwargs)

    monkeypatch.setattr(selectors, "block_scan", recorded)
    got = selectors.select(people.drop("pid"), ["domain"], [name], K, SEED).orderBy("pos").toPandas()["image_idx"].to_list()
    assert got == picked[picked["selector"] == name].sort_values("pos")["image_idx"].to_list()
    assert len(scanned) == 2 * K and max(n for n, _ in scanned[1::2]) <= 60


def test_rough_gains_bound_the_whole_numbers():
    rng = np.random.default_rng(6)
    for scale in (1.0, 30.0, 1e-3):
        a, b = scale * rng.normal(size=(300, 64)), rng.normal(size=(900, 64)) / 8
        cover = np.clip(selectors.micro(b, a[:5]).max(1), 0, None)
        gain = np.maximum(selectors.micro(a, b) - cover, 0).sum(1)
        low, high = selectors._rough_gains(a, b, cover)
        assert (low <= gain).all() and (gain <= high).all() and (high - low < 0.01 * gain.max() + 900 * 1.1).all()
