"""Closed forms against the definitions they replace."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from vistrel.operators import logs, metric, ranks, runs


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"image_idx": range(90), "pid": rng.integers(0, 12, 90), "camid": rng.integers(0, 3, 90).astype("int32"), "batch": np.arange(90) // 30})
    frame.loc[:9, "pid"] = 50  # half of it in one camera only
    frame.loc[:9, "camid"] = 1
    x = rng.normal(size=(90, 5))
    x[1] = x[0]
    frame["feat"] = x.tolist()
    return spark.createDataFrame(frame)


def test_covariance_of_all_pairs(people):
    f = people.toPandas()
    x, total, n = np.stack(f["feat"].to_list()), np.zeros((5, 5)), 0
    for _, own in f.groupby("pid"):
        if own["camid"].nunique() >= 2:
            for a in own.index:
                for b in own.index[own.index > a]:
                    total += np.outer(x[a] - x[b], x[a] - x[b])
                    n += 1
    got = np.zeros((5, 5))
    for r in metric.within_covariance(people).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, total / n)
    assert metric.within_covariance(people.where("camid = 1")).count() == 0
    plan = metric.within_covariance(people)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the identities' counts


def test_all_triplets(people):
    f, want = people.toPandas(), {}
    for batch, own in f.groupby("batch"):
        x, pid = np.stack(own["feat"].to_list()), own["pid"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        loss = [d[a, p] - d[a, n] + 0.3 for a in range(len(x)) for p in range(len(x)) for n in range(len(x)) if p != a and pid[p] == pid[a] != pid[n]]
        active = [v for v in loss if v > 1e-16]
        want[batch] = (len(loss), len(active), sum(active) / len(active))
    for r in metric.all_triplets(people, 0.3).collect():
        n, active, loss = want.pop(r["batch"])
        assert (r["n_triplets"], r["n_active"]) == (n, active) and abs(r["loss"] - loss) < 2e-6
    assert not want


def test_an_equal_negative_is_not_active(spark):
    rows = [(0, 0, 1, [0.0]), (0, 1, 1, [1.0]), (0, 2, 2, [2.0])]
    df = spark.createDataFrame(rows, "batch long, image_idx long, pid long, feat array<double>")
    got = metric.all_triplets(df, 1.0).first()  # the anchor at 0 has the negative at just the distance of its positive and the margin
    assert (got["n_triplets"], got["n_active"], got["loss"]) == (2, 1, 1.0)


def test_ranks_over_many_parts(spark):
    rng = np.random.default_rng(6)
    f = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.19, 0.01]), "v": rng.integers(0, 200, 3000) / 7})
    counts = spark.createDataFrame(f.groupby(["g", "v"]).size().reset_index(name="n"))
    got = ranks.value_ranks(counts, ["g"], "v", "n").toPandas()
    f["want"] = f.groupby("g")["v"].rank(method="average")
    both = f.merge(got, on=["g", "v"])
    assert len(both) == 3000 and np.allclose(both["want"], both["rank"])


def test_rank_correlation(spark):
    rng = np.random.default_rng(7)
    f = pd.DataFrame({"domain": rng.choice(["a", "b"], 400), "split": rng.integers(0, 3, 400), "x": rng.integers(0, 30, 400).astype(float), "y": rng.normal(size=400).round(1)})
    f.loc[::17, "x"] = np.nan
    got = {r["domain"]: r["rho"] for r in runs.spearman(spark.createDataFrame(f), "x", "y", ("split",), "domain").collect()}
    for c in ("x", "y"):
        f[c] = (f[c] - f.groupby(["domain", "split"])[c].transform("mean")).round(9)
    for domain, own in f.dropna().groupby("domain"):
        assert abs(got[domain] - own["x"].rank().corr(own["y"].rank())) < 2e-6


def test_area_under_the_curve(spark):
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"lang": rng.choice(["a", "b"], 500), "truth": rng.integers(0, 2, 500), "score": rng.integers(-9, 9, 500) / 3})
    f = pd.concat([f, pd.DataFrame({"lang": "c", "truth": [1, 1], "score": [0.5, -0.5]})])
    got = {r["lang"]: r for r in metric.question_metrics(spark.createDataFrame(f), "lang").collect()}
    for lang in "ab":
        own = f[f["lang"] == lang]
        p, n = own[own["truth"] == 1]["score"].to_numpy(), own[own["truth"] == 0]["score"].to_numpy()
        auc = ((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean()
        assert abs(got[lang]["auc"] - auc) < 2e-6 and got[lang]["n"] == len(own)
    assert got["c"]["auc"] is None and got["c"]["accuracy"] == 0.5


def test_running_average_over_parts(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for run, n in (("one", 1), ("two", 2), ("long", 20_000)):
        loss = rng.normal(size=n) + 3
        steps = np.arange(n) * 3 + 5000
        value = loss[0]
        for v in loss[1:]:
            value = value * 0.999 + v * 0.001
        want[run] = value
        rows += [(run, int(s), float(v)) for s, v in zip(steps, loss, strict=True)]
    df = spark.createDataFrame(rows, "run string, step long, loss double").repartition(6)
    got = {r["run"]: r["ema"] for r in logs.running_ema(df, 0.999).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_folds_of_long_lists_look_at_sets_of_flags(spark):
    """Positions past 32 bits, options without flags, repeated flags and sets in other orders, against a plain fold."""
    from vistrel.operators.runs import fold_options

    options = [(n % 3, 2**40 + n, "plain" if n % 9 == 0 else f"--f{n % 13} 1 --g{n % 8} 2" if n % 2 else f"--g{n % 8} 2 --f{n % 5} --f{n % 5}") for n in range(600)]
    expected = []
    seen = {k: set() for k in range(3)}
    for plan, pos, option in options:
        flags = {w for w in option.split() if w.startswith("--")}
        if not flags & seen[plan]:
            seen[plan] |= flags
            expected.append((plan, pos, option))
    got = fold_options(spark.createDataFrame(options, "plan long, pos long, option string"), "plan")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_pairs_of_an_identity_spread_over_tasks(spark, sf_dir):
    from pyspark.sql import functions as F

    from vistrel.plans.retrievals import retrieval_euclidean_hits

    found = retrieval_euclidean_hits(spark, sf_dir)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
