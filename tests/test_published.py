"""Summaries held against published figures of diagnostic runs: one domain, four annotated pairs, four seeds."""

from __future__ import annotations

from vistrel.operators import runs

# Condition, seed, rank1 and mAP of each run, as published.
RUNS = [
    ("zero", 0, 4.800000041723251, 7.115698759001255),
    ("true", 4000, 28.00000011920929, 39.93945098068702),
    ("true", 4001, 27.20000147819519, 39.69164681132528),
    ("true", 4002, 30.399999022483826, 41.484785294232246),
    ("true", 4003, 28.00000011920929, 39.8430247471995),
    ("shuffle", 4000, 27.20000147819519, 39.683880878867406),
    ("shuffle", 4001, 26.399999856948853, 39.046396482075714),
    ("shuffle", 4002, 29.600000381469727, 40.951331025470864),
    ("shuffle", 4003, 28.79999876022339, 40.43077155035162),
    ("source", 4000, 28.79999876022339, 40.64828666444385),
    ("source", 4001, 28.00000011920929, 39.6668675714671),
    ("source", 4002, 26.399999856948853, 38.29563595402247),
    ("source", 4003, 23.999999463558197, 36.87743403200086),
    ("cross", 4000, 25.600001215934753, 37.536471410948785),
    ("cross", 4000, 28.79999876022339, 38.89712780894074),
    ("cross", 4001, 27.20000147819519, 38.05529525361277),
    ("cross", 4001, 29.600000381469727, 39.545369839220044),
    ("cross", 4002, 27.20000147819519, 38.95546883381707),
    ("cross", 4002, 28.00000011920929, 38.93048165211575),
    ("cross", 4003, 28.00000011920929, 38.73121889338502),
    ("cross", 4003, 27.20000147819519, 37.7162005509965),
]
# mAP, its difference to the true pairs, rank1 and number of runs of each condition, as published.
SUMMARY = {
    "true": (40.23972695836101, 0.0, 28.4000001847744, 4),
    "shuffle": (40.0280949841914, -0.2116319741696131, 28.00000011920929, 4),
    "cross": (38.54595428037958, -1.6937726779814284, 27.700000628829002, 8),
    "source": (38.87205605548357, -1.3676709028774425, 26.799999549984932, 4),
}


def test_diagnostics_summary(spark):
    rows = spark.createDataFrame([("d", 4, c, seed, r, m) for c, seed, r, m in RUNS], "domain string, k long, condition string, seed long, rank1 double, mAP double")
    got = {r["condition"]: r for r in runs.diagnostics_summary(rows).collect()}
    assert got.keys() == SUMMARY.keys()
    for condition, (m, gain, rank1, n) in SUMMARY.items():
        r = got[condition]
        assert abs(r["mAP"] - m) < 1e-6 and abs(r["d_mAP"] - gain) < 1e-6 and abs(r["rank1"] - rank1) < 1e-6
        assert r["n"] == n and abs(r["zero_mAP"] - 7.115698759001255) < 1e-6


def test_mean_over_seeds_of_one_split(spark):
    """A two-level mean over one split is the flat mean of the seeds, and its deviation that of the seeds."""
    rows = spark.createDataFrame([("d", 0, 4, seed, m) for c, seed, _, m in RUNS if c == "true"], "domain string, split long, k long, seed long, mAP double")
    r = runs.two_level(rows).first()
    assert abs(r["mean"] - SUMMARY["true"][0]) < 1e-6 and r["n_seeds"] == 4
