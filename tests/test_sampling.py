"""Keyed permutations and the samplers over them."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from vistrel.functions.permute import permuted, round_numbers
from vistrel.operators import samples


def orders(spark, n: int, keys: int) -> list[tuple]:
    rows = spark.range(keys).withColumn("numbers", round_numbers(5, "id")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    out = rows.select("id", "place", permuted(F.col("place"), F.lit(n).cast("long"), F.col("numbers")).alias("x")).collect()
    by = {}
    for i, p, x in sorted(map(tuple, out)):
        by.setdefault(i, []).append(x)
    return [tuple(by[k]) for k in sorted(by)]


def test_permutations(spark):
    for n in (1, 2, 3, 17, 64):
        for order in orders(spark, n, 20):
            assert sorted(order) == list(range(n))


def test_orders_are_spread_evenly(spark):
    """All orders of four come up, none much more often than another; each number leads equally often."""
    got = Counter(orders(spark, 4, 2400))
    assert len(got) == 24 and max(got.values()) < 150 and min(got.values()) > 60
    first = Counter(o[0] for o in orders(spark, 10, 2000))
    assert len(first) == 10 and max(first.values()) < 260 and min(first.values()) > 145


def test_large_numbers(spark):
    n = 2**40 + 7
    row = spark.range(1).withColumn("numbers", round_numbers(1, "id"))
    places = [0, 1, n - 1, n // 2]
    out = row.select(*(permuted(F.lit(p), F.lit(n), F.col("numbers")).alias(f"p{k}") for k, p in enumerate(places))).first()
    assert len(set(out)) == 4 and all(0 <= x < n for x in out)


def test_every_pair_has_a_number(spark):
    """With no limit on pairs, each same-identity pair comes up once and so do equally many different others."""
    pids = [3, 1, 1, 2, 3, 3, 9, 2, 1, 7, 7, 7, 7]
    rows = [(b, 10 * b + k if b < 9 else 100 + k, p) for b in (0, 5) for k, p in enumerate(pids)] + [(9, 200, 1), (9, 201, 1), (8, 300, 1), (8, 301, 2), (7, 400, 1)]
    df = spark.createDataFrame(rows, "batch long, image_idx long, pid long")
    got = [tuple(r) for r in samples.balanced_pairs(df, 4, most=10_000).collect()]
    who = {(b, i): p for b, i, p in rows}
    for b in (0, 5):
        for label in (0, 1):
            pairs = [(x, y) for k, x, y, lab in got if k == b and lab == label]
            own = sum(n * (n - 1) // 2 for n in Counter(pids).values())
            assert len(pairs) == len(set(pairs)) == own
            assert all(x < y and (who[b, x] == who[b, y]) == bool(label) for x, y in pairs)
    assert {r[0] for r in got} == {0, 5}  # the others have pairs of one kind at most


def test_batches(spark):
    ids = spark.createDataFrame([("a", k) for k in range(40)] + [("b", k) for k in range(5)], "domain string, pid long")
    by: dict = {}
    for b, slot, d, p in map(tuple, samples.batches(ids, 60, 8, 3, unique=True).collect()):
        by.setdefault(b, []).append((slot, d, p))
    assert len(by) == 60 and {d for v in by.values() for _, d, _ in v} == {"a", "b"}
    for v in by.values():
        assert [s for s, _, _ in sorted(v)] == list(range(8)) and len({d for _, d, _ in v}) == 1
        assert len({p for _, _, p in v}) == (8 if v[0][1] == "a" else len({p for _, _, p in v}))
    assert any(len({p for _, _, p in v}) < 8 for v in by.values() if v[0][1] == "b")
    mixed = samples.batches(ids, 30, 45, 3, unique=True, mixed=True)
    assert all(r["n"] == 45 for r in mixed.groupBy("batch").agg(F.countDistinct("domain", "pid").alias("n")).collect())
    assert mixed.select("batch").distinct().count() == 30


def test_rows_written_follow_the_slots(spark):
    """No row for an identity that is not drawn: the plan joins slots by number."""
    ids = spark.range(1000).select(F.lit("a").alias("domain"), F.col("id").alias("pid"))
    plan = samples.batches(ids, 10, 4, 3, unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "(i#" in plan and plan.count("Join") == 3
