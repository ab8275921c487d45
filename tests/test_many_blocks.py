"""Queries over pools of several blocks against their SQL, as shuffles keep all their partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tests.oracle import assert_same, connect
from vistrel.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many(tmp_path_factory: pytest.TempPathFactory) -> str:
    """5 500 vectors, of which 2 200 are a pool and 4 400 a gallery; tables that no query here reads are empty."""
    from tests.oracle import TABLES

    folder, rng = tmp_path_factory.mktemp("many"), np.random.default_rng(4)
    x = rng.normal(size=(5500, 64)) + 2 * rng.normal(size=(50, 64))[rng.integers(0, 50, 5500)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = pd.DataFrame({"vec_id": np.arange(5500), "embedding": list(x), "label": rng.integers(0, 10, 5500).astype("int32")})
    for t in TABLES:
        (rows if t == "embeddings" else rows[:0]).to_parquet(folder / f"{t}.parquet", index=False)
    return str(folder)


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep all their partitions, as large ones do, and there are enough for two block numbers hardly to share one by chance."""
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", few)


#: Queries that met their rows in blocks whose numbers had two types.
MET_IN_BLOCKS = [
    "mutual_partner",
    "nearest_neighbours",
    "pool_statistics",
    "retrieval_cmc_map",
    "retrieval_euclidean_map",
    "retrieval_hit_ranks",
    "retrieval_per_query_ap",
    "retrieval_topk",
    "select_camera_balanced",
    "select_dedup",
]


@pytest.mark.parametrize("name", MET_IN_BLOCKS)
def test_oracle_over_many_blocks(spark, uncoalesced, many, name):
    assert_same(QUERIES[name](spark, many).toPandas(), connect(many).execute(ORACLES[name]).df())


#: Queries that rank all hits.
RANKING = ["retrieval_cmc_map", "retrieval_euclidean_map", "retrieval_hit_ranks", "retrieval_per_query_ap"]


@pytest.mark.parametrize("name", RANKING)
def test_no_hit_is_shuffled(spark, uncoalesced, many, name):
    """Vectors are shuffled once, to the parts that rank them; after that only one row of sums a task, where there are sums."""
    plan = QUERIES[name](spark, many)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(word in plan for word in ("FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas"))
