"""k-means over pools of any size: k-means|| seeding, several starts, Lloyd's rounds with partial sums.

Draws are hashes of seed, start, round and image, and sums are taken in whole numbers, so the result doesn't depend on how rows are
partitioned. Tasks get the centres (pools x starts x k vectors) and send one sum a cluster; no rows pass through the driver but
the drawn ones, about twice k a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from vistrel.functions.draw import draw_key
from vistrel.operators.blocks import matrix

#: Independent starts, rounds of seeding, draws of a seeding round for each cluster, and rounds of refinement at most.
STARTS, SEED_ROUNDS, OVERSAMPLING, ROUNDS = 3, 3, 2, 25
#: Sums are whole multiples of one over this.
UNIT = 10**8

Centres = dict[tuple, list[np.ndarray]]


def squared_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to each centre, the same for a row whatever rows stand beside it."""
    out = np.empty((len(x), len(centres)))
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        out[at : at + 256] = ((part[:, None, :] - centres[None]) ** 2).sum(2)
    return out


def _by_pool(by: list[str], centres: Centres, fn: Callable[[tuple, pd.DataFrame, np.ndarray, np.ndarray, int], pd.DataFrame]):
    """fn(pool, rows, vectors, centres, start) for the rows of each pool in a batch and each start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, rows in f.groupby(by, sort=False, dropna=False):
                x = matrix(rows["x"])
                for start, c in enumerate(centres.get(key, ())):
                    if len(out := fn(key, rows, x, c, start)):
                        for n, name in enumerate(by):
                            out.insert(n, name, rows[name].iloc[0])
                        yield out

    return run


def _cost(key: tuple, rows: pd.DataFrame, x: np.ndarray, c: np.ndarray, start: int) -> pd.DataFrame:
    return pd.DataFrame({"start": [start], "cost": [int(np.rint(squared_gaps(x, c).min(1) * UNIT).sum())]})


def _drawn(chances: dict[tuple, list[float]], key: tuple, rows: pd.DataFrame, x: np.ndarray, c: np.ndarray, start: int) -> pd.DataFrame:
    took = rows["u"].map(lambda u: u[start]).to_numpy() < chances[key][start] * squared_gaps(x, c).min(1)
    return pd.DataFrame({"start": start, "image_idx": rows["image_idx"][took], "x": rows["x"][took]})


def _sums(key: tuple, rows: pd.DataFrame, x: np.ndarray, c: np.ndarray, start: int) -> pd.DataFrame:
    gaps = squared_gaps(x, c)
    label = gaps.argmin(1)
    out = []
    for k in np.unique(label):
        own = label == k
        out.append((start, int(k), int(own.sum()), np.rint(x[own] * UNIT).astype(np.int64).sum(0).tolist(), int(np.rint(gaps[own, k] * UNIT).sum())))
    return pd.DataFrame(out, columns=["start", "cluster", "n", "total", "cost"])


def _labels(key: tuple, rows: pd.DataFrame, x: np.ndarray, c: np.ndarray, start: int) -> pd.DataFrame:
    gaps = squared_gaps(x, c)
    return pd.DataFrame({"image_idx": rows["image_idx"].to_numpy(), "label": gaps.argmin(1), "gap": gaps.min(1)})


def plus_plus(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted vectors, each drawn by its squared distance to those before; all of them where they are fewer."""
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    while len(chosen) < min(k, len(x)):
        p = weight.astype(float) if not chosen else weight * squared_gaps(x, x[chosen]).min(1)
        p[chosen] = 0
        if p.sum() <= 0:
            p = np.where(np.isin(np.arange(len(x)), chosen), 0.0, 1.0)
        chosen.append(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(x) - 1)))
    return x[chosen]


def _uniform(seed: int, start: int, stage: int) -> Column:
    return F.conv(F.substring(draw_key(f"{seed}:{start}:{stage}", "image_idx"), 1, 8), 16, 10).cast("double") / 2**32


def kmeans(points: DataFrame, by: list[str], k: int, seed: int, starts: int = STARTS) -> DataFrame:
    """(by.., image_idx, label, gap) of points (by.., image_idx, x): the nearest of k centres and the squared distance to it, for the best of the starts."""
    own = StructType([points.schema[c] for c in by])
    schema = lambda *extra: StructType([*own.fields, *extra])
    long = lambda name: StructField(name, LongType())
    x = points.schema["x"]

    def gather(fn, centres: Centres, *extra: StructField, u: Column | None = None) -> DataFrame:
        rows = points if u is None else points.withColumn("u", u)
        return rows.mapInPandas(_by_pool(by, centres, fn), schema(long("start"), *extra))

    at = len(by)
    first: Centres = {}
    for start in range(starts):
        order = F.struct(draw_key(f"{seed}:{start}", "image_idx").alias("key"), "image_idx", "x")
        for row in points.groupBy(*by).agg(F.min(order).alias("best")).collect():  # a row for each pool
            first.setdefault(tuple(row[:at]), []).append(np.array([row["best"]["x"]]))
    centres = first
    for stage in range(SEED_ROUNDS):
        chances: dict[tuple, list[float]] = {key: [0.0] * starts for key in centres}
        for row in gather(_cost, centres, long("cost")).groupBy(*by, "start").agg(F.sum("cost").alias("cost")).collect():
            if row["cost"]:
                chances[tuple(row[:at])][row["start"]] = OVERSAMPLING * k * UNIT / row["cost"]
        u = F.array(*(_uniform(seed, s, stage) for s in range(starts)))
        more: dict[tuple, dict[int, list]] = {}
        for row in gather(partial(_drawn, chances), centres, long("image_idx"), x, u=u).orderBy(*by, "start", "image_idx").collect():
            more.setdefault(tuple(row[:at]), {}).setdefault(row["start"], []).append(row["x"])
        centres = {key: [np.vstack([c, *([more[key][s]] if s in more.get(key, {}) else [])]) for s, c in enumerate(v)] for key, v in centres.items()}

    def summed(c: Centres) -> dict[tuple, dict[int, dict[int, tuple]]]:
        dims = {len(v[0][0]) for v in c.values()}.pop()
        parts = gather(_sums, c, long("cluster"), long("n"), StructField("total", ArrayType(LongType())), long("cost"))
        total = F.array(*(F.sum(F.get("total", d)) for d in range(dims)))
        out: dict[tuple, dict[int, dict[int, tuple]]] = {}
        for row in parts.groupBy(*by, "start", "cluster").agg(F.sum("n").alias("n"), total.alias("total"), F.sum("cost").alias("cost")).collect():  # a row for each centre
            out.setdefault(tuple(row[:at]), {}).setdefault(row["start"], {})[row["cluster"]] = (row["n"], np.array(row["total"], float) / UNIT / row["n"], row["cost"])
        return out

    if not centres:
        return points.select(*by, "image_idx", F.lit(0).cast("long").alias("label"), F.lit(0.0).alias("gap"))
    weights = summed(centres)
    centres = {key: [plus_plus(c, np.array([weights[key][s].get(j, (0,))[0] for j in range(len(c))]), k, seed + s) for s, c in enumerate(v)] for key, v in centres.items()}
    for _ in range(ROUNDS):
        found = summed(centres)
        cost = {key: [sum(t[2] for t in found[key][s].values()) for s in range(starts)] for key in centres}
        moved = {key: [np.array([found[key][s][j][1] if j in found[key][s] else c[j] for j in range(len(c))]) for s, c in enumerate(v)] for key, v in centres.items()}
        still = all(np.abs(a - b).max() <= 1e-8 for key in centres for a, b in zip(centres[key], moved[key], strict=True))
        if still:
            break
        centres = moved
    best = {key: [v[min(range(starts), key=lambda s: (cost[key][s], s))]] for key, v in centres.items()}
    out = schema(long("image_idx"), long("label"), StructField("gap", DoubleType()))
    return points.mapInPandas(_by_pool(by, best, _labels), out)
