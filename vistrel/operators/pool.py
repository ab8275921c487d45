"""Label-free statistics of an image pool, from block scans; the pool's schema has no identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.functions.vector import dot, vector_std_mean
from vistrel.operators.blocks import DIGITS, block_scan, matrix, nearest

#: Neighbours that typicality looks at, least distance that counts, and the quantile of the duplicate threshold.
NEIGHBOURS, LEAST_DISTANCE, DUP_QUANTILE = 20, 1e-4, 0.99
#: Selected images whose properties are computed at most; a selection is an annotation budget.
MOST_SELECTED = 1000


def pool_statistics(pool: DataFrame, has_cameras: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., image_idx, nn_sim, typicality, pairability, best_idx) of each image (in its pool, the columns ``by``).

    nn_sim and typicality look at all other images, pairability and best_idx at those of other cameras only. An image
    without such a partner has nulls there.
    """
    return typicality(pool, by).join(best_matches(pool, has_cameras, by), [*by, "image_idx"], "left")


def typicality(pool: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., image_idx, nn_sim, typicality): the greatest similarity, and one over the mean distance of the nearest images."""
    near = nearest(pool, pool, NEIGHBOURS, same_set=True, similarity=True, by=by).withColumnRenamed("a_idx", "image_idx")
    mean = F.avg(F.greatest(1 - F.col("value"), F.lit(LEAST_DISTANCE)))
    return near.groupBy(*by, "image_idx").agg(F.max("value").alias("nn_sim"), F.round(1 / mean, DIGITS).alias("typicality"))


def best_matches(pool: DataFrame, has_cameras: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., image_idx, pairability, best_idx): the most similar image, of another camera where there are cameras."""
    best = nearest(pool, pool, 1, differs="camid" if has_cameras else None, same_set=True, similarity=True, by=by)
    return best.select(*by, F.col("a_idx").alias("image_idx"), F.col("value").alias("pairability"), F.col("b_idx").alias("best_idx"))


def mutual_partners(statistics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., image_idx, partner_idx): images that are each other's best match."""
    back = statistics.select(*by, F.col("image_idx").alias("best_idx"), F.col("best_idx").alias("back"))
    found = statistics.join(back, [*by, "best_idx"])
    return found.where("back = image_idx").select(*by, "image_idx", F.col("best_idx").alias("partner_idx"))


#: Bins of a similarity from -1 to 1: the digits that similarities are rounded to, so a bin is a value.
_SCALE = 10**DIGITS


#: Span of values up to which they are counted in an array, without being sorted.
_SPAN = 2**22


def _tally(value: np.ndarray, n: np.ndarray | None = None) -> pd.DataFrame:
    """How often each value occurs, or the sum of its n, which is below 2^53."""
    if len(value) and (low := int(value.min())) + _SPAN > int(value.max()):
        counts = np.bincount(value - low, n)
        found = np.flatnonzero(counts)
        return pd.DataFrame({"value": found + low, "n": counts[found].astype(np.int64)})
    if n is None:
        value, n = np.unique(value, return_counts=True)
    return pd.DataFrame({"value": value, "n": n}).groupby("value", as_index=False)["n"].sum()


def _histogram(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    s = matrix(x["feat"]) @ matrix(y["feat"]).T
    upper = x["image_idx"].to_numpy()[:, None] < y["image_idx"].to_numpy()[None, :]
    return _tally(np.round(s[upper] * _SCALE).astype(np.int64))


def dup_threshold(pool: DataFrame, quantile: float = DUP_QUANTILE, by: tuple[str, ...] = (), digits: int = DIGITS) -> DataFrame:
    """A row (for each pool): the similarity below which the given share of all unordered pairs lies, interpolated linearly.

    Exact for any pool: blocks count rounded similarities, of which there are at most two million.
    """
    side = pool.select(*by, "image_idx", "feat")
    add = lambda found: _tally(found["value"].to_numpy(), found["n"].to_numpy())
    counts = block_scan(side, side, _histogram, "value long, n long", by=by, fold=add, whole=True).groupBy(*by, "value").agg(F.sum("n").alias("n"))
    return counts.groupBy(*by).agg(F.round(F.percentile(F.col("value") / F.lit(float(_SCALE)), F.lit(quantile), F.col("n")), digits).alias("dup_tau"))


def selection_properties(pool: DataFrame, selected: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row about the selected images (column image_idx, some tens of rows): cameras, diversity, greatest similarity, mean typicality and pairability, style spread."""
    s = pool.join(selected.select("image_idx"), "image_idx")
    dims = len(pool.select("feat").head()[0])
    single = s.join(statistics, "image_idx").agg(
        F.countDistinct("camid").alias("n_cams"),
        F.round(F.avg("typicality"), 5).alias("typicality"),
        F.round(F.avg("pairability"), 5).alias("pairability"),
        F.round(vector_std_mean(F.col("feat"), dims), DIGITS).alias("style_spread"),
    )
    if selected.limit(MOST_SELECTED + 1).count() > MOST_SELECTED:
        raise ValueError(f"more than {MOST_SELECTED} selected images")
    every = F.array_sort(F.collect_list(F.struct("image_idx", "feat")))  # MOST_SELECTED vectors
    one = s.agg(every.alias("v")).select("v", F.explode(F.sequence(F.lit(0), F.greatest(F.size("v") - 1, F.lit(0)))).alias("i"))
    sims = one.select(F.explode(F.transform(F.slice("v", F.col("i") + 2, F.size("v")), lambda x: dot(F.get("v", F.col("i"))["feat"], x["feat"]))).alias("sim"))
    pairs = sims.agg(F.round(1 - F.avg("sim"), DIGITS).alias("diversity"), F.round(F.max("sim"), DIGITS).alias("max_sim"))
    return single.withColumn("one", F.lit(1)).join(pairs.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def group_cosine(vectors: DataFrame, group: str) -> DataFrame:
    """One row: mean cosine of pairs within a group and across groups, from sums of unit vectors.

    The sum over all pairs of a set is (|sum of vectors|^2 - n) / 2, so no pair is formed.
    """
    n_dims = len(vectors.select("feat").head()[0])
    parts = vectors.groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("feat", k)) for k in range(n_dims))).alias("s"), F.sum(dot(F.col("feat"), F.col("feat"))).alias("sq"))
    within = parts.agg(
        F.sum((dot(F.col("s"), F.col("s")) - F.col("sq")) / 2).alias("w"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wn"),
        F.sum("n").alias("n"),
        F.sum("sq").alias("sq"),
        F.array(*(F.sum(F.get("s", k)) for k in range(n_dims))).alias("s"),
    )
    everything = (dot(F.col("s"), F.col("s")) - F.col("sq")) / 2
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return within.select(F.round(F.col("w") / F.col("wn"), DIGITS).alias("within"), F.round((everything - F.col("w")) / (pairs - F.col("wn")), DIGITS).alias("across"))


def zscore(df: DataFrame, column: str, dims: int, eps: float = 1e-6) -> DataFrame:
    """The vector column with each dimension centred and divided by its population standard deviation plus eps."""
    stats = df.agg(F.array(*(F.avg(F.get(column, k)) for k in range(dims))).alias("_mean"), F.array(*(F.stddev_pop(F.get(column, k)) for k in range(dims))).alias("_std")).first()
    mean, std = (F.array(*map(F.lit, stats[k])) for k in ("_mean", "_std"))  # a value per dimension
    return df.withColumn(column, F.zip_with(F.zip_with(F.slice(column, 1, dims), mean, lambda x, m: x - m), std, lambda x, s: x / (s + eps)))
