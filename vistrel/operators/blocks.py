"""Block scans: every row of one side meets every row of the other, as matrix products of bounded blocks.

A plain join would write each pair; here a block pair is a grid of products of bounded tiles, and only what the caller's function
makes of them leaves the block. A side is copied once for each block of the other, so blocks grow with the side: copies are GRID
at most until blocks have MOST_ROWS. Tiles and blocks bound memory, the grid spreads the work evenly, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rows of a tile on either side, and of a block at least and at most; blocks that a side is cut into before they grow.
TILE_ROWS, BLOCK_ROWS, MOST_ROWS, GRID = 2048, 2048, 32768, 8
#: Digits that distances and similarities are rounded to before they are ordered.
DIGITS = 6


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def block_scan(
    left: DataFrame,
    right: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int | None = None,
    key: str = "image_idx",
    by: tuple[str, ...] = (),
    fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    largest: tuple[int, int] | None = None,
    whole: bool = False,
) -> DataFrame:
    """fn over each pair of a left and a right tile; both sides have the column ``key``. With ``by`` only rows that agree in these
    columns meet, which the result begins with. ``fold`` makes one result of those of a left tile within a block, or with ``whole``
    of all of a block's. ``largest`` gives the rows of the largest left and right group, where they are known."""

    def blocks(df: DataFrame, known: int | None) -> int:
        most = known if known is not None else df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        rows = block_rows or min(MOST_ROWS, max(BLOCK_ROWS, -(-most // GRID)))
        return max(1, -(-most // rows))

    n_left, n_right = (blocks(df, n) for df, n in zip((left, right), largest or (None, None), strict=True))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        fresh = df.toDF(*df.columns)  # both sides may come from one table, whose columns would then be ambiguous
        # block numbers have one type on both sides: a long and an int of one value hash to different partitions
        return fresh.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    a, b = dealt(left, "_i", n_left, "_j", n_right), dealt(right, "_j", n_right, "_i", n_left)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        x, y = x.sort_values(key, ignore_index=True), y.sort_values(key, ignore_index=True)
        parts = []
        for i in range(0, len(x), TILE_ROWS):
            tile = x[i : i + TILE_ROWS].reset_index(drop=True)
            found = [fn(tile, y[j : j + TILE_ROWS].reset_index(drop=True)) for j in range(0, len(y), TILE_ROWS)]
            parts.append(fold(pd.concat(found, ignore_index=True)) if fold and len(found) > 1 else pd.concat(found, ignore_index=True))
            if whole and fold and len(parts) > 1:
                parts = [fold(pd.concat(parts, ignore_index=True))]
        out = pd.concat(parts, ignore_index=True)
        for n, c in enumerate(by):
            out.insert(n, c, x[c].iloc[0])
        return out

    kinds = dict(left.dtypes)
    return a.groupBy(*by, "_i", "_j").cogroup(b.groupBy(*by, "_i", "_j")).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), schema]))


def nearest(left: DataFrame, right: DataFrame, k: int, differs: str | None = None, same_set: bool = False, similarity: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., a_idx, b_idx, value, rn): the k right rows of least cosine distance, or greatest similarity, for each left row.

    ``differs`` names a column that must differ; ``same_set`` leaves out a row itself. Ties go to the smaller index. With ``by`` only
    rows that agree in these columns are neighbours.
    """
    columns = [*by, "image_idx", "feat", *([differs] if differs else [])]

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = np.round(matrix(x["feat"]) @ matrix(y["feat"]).T, DIGITS)
        d = -d if similarity else np.round(1 - d, DIGITS)
        if differs:
            d[x[differs].to_numpy()[:, None] == y[differs].to_numpy()[None, :]] = np.inf
        if same_set:
            d[x["image_idx"].to_numpy()[:, None] == y["image_idx"].to_numpy()[None, :]] = np.inf
        if k == 1:  # no need to sort
            d[np.isnan(d)] = np.inf
        near = d.argmin(1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(x)), near.shape[1])
        out = pd.DataFrame({"a_idx": x["image_idx"].to_numpy()[rows], "b_idx": y["image_idx"].to_numpy()[near.ravel()], "value": np.take_along_axis(d, near, 1).ravel()})
        return out[np.isfinite(out["value"])]

    def least(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["a_idx", "value", "b_idx"]).groupby("a_idx").head(k)

    part = block_scan(left.select(columns), right.select(columns), block, "a_idx long, b_idx long, value double", by=by, fold=least)
    best = W.Window.partitionBy(*by, "a_idx").orderBy("value", "b_idx")
    ranked = part.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    return ranked.withColumn("value", -F.col("value") if similarity else F.col("value"))
