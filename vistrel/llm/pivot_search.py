"""Exact top-k search by inner product with pivot-table elimination.

Each vector's distances to some pivots are kept beside it (the pivot table). For a query q, a candidate x and each pivot p,
|d(q, p) - d(x, p)| is at most d(q, x); the greatest of these bounds d(q, x) from below, and with the lengths of both, which are
known, bounds their inner product from above. Candidates are evaluated in the order of that bound, best first, until it is below
the k-th score found: no later candidate can enter, so the result is exact.

Vectors lie in blocks of about BLOCK_ROWS, by nearest pivot and, within it, by hash; a pivot near a third of all rows
just has more blocks. A query first searches its own block, which gives it a k-th score to beat; then it goes to those blocks whose
bound (from the least and greatest distances to each pivot in the block) reaches that score. A block is copied once for each QUERY_ROWS of
the queries that come to it, so a task holds one block and a bounded number of queries. In many dimensions distances are much
alike and bounds prune little: a query may visit every block; no result depends on that.

The components are floor(scale * x), x as double. Vectors that are null or hold a null or non-finite component take no part; shorter ones
count as filled up with zeros, an empty one as zeros alone. Rows are told apart by themselves, not by id: copies of a row and rows that
repeat its id are candidates of it, and each such query row has its own result. Rows without an id are no queries; as candidates they come last among
equal scores. Scores past 64 bits stop at the ends of a long. Other columns play no part. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.llm.common import bounded_batches, materialise

#: Pivots, drawn from a sample of at most so many rows (which choose pivots only and change no result).
PIVOTS, SAMPLE_ROWS = 32, 4096
#: Rows of a block, queries that meet a block in one task, and queries and summaries of blocks that meet at a time.
BLOCK_ROWS, QUERY_ROWS, ASKING_ROWS, SUMMARY_ROWS = 2048, 1024, 256, 4096
#: Candidates evaluated between two looks at the bound, and squared lengths up to which products of doubles are exact.
STEP, ORDINARY = 256, 2.0**50
#: The cell of vectors too long for that; they are compared in whole numbers and without bounds.
LONG_CELL = -1
_MOST = 2**63 - 1


def _unpacked(column, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of packed numbers as a matrix of ``width`` columns, filled up with zeros."""
    out = np.zeros((len(column), width), kind)
    for n, v in enumerate(column):
        row = np.frombuffer(v, kind)
        out[n, : len(row)] = row
    return out


def _prepared(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, asks, packed, named, size = [], [], [], [], [], []
            for r, i, q, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if v is None or None in v:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(x).all():
                    rows.append(r), ids.append(i or 0), asks.append(bool(q)), packed.append(x.tobytes()), named.append(i is not None), size.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(asks, pa.bool_()), pa.array(packed, pa.binary()), pa.array(named, pa.bool_()), pa.array(size, pa.int32())], names=["row", "id", "asks", "v", "named", "size"])

    return run


def _pivots(vectors: DataFrame, width: int, count: int, sample: int) -> np.ndarray:
    """Distinct vectors drawn by hash of their rows."""
    drawn = vectors.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(sample).collect()
    x = _unpacked([r["v"] for r in drawn], width)
    x = x[(x**2).sum(1) <= ORDINARY]
    _, first = np.unique(x, axis=0, return_index=True)
    return x[np.sort(first)[:count]]


def _tabled(pivots: np.ndarray, width: int):
    """Adds distances to the pivots, squared length and cell."""
    own = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpacked(b.column(3).to_pylist(), width)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = (x**2).sum(1)
                far = ~(norm <= ORDINARY)
                x[far] = 0
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + own - 2 * x @ pivots.T, 0)).astype(np.float32)
            cell = d.argmin(1) if d.shape[1] else np.zeros(len(x), int)
            norm[far], cell[far] = np.inf, LONG_CELL
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(5)), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(norm), pa.array(cell, pa.int32())], names=["row", "id", "asks", "v", "named", "d", "norm", "cell"]
            )

    return run


_TABLED = "row long, id long, asks boolean, v binary, named boolean, d binary, norm double, cell int"


def _bound(norm: np.ndarray, norms: np.ndarray, apart: np.ndarray, d: np.ndarray, ds: np.ndarray) -> np.ndarray:
    """Inner products are at most this; ``apart`` may be off by the single precision of the distances d and ds that it comes from."""
    total = norm[:, None] + norms[None, :]
    slack = 2e-7 * (d.max(1, initial=0).astype(np.float64)[:, None] + ds.max(initial=0))
    return (total - np.maximum(apart - slack, 0) ** 2) / 2 * (1 + 1e-12) + 0.5


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest difference of distances to a pivot, for each row of a and b."""
    out, diff = np.zeros((len(a), len(b)), np.float32), np.empty((len(a), len(b)), np.float32)
    for p in range(a.shape[1]):
        np.subtract(a[:, p, None], b[None, :, p], out=diff)
        np.abs(diff, out=diff)
        np.maximum(out, diff, out=out)
    return out


class _Block:
    """Candidates in the order of their ids, with their part of the pivot table."""

    def __init__(self, frame: pd.DataFrame, width: int):
        frame = frame.sort_values(["named", "id"], ascending=[False, True], ignore_index=True)
        self.rows, self.ids = frame["row"].to_numpy(), [i if named else None for i, named in zip(frame["id"].to_list(), frame["named"], strict=True)]
        self.x, self.norm = _unpacked(frame["v"], width), frame["norm"].to_numpy(np.float64)
        self.d = _unpacked(frame["d"], len(frame["d"].iloc[0]) // 4, np.float32)

    def search(self, q: np.ndarray, row: int, k: int, bound: np.ndarray, least: float) -> list[tuple]:
        """(score, place) of the k best candidates whose score is ``least`` or more, in bound order until no other can enter."""
        order = np.flatnonzero((bound >= least) & (self.rows != row))
        order = order[np.argsort(-bound[order], kind="stable")]
        best_s, best_p = np.zeros(0), np.zeros(0, int)
        for at in range(0, len(order), STEP):
            if len(best_s) == k and bound[order[at]] < best_s[-1]:
                break
            some = order[at : at + STEP]
            s, p = np.concatenate([best_s, self.x[some] @ q]), np.concatenate([best_p, some])
            top = np.lexsort((p, -s))[:k]
            best_s, best_p = s[top], p[top]
        return [(int(s), p) for s, p in zip(best_s, best_p, strict=True) if s >= least]

    def search_long(self, q: np.ndarray, row: int, k: int) -> list[tuple]:
        """The same over all candidates in whole numbers of any length."""
        whole = [int(c) for c in q]
        scores = [max(-_MOST - 1, min(_MOST, sum(int(a) * b for a, b in zip(x, whole, strict=True)))) for x in self.x]
        return sorted(((s, p) for p, s in enumerate(scores) if self.rows[p] != row), key=lambda h: (-h[0], h[1]))[:k]


_HITS = "row long, query_id long, vec_id long, score long"


def _hits(block: _Block, queries: pd.DataFrame, width: int, k: int, least: np.ndarray) -> pd.DataFrame:
    out, x, norm = [], _unpacked(queries["v"], width), queries["norm"].to_numpy(np.float64)
    d = _unpacked(queries["d"], block.d.shape[1], np.float32)
    plain = bool(np.isfinite(block.norm).all())
    for at in range(0, len(x), 64):
        part = slice(at, at + 64)
        bounds = _bound(norm[part], block.norm, _apart(d[part], block.d), d[part], block.d)
        for n, bound in enumerate(bounds, at):
            row, i = int(queries["row"].iloc[n]), int(queries["id"].iloc[n])
            ordinary = plain and math.isfinite(norm[n])
            hits = block.search(x[n], row, k, bound, least[n]) if ordinary else block.search_long(x[n], row, k)
            out += [(row, i, block.ids[p], s) for s, p in hits]
    names = ["row", "query_id", "vec_id", "score"]
    return pd.DataFrame({c: pd.array([h[n] for h in out], "Int64") for n, c in enumerate(names)})


def top_k(vectors: DataFrame, asks: Column, k: int, scale: float = 1.0, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k other rows of greatest inner product with each row for which ``asks`` holds; ties go to the smaller id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), (asks & F.col(id).isNotNull()).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    plain = materialise(given.mapInArrow(_prepared(scale), "row long, id long, asks boolean, v binary, named boolean, size int"), "pivot-vectors")
    width = plain.agg(F.max("size")).first()[0] or 0
    table = materialise(plain.drop("size").mapInArrow(_tabled(_pivots(plain, width, pivots, SAMPLE_ROWS), width), _TABLED), "pivot-table")
    counts = table.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block_rows))  # a row for each pivot
    table = table.join(F.broadcast(counts.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts")

    def home(frame: pd.DataFrame) -> pd.DataFrame:
        """The summary of a block (row is null) and what its own queries find in it."""
        block, queries = _Block(frame, width), frame[frame["asks"]]
        hits = _hits(block, queries, width, k, np.full(len(queries), -np.inf))
        lo, hi = block.d.min(0).tobytes(), block.d.max(0).tobytes()
        none, numbers = pd.array([None], "Int64"), ["row", "query_id", "vec_id", "score"]
        own = pd.DataFrame({c: none for c in numbers} | {"lo": [lo], "hi": [hi], "norm": [block.norm.max()]})
        both = pd.concat([own, hits.astype({c: "Int64" for c in numbers})]) if len(hits) else own
        both = both.assign(cell=frame["cell"].iloc[0], part=frame["part"].iloc[0])
        return both[["cell", "part", "row", "query_id", "vec_id", "score", "lo", "hi", "norm"]]

    first = materialise(table.groupBy("cell", "part").applyInPandas(home, f"cell int, part long, {_HITS}, lo binary, hi binary, norm double"), "pivot-home")
    found = first.where("row is not null").select("row", "query_id", "vec_id", "score")
    beaten = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("row", F.col("least").cast("double").alias("least"))
    queries = materialise(table.where("asks").join(beaten, "row", "left"), "pivot-queries")
    summaries = first.where("row is null").select("cell", "part", "lo", "hi", "norm")

    parts = max(1, -(-queries.count() // ASKING_ROWS))
    chunks = max(1, -(-summaries.count() // SUMMARY_ROWS))

    def reached(some: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The blocks in which a query may find a score that enters, but its own."""
        if not len(some) or not len(blocks):
            return pd.DataFrame({"row": [], "cell": [], "part": []})
        n = len(some["d"].iloc[0]) // 4
        d, lo, hi = (_unpacked(c, n, np.float32) for c in (some["d"], blocks["lo"], blocks["hi"]))
        cells, places = blocks["cell"].to_numpy(), blocks["part"].to_numpy()
        norm, norms, least = some["norm"].to_numpy(float), blocks["norm"].to_numpy(float), some["least"].fillna(-np.inf).to_numpy(float)
        least, out = np.where(np.isfinite(norm), least, -np.inf), []
        for at in range(0, len(d), 256):
            part = slice(at, at + 256)
            apart = np.zeros((len(d[part]), len(lo)), np.float32)
            for p in range(n):
                x = d[part, p, None]
                apart = np.maximum(apart, np.maximum(lo[None, :, p] - x, x - hi[None, :, p]))
            near = _bound(norm[part], norms, apart, d[part], hi) >= least[part, None]
            near &= (some["cell"].to_numpy()[part, None] != cells) | (some["part"].to_numpy()[part, None] != places)
            a, b = np.nonzero(near)
            out.append(pd.DataFrame({"row": some["row"].to_numpy()[part][a], "cell": cells[b], "part": places[b]}))
        return pd.concat(out)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, *key: str) -> DataFrame:
        # numbers have one type on both sides: a long and an int of one value hash to different partitions
        return df.withColumn(own, F.pmod(F.xxhash64(*key), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    asking = dealt(queries.select("row", "d", "norm", "least", "cell", "part"), "_q", parts, "_b", chunks, "row")
    blocks = dealt(summaries, "_b", chunks, "_q", parts, "cell", "part")
    pairs = materialise(asking.groupBy("_q", "_b").cogroup(blocks.groupBy("_q", "_b")).applyInPandas(reached, "row long, cell int, part long"), "pivot-pairs")

    comers = pairs.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("_lots"))
    visits = pairs.join(comers, ["cell", "part"]).withColumn("_lot", F.pmod(F.xxhash64("row"), "_lots")).drop("_lots")
    visits = visits.join(queries.select("row", "id", "v", "d", "norm", "least"), "row")
    copies = table.join(comers, ["cell", "part"]).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1))).drop("_lots")

    def visit(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(block):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        least = np.where(np.isfinite(some["norm"].to_numpy(float)), some["least"].fillna(-np.inf).to_numpy(float), -np.inf)
        return _hits(_Block(block, width), some, width, k, least)

    keys = ["cell", "part", "_lot"]
    later = copies.groupBy(*keys).cogroup(visits.toDF(*visits.columns).groupBy(*keys)).applyInPandas(visit, _HITS)
    best = W.Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.unionByName(later).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
