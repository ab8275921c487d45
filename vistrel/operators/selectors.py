"""Budgeted, label-free selection of images from pools of any size.

A rule (of nine) is written once, as a dialogue: it asks for the first rows by some order among those that nothing chosen rules out, takes
some of the rows that come back and asks again. All pools and rules go on together, a Spark job a round: tasks get the rows
chosen so far (pools x k vectors), compute the order of their own rows from them and send the first ones, of which each pool's
first reach the driver. Facility location, whose order needs all rows for each, meets them in blocks, bounds all gains and adds up those
in question in whole numbers. No state is kept in the tasks, so a lost executor costs its part of a round. Pools whose size is bounded, as training
batches are, take the same rules as a grouped function (select_within).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.functions.draw import draw_key
from vistrel.operators.blocks import DIGITS, block_scan, matrix
from vistrel.operators.clusters import kmeans
from vistrel.operators.identity import numbered, numbered_within
from vistrel.operators.pool import DUP_QUANTILE, LEAST_DISTANCE, NEIGHBOURS, best_matches, dup_threshold, mutual_partners, typicality
from vistrel.session import written

#: Rows of an order that a rule looks at together, and pools that go on together.
LOOK, LOT = 256, 32
#: What a camera not seen yet adds to a normalised gain.
CAMERA_BONUS = 0.5
#: Similarities are whole multiples of one over this.
UNIT = 10**DIGITS


def round_robin(pool: DataFrame, seed: int) -> DataFrame:
    """(pos, image_idx): one drawn image of each camera in turn, cameras in drawn order."""
    placed = _turns(pool.select("image_idx", "camid"), "camid", seed)
    return numbered(placed, "pos", F.col("_nth"), "_nth", "_turn").select((F.col("pos") + 1).alias("pos"), "image_idx")


def _turns(rows: DataFrame, camera: str, seed: int) -> DataFrame:
    """rows with ``_nth``, the drawn place within its camera, and ``_turn``, the draw of the camera; a camera is numbered by parts."""
    drawn = rows.withColumn("_draw", draw_key(seed, "image_idx"))
    placed = numbered_within(drawn, "_nth", camera, F.substring("_draw", 1, 3), "_draw", "image_idx")
    return placed.withColumn("_nth", F.col("_nth") + 1).withColumn("_turn", draw_key(seed, F.lit("cam"), F.col("camid")))


def micro(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded similarities in whole units."""
    return np.rint(a @ b.T * UNIT).astype(np.int64)


@dataclass
class Row:
    """A row that a rule has asked for. ``kind`` is 1 for a camera seen before, ``num`` its number in the order."""

    image_idx: int
    camid: int
    partner: int
    feat: np.ndarray
    num: float
    kind: int


@dataclass
class Ask:
    """The first ``n`` rows by an order, ties by image number. ``skip``: "taken" rows only, or also "barred" ones."""

    order: str
    n: int = 1
    num: str | None = None
    text: str | None = None
    skip: str = "barred"
    cluster: tuple[str, int] | None = None
    kinds: bool = False


@dataclass
class State:
    """What a rule has chosen from a pool of ``size`` rows. ``tau``: similarity in units above which two rows are probable copies."""

    k: int
    size: int
    tau: int
    has_cameras: bool
    evaluated: np.ndarray | None = None
    rows: list[Row] = field(default_factory=list)
    covered: np.ndarray | None = None

    @property
    def full(self) -> bool:
        return len(self.rows) >= min(self.k, self.size)

    @property
    def taken(self) -> list[int]:
        return [r.image_idx for r in self.rows]

    def bars(self, row: Row) -> bool:
        """Whether a chosen row rules it out as a probable copy of a person."""
        if row.image_idx in self.taken or any(r.partner == row.image_idx for r in self.rows):
            return True
        return bool(self.rows) and int(micro(row.feat[None], np.stack([r.feat for r in self.rows])).max()) > self.tau

    def take(self, row: Row) -> None:
        self.rows.append(row)
        if self.evaluated is not None:
            new = np.clip(micro(row.feat[None], self.evaluated)[0], 0, None)
            self.covered = new if self.covered is None else np.maximum(self.covered, new)


@dataclass
class Known:
    """The part of a state that tasks need to answer."""

    taken: np.ndarray
    partners: np.ndarray
    feats: np.ndarray | None
    cameras: np.ndarray
    tau: int
    covered: np.ndarray | None

    @staticmethod
    def of(state: State, ask: Ask) -> Known:
        feats = np.stack([r.feat for r in state.rows]) if state.rows else None
        number = lambda values: np.array(list(values), np.int64)
        covered = state.covered if ask.order == "cover" else None
        return Known(number(state.taken), number(r.partner for r in state.rows if r.partner is not None), feats, number(r.camid for r in state.rows), state.tau, covered)

    def left_out(self, idx: np.ndarray, sims: np.ndarray | None, skip: str) -> np.ndarray:
        """Which rows, of these similarities to the chosen ones, are taken or, where asked, ruled out."""
        out = np.isin(idx, self.taken)
        if skip == "barred" and sims is not None:
            out |= np.isin(idx, self.partners) | (sims.max(1) > self.tau)
        return out


def answer(rows: pd.DataFrame, x: np.ndarray, known: Known, ask: Ask, evaluated: np.ndarray | None) -> pd.DataFrame:
    """The first rows of these that the rule asks for, with ``num``, ``text`` and ``kind``."""
    idx = rows["image_idx"].to_numpy()
    sims = None if known.feats is None else micro(x, known.feats)
    out = known.left_out(idx, sims, ask.skip)
    if ask.cluster:
        out |= rows[ask.cluster[0]].to_numpy() != ask.cluster[1]
    num, kind = np.zeros(len(idx)), np.zeros(len(idx), int)
    if ask.order == "column" and ask.num:
        num = rows[ask.num].to_numpy(float)
    elif ask.order == "farthest":
        num = sims.max(1).astype(float)
    elif ask.order == "alike":
        num = -sims[:, -1].astype(float)
        out |= sims[:, -1] > known.tau
    elif ask.order == "cover":
        out |= ~rows["_candidate"].to_numpy(bool)
        at = np.flatnonzero(~out)
        gains = np.clip(micro(x[at], evaluated), 0, None)
        num[at] = -(np.maximum(gains - known.covered, 0) if known.covered is not None else gains).sum(1)
    if ask.kinds:
        kind = np.isin(rows["camid"].to_numpy(), known.cameras).astype(int)
    left = rows[~out].assign(num=num[~out], text=rows[ask.text][~out] if ask.text else "", kind=kind[~out])
    return left.sort_values(["kind", "num", "text", "image_idx"]).groupby("kind").head(ask.n)[["image_idx", "camid", "_partner", "feat", "num", "text", "kind"]]


#: A rule asks and is sent rows; it ends when its state is as it wants it.
Rule = Callable[[State], Generator[Ask, list[Row], None]]


def _offer(s: State, num: str | None = None, text: str | None = "_draw") -> Generator[Ask, list[Row], None]:
    """Takes from an order what nothing chosen rules out, until full."""
    while not s.full:
        rows = yield Ask("column", LOOK, num, text)
        for row in rows:
            if not s.full and not s.bars(row):
                s.take(row)
        if len(rows) < LOOK:
            return


def _fill(s: State, num: str | None = None, text: str | None = "_draw") -> Generator[Ask, list[Row], None]:
    """What the budget still lacks, by an order, ruled out or not."""
    rows = None
    while not s.full and rows != []:
        rows = yield Ask("column", s.k - len(s.rows), num, text, skip="taken")
        for row in rows:
            s.take(row)


def _dedup(s: State) -> Generator[Ask, list[Row], None]:
    yield from _offer(s)
    yield from _fill(s)


def _pairable(s: State) -> Generator[Ask, list[Row], None]:
    yield from _offer(s, "_pair")
    yield from _fill(s, "_pair")


def _camera_balanced(s: State) -> Generator[Ask, list[Row], None]:
    if not s.has_cameras:
        return (yield from _dedup(s))
    yield from _offer(s, "_nth", "_turn")
    yield from _fill(s, "_nth", "_turn")


def _kcenter(s: State) -> Generator[Ask, list[Row], None]:
    rows = None
    while not s.full and rows != []:
        rows = yield Ask("farthest", skip="taken") if s.rows else Ask("column", text="_draw")
        for row in rows:
            s.take(row)


def _hard_negative(s: State) -> Generator[Ask, list[Row], None]:
    """Drawn rows, each followed by the row most like it that is probably someone else."""
    while not s.full:
        if not (anchor := (yield Ask("column", text="_draw"))):
            break
        s.take(anchor[0])
        if not s.full:
            for row in (yield Ask("alike")):
                s.take(row)
    yield from _fill(s, text="_fill")


def _facility(bonus: float) -> Rule:
    """Greedy cover of the evaluated rows. The best candidate of a camera already seen competes with the best of a new one, whose gain,
    as a share of the greater of the two, is raised by the bonus."""

    def rule(s: State) -> Generator[Ask, list[Row], None]:
        while not s.full:
            best = yield Ask("cover", kinds=bool(bonus) and s.has_cameras)
            if not best:
                break
            most = max(1.0, *(-r.num for r in best))
            s.take(min(best, key=lambda r: (r.num / most - (0 if r.kind else bonus), r.image_idx)))
        yield from _fill(s, text="_fill")

    return rule


def _typical(s: State) -> Generator[Ask, list[Row], None]:
    """The densest row of each cluster, and then the densest of all."""
    for c in range(min(s.k, s.size)):
        for row in (yield Ask("column", num="_sparse", cluster=("_cluster", c))):
            s.take(row)
    yield from _fill(s, "_sparse", None)


def _style_cover(s: State) -> Generator[Ask, list[Row], None]:
    """The row nearest to the centre of each cluster of styles."""
    for c in range(min(s.k, s.size)):
        for row in (yield Ask("column", num="_look_gap", cluster=("_look", c))):
            s.take(row)
    yield from _fill(s)


#: Selectors by name.
SELECTORS: dict[str, Rule] = {
    "dedup": _dedup,
    "pairable": _pairable,
    "typical": _typical,
    "kcenter": _kcenter,
    "camera_balanced": _camera_balanced,
    "style_cover": _style_cover,
    "hard_negative": _hard_negative,
    "facility": _facility(0.0),
    "facility_camera": _facility(CAMERA_BONUS),
}
#: Those that rule out probable copies, and so need the pool's statistics.
_BARRING = set(SELECTORS) - {"kcenter"}
_COVERING = {"facility", "facility_camera"}


def check_names(names: Iterable[str]) -> None:
    if unknown := sorted(set(names) - set(SELECTORS)):
        raise ValueError(f"unknown selectors {', '.join(unknown)}; there are {', '.join(sorted(SELECTORS))}")


def _checked(pools: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    check_names(names)
    if "style_cover" in names and "style" not in pools.columns:
        raise ValueError("style_cover needs the column style")
    if "pid" in pools.columns:
        raise ValueError("selectors work without labels; drop pid from the pool")
    if "feat" not in pools.columns:
        raise ValueError("selectors need the column feat")
    return names


def _first_by(rows: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    place = F.row_number().over(W.Window.partitionBy(*by).orderBy(draw_key(key, "image_idx"), "image_idx"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def _table(pools: DataFrame, by: list[str], names: list[str], k: int, seed: int, has_cameras: bool, most: int, n_eval: int | None, n_cand: int | None) -> DataFrame:
    """The pools' rows with the columns that the rules order by."""
    rows = pools.select(*by, "image_idx", "camid", "feat", *(["style"] if "style_cover" in names else []))
    drawn = rows.withColumn("_fill", draw_key(f"{seed}:fill", "image_idx"))
    key = [*by, "image_idx"]
    if "camera_balanced" in names:
        camera = F.concat_ws("/", *(F.col(c).cast("string") for c in by), F.col("camid").cast("string"))
        drawn = _turns(drawn.withColumn("_camera", camera), "_camera", seed).drop("_camera")
    else:
        drawn = drawn.withColumn("_draw", draw_key(seed, "image_idx"))
    if _BARRING & set(names):
        known = written(best_matches(rows, has_cameras, tuple(by)), "pool-matches")
        partner = mutual_partners(known, tuple(by)).withColumnRenamed("partner_idx", "_partner")
        drawn = drawn.join(known.select(*key, (-F.col("pairability")).alias("_pair")), key, "left").join(partner, key, "left").fillna({"_pair": math.inf})
    else:
        drawn = drawn.withColumn("_partner", F.lit(None).cast("long"))
    if "typical" in names:
        drawn = drawn.join(typicality(rows, tuple(by)).select(*key, (-F.col("typicality")).alias("_sparse")), key, "left").fillna({"_sparse": -1.0})  # a pool of one row has no neighbours
        found = kmeans(rows.select(*key, F.col("feat").alias("x")), by, k, seed)
        drawn = drawn.join(found.select(*key, F.col("label").alias("_cluster")), key)
    if "style_cover" in names:
        found = kmeans(rows.select(*key, F.col("style").alias("x")), by, k, seed)
        drawn = drawn.join(found.select(*key, F.col("label").alias("_look"), F.round("gap", 9).alias("_look_gap")), key)
    for column, draw, n in (("_evaluated", "eval", n_eval), ("_candidate", "cand", n_cand)):
        if _COVERING & set(names) and n is not None and most > n:
            drawn = drawn.join(_first_by(rows.select(*key), by, f"{seed}:{draw}", n).withColumn(column, F.lit(True)), key, "left").fillna({column: False})
        else:
            drawn = drawn.withColumn(column, F.lit(True))
    return drawn.drop("style")


def select(
    pools: DataFrame, by: list[str], names: Iterable[str], k: int, seed: int, has_cameras: bool = True, n_eval: int | None = None, n_cand: int | None = None
) -> DataFrame:
    """(by.., selector, pos, image_idx): k images of each pool for each named selector. ``pools`` must not show identities.

    Facility location covers all rows of a pool and may pick any; ``n_eval`` and ``n_cand`` are for fewer, drawn ones.
    style_cover clusters the column ``style``, the vector of an image's appearance statistics, and needs it. The rounds run when
    this is called; the result are pools x selectors x k rows.
    """
    spark = pools.sparkSession
    names = _checked(pools, names)
    sizes = {tuple(r[: len(by)]): r["n"] for r in pools.groupBy(*by).agg(F.count("*").alias("n")).collect()}  # a row for each pool
    kinds = dict(pools.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "selector string", "pos long", "image_idx long"])
    keys, out = sorted(sizes, key=str), []
    for at in range(0, len(keys), LOT):
        some = keys[at : at + LOT]
        part = pools if len(keys) <= LOT else pools.join(F.broadcast(spark.createDataFrame(some, ", ".join(f"{c} {kinds[c]}" for c in by))), by)
        table = written(_table(part, by, names, k, seed, has_cameras, max(sizes[p] for p in some), n_eval, n_cand), "pool")
        states = _begun(table, by, names, k, has_cameras, {p: sizes[p] for p in some})
        _go_on(table, by, states)
        out += [(*pool, name, n, row.image_idx) for (pool, name), s in states.items() for n, row in enumerate(s.rows, 1)]
    return spark.createDataFrame(out, schema)


def _begun(table: DataFrame, by: list[str], names: list[str], k: int, has_cameras: bool, sizes: dict[tuple, int]) -> dict[tuple, State]:
    at = len(by)
    taus = {p: 0 for p in sizes}
    if _BARRING & set(names):
        taus |= {tuple(r[:at]): _units(r["dup_tau"]) for r in dup_threshold(table, by=tuple(by), digits=15).collect()}  # a row for each pool
    return {(p, name): State(k, n, taus[p], has_cameras) for p, n in sizes.items() for name in names}


def _units(tau: float) -> int:
    """A threshold that similarities in whole units can be held against."""
    return math.floor(tau * UNIT + 1e-6)


def _go_on(table: DataFrame, by: list[str], states: dict[tuple, State]) -> None:
    """Asks and answers in rounds until every rule has ended."""
    rules = {key: SELECTORS[key[1]](s) for key, s in states.items()}
    asks = {key: ask for key, rule in rules.items() if (ask := next(rule, None))}
    while asks:
        rows: dict[tuple, list] = {key: [] for key in asks}
        for of in (_covering, _ordered):
            some = {key: ask for key, ask in asks.items() if (ask.order == "cover") == (of is _covering)}
            best = of(table, by, {key: states[key] for key in some}, some).collect() if some else []  # LOOK rows at most for each pool and selector
            for r in sorted(best, key=lambda r: r["_n"]):
                rows[tuple(r[: len(by)]), r["selector"]].append(Row(r["image_idx"], r["camid"], r["_partner"], np.array(r["feat"]), r["num"], r["kind"]))
        asks = _next(rules, asks, rows)


def _sent(states: dict[tuple, State], asks: dict[tuple, Ask]) -> dict[tuple, list[tuple[str, Known, Ask]]]:
    """What the tasks get for each pool."""
    sent: dict[tuple, list] = {}
    for (pool, name), ask in asks.items():
        sent.setdefault(pool, []).append((name, Known.of(states[pool, name], ask), ask))
    return sent


def _ordered(table: DataFrame, by: list[str], states: dict[tuple, State], asks: dict[tuple, Ask]) -> DataFrame:
    """The first rows, numbered ``_n``, by orders that need no other rows than the chosen ones."""
    kinds, sent = dict(table.dtypes), _sent(states, asks)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "selector string, image_idx long, camid long, _partner long, feat array<double>, num double, text string, kind long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, rows in f.groupby(by, sort=False, dropna=False):
                x = matrix(rows["feat"])
                for name, known, ask in sent.get(key, ()):
                    found = answer(rows, x, known, ask, None)
                    if len(found):
                        yield found.assign(selector=name, **{c: rows[c].iloc[0] for c in by})[[*by, "selector", "image_idx", "camid", "_partner", "feat", "num", "text", "kind"]]

    first = W.Window.partitionBy(*by, "selector", "kind").orderBy("num", "text", "image_idx")
    return table.mapInPandas(run, schema).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(a.n for a in asks.values()))


#: Candidates of a tile whose rough gains are computed together, and the relative error of a single-precision operation.
ROUGH_ROWS, ROUGH = 256, 2.0**-24


def _rough_gains(a: np.ndarray, b: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from below and above of the whole-number gains of candidates a over rows b that are covered so far: computed in single
    precision, with the most that its errors (of vectors, products, cover and sums) and the rounding of similarities can come to."""
    flat = np.ascontiguousarray(np.hstack([b, -cover[:, None] / UNIT]).astype(np.float32).T)
    left, gain = np.hstack([a, np.ones((len(a), 1))]).astype(np.float32), np.empty(len(a))
    for at in range(0, len(a), ROUGH_ROWS):
        near = left[at : at + ROUGH_ROWS] @ flat
        gain[at : at + ROUGH_ROWS] = np.maximum(near, 0, out=near).sum(1)
    each = (a.shape[1] + 8) * ROUGH * (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max(initial=0) + cover.max(initial=0) / UNIT) + 0.51 / UNIT
    error = (each * len(b) + 64 * ROUGH * gain) * UNIT + 1
    low, high = np.maximum(gain * UNIT - error, 0), gain * UNIT + error
    known = np.isfinite(low) & np.isfinite(high)
    return np.where(known, low, 0.0), np.where(known, high, np.inf)


def _covering(table: DataFrame, by: list[str], states: dict[tuple, State], asks: dict[tuple, Ask]) -> DataFrame:
    """The first row by what a candidate adds to the cover: candidates meet evaluated rows in blocks, of which only sums are sent.

    Sums are bounded for all candidates in single precision; those whose upper bound reaches the greatest lower one are then computed as
    whole numbers, so that the answer is that of whole numbers for all.
    """
    sent, of, most = _sent(states, asks), ["selector", "kind", "image_idx"], max(s.size for s in states.values())

    def scan(single: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def gains(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            a, b, found = matrix(x["feat"]), matrix(y["feat"]), []
            near = None if single else np.rint(a @ b.T * UNIT)  # whole numbers, whose sums within a tile are exact
            for name, known, ask in sent.get(tuple(x[by].iloc[0]), ()):
                left = np.flatnonzero(~known.left_out(x["image_idx"].to_numpy(), None if known.feats is None else micro(a, known.feats), ask.skip))
                cover = np.zeros(len(b)) if known.feats is None else np.clip(micro(b, known.feats).max(1), 0, None)
                low, high = _rough_gains(a[left], b, cover) if single else [np.maximum(near[left] - cover, 0).sum(1)] * 2
                kind = np.isin(x["camid"].to_numpy()[left], known.cameras).astype(int) if ask.kinds else 0
                found.append(pd.DataFrame({"selector": name, "kind": kind, "image_idx": x["image_idx"].to_numpy()[left], "low": low, "high": high}))
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[*of, "low", "high"])

        return gains

    def met(some: DataFrame, n: int, single: bool) -> DataFrame:
        add = lambda found: found.groupby(of, as_index=False)[["low", "high"]].sum()
        part = block_scan(some, evaluated, scan(single), "selector string, kind long, image_idx long, low double, high double", by=tuple(by), fold=add, largest=(n, most))
        if single:
            return part.groupBy(*by, *of).agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        return part.groupBy(*by, *of).agg(F.sum(F.col("low").cast("long")).alias("gain"))

    candidates, evaluated = table.where("_candidate").select(*by, "image_idx", "camid", "feat"), table.where("_evaluated").select(*by, "image_idx", "feat")
    rough = written(met(candidates, most, True), "gains")
    best = rough.groupBy(*by, "selector", "kind").agg(F.max("low").alias("best")).toDF(*(f"_{c}" for c in [*by, "selector", "kind", "best"]))  # a row for each pool, selector and kind
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "selector", "kind"]]
    near = written(rough.join(F.broadcast(best), [*same, F.col("high") >= F.col("_best")]).select(*by, "image_idx").distinct(), "near")
    n = near.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    first = W.Window.partitionBy(*by, "selector", "kind").orderBy("num", "image_idx")
    exact = met(candidates.join(near, [*by, "image_idx"]), n, False).withColumn("num", -F.col("gain").cast("double")).drop("gain")
    ordered = exact.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return table.select(*by, "image_idx", "camid", "_partner", "feat").join(F.broadcast(ordered), [*by, "image_idx"]).select(*by, "selector", "image_idx", "camid", "_partner", "feat", "num", "kind", "_n")


def _next(rules: dict, asks: dict[tuple, Ask], rows: dict[tuple, list[Row]]) -> dict[tuple, Ask]:
    following = {}
    for key, ask in asks.items():
        try:
            following[key] = rules[key].send([r for n, r in enumerate(rows[key]) if n < ask.n or ask.kinds])
        except StopIteration:
            pass
    return following


def local_table(frame: pd.DataFrame, has_cameras: bool, seed: int, block: int = 1024) -> tuple[pd.DataFrame, int]:
    """The same columns for a pool of bounded size, but clusters, and its threshold; similarities are computed by blocks of rows."""
    frame = frame.sort_values("image_idx", ignore_index=True)
    x, n = matrix(frame["feat"]), len(frame)
    cams = frame["camid"].to_numpy()
    pair, sparse, best, counts = np.full(n, np.inf), np.full(n, -1.0), np.full(n, -1), {}
    for at in range(0, n, block):
        rows = np.arange(at, min(at + block, n))
        sim = micro(x[rows], x)
        for value, times in zip(*np.unique(sim[rows[:, None] < np.arange(n)[None]], return_counts=True), strict=True):
            counts[int(value)] = counts.get(int(value), 0) + int(times)
        sim = sim / UNIT
        sim[np.arange(len(rows)), rows] = -np.inf
        near = -np.sort(-sim, axis=1)[:, : min(NEIGHBOURS, n - 1)]
        if near.shape[1]:
            sparse[rows] = -np.round(1 / np.maximum(1 - near, LEAST_DISTANCE).mean(1), DIGITS)
        if has_cameras:
            sim[cams[rows, None] == cams[None]] = -np.inf
        most = sim.max(1, initial=-np.inf)
        found = np.isfinite(most)
        best[rows[found]], pair[rows[found]] = sim.argmax(1)[found], -most[found]
    mutual = (best >= 0) & (best[best] == np.arange(n))
    idx = frame["image_idx"].to_numpy()

    def md5(*of: object) -> str:
        return hashlib.md5(":".join(map(str, of)).encode(), usedforsecurity=False).hexdigest()

    out = frame.assign(_draw=[md5(seed, i) for i in idx], _fill=[md5(f"{seed}:fill", i) for i in idx], _turn=[md5(seed, "cam", c) for c in cams], _sparse=sparse, _pair=pair, _candidate=True)
    out["_partner"] = pd.array([int(idx[b]) if m else None for b, m in zip(best, mutual, strict=True)], "Int64")
    out["_nth"] = out.sort_values(["_draw", "image_idx"]).groupby("camid").cumcount() + 1
    return out, _units(_quantile(counts, DUP_QUANTILE)) if counts else UNIT


def _quantile(counts: dict[int, int], q: float) -> float:
    """The interpolated quantile of values in units that occur so often."""
    values = np.array(sorted(counts))
    upto = np.cumsum([counts[int(v)] for v in values])
    at = q * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, p, side="right")] for p in (math.floor(at), math.ceil(at)))
    return float(low + (high - low) * (at - math.floor(at))) / UNIT


def choose(frame: pd.DataFrame, names: Iterable[str], k: int, seed: int, has_cameras: bool = True) -> dict[str, list[int]]:
    """Image numbers by selector from one pool of bounded size, all of whose rows are evaluated and may be picked; no clusters."""
    rows, tau = local_table(frame, has_cameras, seed)
    x, out = matrix(rows["feat"]), {}
    for name in names:
        s = State(k, len(rows), tau, has_cameras, x if name in _COVERING else None)
        rule = SELECTORS[name](s)
        ask = next(rule, None)
        while ask:
            found = answer(rows, x, Known.of(s, ask), ask, s.evaluated)
            given = [Row(int(r.image_idx), int(r.camid), None if pd.isna(r.partner) else int(r.partner), np.asarray(r.feat, float), float(r.num), int(r.kind)) for r in found.rename(columns={"_partner": "partner"}).itertuples()]
            ask = _next({0: rule}, {0: ask}, {0: given}).get(0)
        out[name] = s.taken
    return out


def select_within(pools: DataFrame, by: list[str], names: Iterable[str], k: int, seed: int, has_cameras: bool = True) -> DataFrame:
    """select() for many pools whose size is bounded, such as training batches: each is one group. For rules that need no clusters."""
    names = _checked(pools, names)
    if clustered := {"typical", "style_cover"} & set(names):
        raise ValueError(f"{', '.join(sorted(clustered))} need select()")
    kinds = dict(pools.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "selector string", "pos long", "image_idx long"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        picked = choose(frame, names, k, seed, has_cameras)
        rows = [(*key, name, n, i) for name, ids in picked.items() for n, i in enumerate(ids, 1)]
        return pd.DataFrame(rows, columns=[*by, "selector", "pos", "image_idx"])

    return pools.select(*by, "image_idx", "camid", "feat").groupBy(*by).applyInPandas(run, schema)


def identity_means(images: DataFrame, dims: int, *by: str) -> DataFrame:
    """Unit mean vector of each identity (in each group), as a pool in which an image stands for an identity (image_idx = pid)."""
    from vistrel.functions.vector import l2_normalise, vector_avg

    means = images.groupBy(*by, "pid").agg(vector_avg(l2_normalise(F.col("feat")), dims).alias("m"))
    return means.select(*by, F.col("pid").alias("image_idx"), F.lit(0).alias("camid"), l2_normalise(F.col("m")).alias("feat"))
