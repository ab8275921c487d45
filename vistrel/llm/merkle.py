"""A Merkle manifest of a dataset: a tree of 16-ary digests per source, a tree over the sources, and a proof for each row.

Rows get their place within their source from a range partitioning of narrow rows (digest and keys, no text), so the places of a
source with a third of all rows are dealt out like any others. The trees are reduced as a sparse forest: a fragment holds
nodes that wait for siblings, keyed by tree, level and index, and closes a run of siblings as soon as it is whole, which it knows
because the number of leaves tells each run's length. Merging fragments is associative and commutative, in whatever order.
Scan tasks fold their rows first. A tree reduction merges what waits, by common ancestors at level 3, 6, 9 and so on,
so no group has more than 4096 nodes; the root comes out as a row, not at the driver.

Proofs are made in blocks of 16**3 leaves: a block computes its own lower levels and gets the rest of the path as one row.

Nulls are inputs like any others (``-``); rows of one source stand by id, missing ids first, repeated ids by digest, so equal rows
may change places without changing anything. Other columns play no part. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.llm.common import bounded_batches, materialise

#: Children of a node, and the levels that a block of proofs computes by itself (16 ** 3 leaves).
ARITY, BLOCK_LEVELS = 16, 3
#: Rows that a range partition is meant to hold, and rows of a table of offsets or source paths that is broadcast at most (some hundred bytes each).
PART_ROWS, BROADCAST_ROWS = 200_000, 100_000
#: Levels that each round closes: fragments meet at their common ancestors, so a group holds at most 16 ** 3 nodes in any order of the rows.
ROUND_LEVELS = 3
#: Columns of a row that its leaf covers, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: bytes) -> bytes:
    """The digest of a run of digests, which enter as hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


def leaf_digest(**values: Column) -> Column:
    """Hex SHA-256 of the values in order, each ``-`` if null, else its bytes in UTF-8 counted, a colon and itself."""

    def item(v: Column) -> Column:
        shown = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*(item(v) for v in values.values())).cast("binary"), 256)


def row_digest(text: Column | None = None) -> Column:
    """The leaf of a row of documents, with another text than its own where given."""
    return leaf_digest(**{c: F.col(c) for c in LEAF_COLUMNS} | ({} if text is None else {"text": text}))


class Forest:
    """Nodes that wait for siblings. ``made`` collects the nodes that came into being, as (tree, leaves, level, index, digest)."""

    def __init__(self) -> None:
        self.waiting: dict[tuple, dict[int, bytes]] = {}
        self.made: list[tuple] = []

    def add(self, tree: str, leaves: int, level: int, index: int, value: bytes) -> None:
        width = leaves
        for _ in range(level):
            width = -(-width // ARITY)
        while width > 1:
            run, at = divmod(index, ARITY)
            held = self.waiting.setdefault((tree, leaves, level, run), {})
            held[at] = value
            if len(held) < min(ARITY, width - run * ARITY):
                return
            del self.waiting[tree, leaves, level, run]
            value, level, index, width = digest(b"".join(held[k] for k in sorted(held))), level + 1, run, -(-width // ARITY)
            self.made.append((tree, leaves, level, index, value))

    def merge(self, nodes: Iterable[tuple]) -> Forest:
        """Takes in what waits in another fragment."""
        for node in nodes:
            self.add(*node)
        return self

    def open(self) -> Iterator[tuple]:
        for (tree, leaves, level, run), held in self.waiting.items():
            for at, value in held.items():
                yield tree, leaves, level, run * ARITY + at, value


_NODES = "tree string, leaves long, level int, index long, digest binary, made boolean, open boolean"
_ARROW = pa.schema([("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("made", pa.bool_()), ("open", pa.bool_())])


def _fragment(forest: Forest) -> list[tuple]:
    """Rows of a fragment: nodes made from block level up and roots, and all that wait."""
    rows = {(t, level, i): [t, n, level, i, d, True, False] for t, n, level, i, d in forest.made if level >= BLOCK_LEVELS or _width(n, level) == 1}
    for t, n, level, i, d in forest.open():
        rows.setdefault((t, level, i), [t, n, level, i, d, False, False])[6] = True
    return [tuple(r) for r in rows.values()]


def _width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


def _depth(leaves: int) -> int:
    """The level of the root."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // ARITY), level + 1
    return level


def _root_level(leaves: Column) -> Column:
    return sum(((leaves > F.lit(ARITY**k)).cast("int") for k in range(1, 15)), (leaves > 1).cast("int"))


def _fold_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (tree, leaves, index, digest) of a scan task -> its fragment."""
    forest, out = Forest(), []
    for b in batches:
        for t, n, i, d in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if n == 1:  # a lone leaf is its own root
                out.append((t, 1, 0, 0, d, True, False))
            else:
                forest.add(t, n, 0, i, d)
        if len(forest.made) > 50_000:  # below block level only what waits is needed
            forest.made = [m for m in forest.made if m[2] >= BLOCK_LEVELS or _width(m[1], m[2]) == 1]
    out += _fragment(forest)
    for at in range(0, len(out), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 5000], strict=True), _ARROW, strict=True)], schema=_ARROW)


def _merge_waiting(frame: pd.DataFrame) -> pd.DataFrame:
    node = ["tree", "leaves", "level", "index", "digest"]
    forest = Forest().merge(frame[node].astype(object).itertuples(index=False, name=None))
    return pd.DataFrame(_fragment(forest), columns=[*node, "made", "open"])


def _tree_reduce(leaves: DataFrame) -> DataFrame:
    """Nodes (tree, leaves, level, index, digest) from block level up, and roots, of leaves (tree, leaves, index, digest)."""
    part = materialise(leaves.mapInArrow(_fold_scan, _NODES), "merkle-fragments")
    nodes, level = part.where("made"), ROUND_LEVELS
    while not (waiting := part.where("open")).isEmpty():
        ancestor = F.shiftright(F.call_function("shiftleft", F.col("index"), 4 * F.col("level")), 4 * level)  # a node's first leaf, in runs of 16 ** level
        part = materialise(waiting.withColumn("ancestor", ancestor).groupBy("tree", "ancestor").applyInPandas(_merge_waiting, _NODES), "merkle-fragments")
        nodes, level = nodes.unionByName(part.where("made")), level + ROUND_LEVELS
    return nodes.select("tree", "leaves", "level", "index", "digest")


def _small(df: DataFrame) -> DataFrame:
    """df (a written table), to be broadcast where a count allows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with ``index``, the place from 0 within ``tree``, and ``leaves``, the number of its rows."""
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    parts = max(-(-rows.count() // PART_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [tree, *order, "_row"]
    spread = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    spread = materialise(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-ordered")
    starts = spread.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.Window.partitionBy(tree).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each part with rows of the tree
    starts = materialise(
        starts.select(tree, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.Window.partitionBy(tree)).alias("leaves")), "merkle-starts"
    )
    return spread.join(_small(starts), [tree, "_part"]).withColumn("index", F.col("_at") + F.col("_shift")).drop("_row", "_at", "_part", "_shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree, level, run, digests): siblings side by side, at most 16 each."""
    run = F.shiftright("index", 4).alias("run")
    return nodes.groupBy("tree", "level", run).agg(F.array_sort(F.collect_list(F.struct("index", "digest")))["digest"].alias("digests"))


def _upper_paths(nodes: DataFrame) -> DataFrame:
    """(tree, block, path) of each node at block level below a root: per level its place among its siblings, and these."""
    blocks = nodes.where(F.col("level") == BLOCK_LEVELS).select("tree", F.col("index").alias("block"), "leaves")
    climbed = blocks.withColumn("top", _root_level(F.col("leaves"))).where(F.col("top") > BLOCK_LEVELS).withColumn("level", F.explode(F.sequence(F.lit(BLOCK_LEVELS), F.col("top") - 1)))
    own = F.call_function("shiftright", F.col("block"), 4 * (F.col("level") - BLOCK_LEVELS))
    met = climbed.withColumn("own", own).withColumn("run", F.shiftright("own", 4)).join(_runs(nodes), ["tree", "level", "run"])
    step = F.struct("level", (F.col("own") % ARITY).cast("int").alias("at"), F.array_join(F.transform("digests", lambda d: F.hex(d)), "").alias("run"))
    return met.groupBy("tree", "block").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(s["at"].alias("at"), s["run"].alias("run"))).alias("path"))


def _proofs(placed: DataFrame, nodes: DataFrame, carry: list[str], beyond: DataFrame | None = None) -> DataFrame:
    """(carry.., digest, tree, proof, steps) of the leaves; ``beyond`` (tree, proof, steps) are the same of each tree's root in the tree above."""
    carried = [*carry, "digest"]
    blocked = placed.select(*carried, "tree", "leaves", "index", F.shiftright("index", 4 * BLOCK_LEVELS).alias("block"))
    paths = materialise(_upper_paths(nodes), "merkle-paths")
    heads = blocked.select("tree", "block").distinct().toDF("tree", "block").join(_small(paths), ["tree", "block"], "left")
    if beyond is not None:
        heads = heads.join(_small(beyond.select("tree", "proof", "steps")), "tree", "left")
    else:
        heads = heads.withColumns({"proof": F.lit("").cast("binary"), "steps": F.lit("").cast("binary")})
    kinds = dict(placed.dtypes)

    def run(rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index", ignore_index=True)
        if not len(rows):
            return pd.DataFrame(columns=[*carried, "tree", "proof", "steps"])
        above = head["path"].iloc[0]
        tail, tail_steps = [], bytearray()
        for step in above if above is not None else ():
            whole, at = bytes.fromhex(step["run"]), int(step["at"])
            tail.append(whole[: 32 * at] + whole[32 * at + 32 :])
            tail_steps += bytes((at, len(whole) // 32))
        end, end_steps = b"".join(tail) + bytes(head["proof"].iloc[0]), bytes(tail_steps) + bytes(head["steps"].iloc[0])
        levels = [list(rows["digest"])]
        for _ in range(min(BLOCK_LEVELS, _depth(int(rows["leaves"].iloc[0])))):
            below = levels[-1]
            levels.append([digest(b"".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
        runs = [[b"".join(level[k : k + ARITY]) for k in range(0, len(level), ARITY)] for level in levels[:-1]]
        proofs, steps = [], []
        for i in range(len(rows)):
            parts, places = [], bytearray()
            for level in runs:
                k, at = divmod(i, ARITY)
                whole = level[k]
                parts.append(whole[: 32 * at] + whole[32 * at + 32 :])
                places += bytes((at, len(whole) // 32))
                i = k
            proofs.append(b"".join(parts) + end)
            steps.append(bytes(places) + end_steps)
        return rows[[*carried, "tree"]].assign(proof=proofs, steps=steps)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "tree string, proof binary, steps binary"])
    return blocked.groupBy("tree", "block").cogroup(heads.toDF(*heads.columns).groupBy("tree", "block")).applyInPandas(run, schema)


def manifest(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of docs: the columns of ``carry``, its ``leaf``, its source's ``subroot`` and the ``root`` (hex), and its proof.

    ``proof`` has the siblings' digests (32 bytes each) from the leaf up to the root, left to right, the source's tree first; ``steps`` has
    two bytes a level, the place among the siblings and their number. fold() recomputes the root from them.
    """
    bounded_batches(docs.sparkSession)
    names = {c: f"c{k}" for k, c in enumerate(carry)}
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # no source before all others
    leaves = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("doc_id").cast("long").alias("_id"), tree.alias("tree"), F.unhex(row_digest()).alias("digest"))
    placed = _placed(leaves, "tree", "_id", "digest").drop("_id")
    nodes = materialise(_tree_reduce(placed.select("tree", "leaves", "index", "digest")), "merkle-nodes")
    subroots = nodes.where(F.col("level") == _root_level(F.col("leaves"))).select(F.col("tree").alias("source_tree"), "digest")
    sources = materialise(_placed(subroots.withColumn("tree", F.lit("")), "tree", "source_tree"), "merkle-sources")
    above = materialise(_tree_reduce(sources.select("tree", "leaves", "index", "digest")), "merkle-nodes")
    root = above.where(F.col("level") == _root_level(F.col("leaves"))).select(F.lower(F.hex("digest"))).first()  # one row, none without leaves
    beyond = _proofs(sources, above, ["source_tree"]).select(F.col("source_tree").alias("tree"), "proof", "steps", F.lower(F.hex("digest")).alias("subroot"))
    beyond = materialise(beyond.withColumn("root", F.lit(root[0] if root else None).cast("string")), "merkle-subroots")
    proven = _proofs(placed, nodes, [*names.values()], beyond)
    whole = proven.join(_small(beyond.select("tree", "subroot", "root")), "tree")
    return whole.select(*(F.col(n).alias(c) for c, n in names.items()), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "proof", "steps")


def fold(rows: DataFrame, leaf: str, into: str) -> DataFrame:
    """rows with ``into``, the root (hex) that the leaf in column ``leaf`` (hex) gives with the row's proof and steps."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{into}` string"
    at = [rows.columns.index(c) for c in (leaf, "proof", "steps")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = []
            for text, proof, steps in zip(*(b.column(k).to_pylist() for k in at), strict=True):
                value, begin = bytes.fromhex(text), 0
                for k in range(0, len(steps), 2):
                    place, size = steps[k], steps[k + 1]
                    middle, end = begin + 32 * place, begin + 32 * (size - 1)
                    value, begin = digest(proof[begin:middle] + value + proof[middle:end]), end
                roots.append(value.hex())
            yield b.append_column(into, pa.array(roots, pa.string()))

    return rows.mapInArrow(run, schema)
