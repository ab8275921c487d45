"""MinHash near-deduplication with sequential Bayesian verification.

1. A scan hashes the 5-word shingles of every text to 64 bits, keeps the set's size and a digest of the set, and takes
   a MinHash signature. Documents with equal sets form a class with its smallest id as node; only nodes go on.
2. Bands of the signature bucket the nodes. In each bucket the node that shares most buckets with others leads, and
   every other node is paired with it: as many pairs as members. Pairs are tested batch by batch of the signature and
   pruned once the posterior probability of the wanted similarity falls below the chosen miss probability; survivors are
   confirmed on the full sets of both texts. Links give first components.
3. Nodes that shared a bucket share its leader. Leaders whose followers lie in several components are searched for links
   across components: blocks of the followers outside the leader's component meet blocks of all its followers, with their
   signatures alone. A block tests the pairs that lie in different components; survivors are confirmed on the full sets.
   A block with more survivors than PAIRS_PER_ROW a row, as groups just below the threshold give, writes none of
   them: its rows come again with their texts, survivors are confirmed within it, likeliest first, and components joined as it goes, so at
   most a link per follower leaves it. So every pair of nodes that shares a bucket is either tested or already connected,
   without a cap on buckets and without writing out their pairs; texts are copied for dense blocks only.
4. Components of all links; each class member gets its node's component.

Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased. A text with fewer words than a shingle is one
shingle; null texts and texts without words have no shingles and no links. Rows without an id are not
linked: their component is null and they are kept. Repeated rows share an id and so a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import bounded_batches, drop_tables, materialise
from vistrel.llm.components import connected_components

#: Words of a shingle, and the similarity of a link in percent.
SHINGLE, PERCENT = 5, 85
#: Bands and their rows: a pair at the threshold is missed with probability (1 - 0.85^5)^24, below one in a million.
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Hashes that are compared between two tests, and the miss probability at which a pair is given up.
STEP, MISS = 24, 1e-5
#: Outlying and all followers of a block in step 3, and pairs a row up to which its survivors are written.
BLOCK_OUT, BLOCK_ALL, PAIRS_PER_ROW = 256, 1024, 4
#: Ids up to which the side that picks rows is broadcast (8 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
CACHE_WORDS, CACHE_SETS, CACHE_BYTES = 150_000, 128, 32 << 20

_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_WEIGHTS = _rng.integers(0, 2**63, max(SHINGLE, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The set of a text's shingles as sorted distinct 64-bit hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(SHINGLE, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * _WEIGHTS[k]
        return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[at : at + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(0), out=out)
    return out.astype(np.uint32)


def _least_matches() -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is given up): with a uniform prior the posterior of a similarity
    of t or more after m matches of n is the chance of at most m successes in n + 1 draws of probability t."""
    t, out = PERCENT / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


LEAST_MATCHES = _least_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the rows of two signature arrays whose pairs are not given up."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in LEAST_MATCHES:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(1, dtype=np.int32)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, seen = Shingler(), set()
    for b in batches:
        count, key, sig = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = shingler(text)
            count.append(len(s))
            key.append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None)
            fresh = len(s) and key[-1] not in seen and i is not None
            if fresh:  # copies within a task need no second signature
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key[-1])
            sig.append(signature(s).tobytes() if fresh else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rows = _matrix(b.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = _mix((rows * _WEIGHTS[:ROWS]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(keys.reshape(-1).view(np.int64))], names=["node", "bucket"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keep = pa.array(survivors(_matrix(b.column(2)), _matrix(b.column(3))), pa.int64())
            yield b.select([0, 1]).take(keep)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared) and shared > 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, sets = Shingler(), {}

    def of(text: str) -> np.ndarray:
        if (got := sets.get(text)) is None:
            if len(sets) >= CACHE_SETS:
                sets.clear()
            got = sets[text] = shingler(text)
        return got

    for b in batches:
        keep = [linked(of(x), of(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose column is among ids, a written table's column of the same name."""
    ids = ids.distinct()
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, column, "left_semi")


def _ends(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.select(F.col("a").alias(column)).unionByName(pairs.select(F.col("b").alias(column)))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table that are links on the full shingle sets."""
    texts = _only(docs, "doc_id", _ends(pairs, "doc_id"))
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long").distinct()


def _block_pairs(t: pa.Table) -> np.ndarray:
    """Places of the pairs of one block that lie in different components and are not given up."""
    out = t.column("outlying").to_numpy()
    comp, sig = t.column("comp").to_numpy(), _matrix(t.column("sig"))
    o, m = np.flatnonzero(out), np.flatnonzero(~out)
    found = [np.zeros((0, 2), np.int64)]
    n, least = LEAST_MATCHES[0]
    for part in np.array_split(o, max(1, len(o) * max(1, len(m)) // 100_000)):
        near = (sig[part, None, :n] == sig[None, m, :n]).sum(2, dtype=np.int16) >= least
        near &= comp[part, None] != comp[None, m]
        x, y = np.nonzero(near)
        x, y = part[x], m[y]
        stay = survivors(sig[x], sig[y])
        found.append(np.stack([x[stay], y[stay]], 1))
    return np.concatenate(found)


def _block_search(t: pa.Table, pairs_per_row: int) -> pa.RecordBatch:
    """The survivors of one block, or its place alone where they are too many."""
    pairs, node = _block_pairs(t), t.column("node").to_numpy()
    if len(pairs) > pairs_per_row * t.num_rows:
        leader, i, j = (t.column(k)[0].as_py() for k in ("leader", "i", "j"))
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([leader], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32())], names=_SEARCHED)
    ends = np.sort(node[pairs], axis=1)
    none = pa.nulls(len(pairs))
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32())], names=_SEARCHED)


_SEARCHED = ["a", "b", "leader", "i", "j"]


def _block_links(t: pa.Table, shingler: Shingler) -> pa.RecordBatch:
    """Links between components of one block with texts; each joins two of them."""
    node, comp, sig = t.column("node").to_numpy(), t.column("comp").to_numpy(), _matrix(t.column("sig"))
    texts = t.column("text")
    pairs = _block_pairs(t)
    likely = np.concatenate([(sig[p[:, 0]] == sig[p[:, 1]]).sum(1) for p in np.array_split(pairs, len(pairs) // 10_000 + 1)])
    above: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    held = 0

    def root(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    links = []
    for x, y in pairs[np.argsort(-likely, kind="stable")]:
        p, q = root(int(comp[x])), root(int(comp[y]))
        if p == q:
            continue
        for r in (x, y):
            if node[r] not in sets:
                if held > CACHE_BYTES:
                    sets, held = {k: v for k, v in sets.items() if k in (node[x], node[y])}, 0
                sets[node[r]] = shingler(texts[int(r)].as_py())
                held += sets[node[r]].nbytes
        if linked(sets[node[x]], sets[node[y]]):
            above[max(p, q)] = min(p, q)
            links.append((node[x], node[y]))
    got = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def _by_block(search):
    """Rows sorted by (leader, i, j): what ``search`` gives for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key and held:
                    yield search(pa.Table.from_batches(held))
                    held = []
                key = keys[at]
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each block with texts."""
    shingler = Shingler()
    yield from _by_block(lambda t: _block_links(t, shingler))(batches)


def _links_across(apart: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) across the components of each leader's followers: apart has leader, node, comp, outlying, i_n, j_n."""
    signed = apart.join(_only(sigs, "node", apart.select("node")), "node")
    place = F.abs(F.xxhash64("node") % 1_000_003)
    i, j = (place % F.col("i_n")).cast("int"), (place % F.col("j_n")).cast("int")
    carried = ["node", "comp", "sig"]
    out_rows = signed.where("outlying").select("leader", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"), *carried, "outlying")
    all_rows = signed.select("leader", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), j.alias("j"), *carried, F.lit(False).alias("outlying"))
    blocks = out_rows.unionByName(all_rows)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    searched = materialise(dealt(blocks).mapInArrow(_by_block(partial(_block_search, pairs_per_row=PAIRS_PER_ROW)), "a long, b long, leader long, i int, j int"), "near-searched")
    pairs = materialise(searched.where("a is not null").select("a", "b").distinct(), "near-pairs")
    dense = searched.where("leader is not null").select("leader", "i", "j")
    few = _confirmed(pairs, docs)
    n = dense.count()
    if not n:
        return few
    again = blocks.join(F.broadcast(dense) if n <= BROADCAST_ROWS else dense, ["leader", "i", "j"], "left_semi")
    texts = _only(docs, "doc_id", materialise(again.select(F.col("node").alias("doc_id")).distinct(), "near-dense"))
    many = dealt(again.join(texts.select(F.col("doc_id").alias("node"), "text"), "node").select("leader", "i", "j", *carried, "outlying", "text")).mapInArrow(_across, "a long, b long")
    return few.unionByName(many)


def near_components(docs: DataFrame) -> DataFrame:
    """A row per row of docs (columns doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialise(docs.mapInArrow(_scan, "doc_id long, n_shingles long, set_key binary, sig binary"), "near-scan")
    keyed = scanned.where("doc_id is not null and set_key is not null")
    nodes = materialise(keyed.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig", ignorenulls=True).alias("sig")), "near-nodes")
    sigs = nodes.select("node", "sig")

    bands = sigs.mapInArrow(_buckets, "node long, bucket long")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = materialise(bands.join(shared, "bucket"), "near-members")
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    leaders = materialise(
        members.join(weight, "node").groupBy("bucket").agg((-F.max(F.struct("weight", (-F.col("node")).alias("n")))["n"]).alias("leader")), "near-leaders"
    )
    led = members.join(leaders, "bucket")
    stars = led.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    stars = materialise(stars, "near-stars")
    ends = _only(sigs, "node", _ends(stars, "node"))
    a, b = ends.select(F.col("node").alias("a"), F.col("sig").alias("sa")), ends.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    tested = materialise(stars.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_prune, "a long, b long"), "near-tested")
    links = materialise(_confirmed(tested, docs), "near-links")
    component = connected_components(links)

    followers = led.where("members > 2 and node <> leader").select("leader", "node").distinct()
    main = component.select(F.col("node").alias("leader"), F.col("component").alias("main"))
    labelled = (
        followers.join(component, "node", "left")
        .join(main, "leader", "left")
        .select("leader", "node", F.coalesce("component", "node").alias("comp"), (F.coalesce("component", "node") != F.coalesce("main", "leader")).alias("outlying"))
    )
    spread = (
        labelled.groupBy("leader")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_all"), F.count_if("outlying").alias("n_out"))
        .where("low <> high")
        .select("leader", F.ceil(F.col("n_out") / BLOCK_OUT).cast("int").alias("i_n"), F.ceil(F.col("n_all") / BLOCK_ALL).cast("int").alias("j_n"))
    )
    apart = materialise(labelled.join(spread, "leader"), "near-apart")
    more = materialise(_links_across(apart, sigs, docs).distinct(), "near-links")
    if not more.isEmpty():
        component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    classes = nodes.join(component, "node", "left").select("set_key", F.coalesce("component", "node").alias("found"))
    drop_tables(tested, stars, apart, members, leaders)
    return (
        scanned.select("doc_id", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document, that of the smallest id, of each component; all columns are kept."""
    gone = near_components(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
