"""Substring deduplication by paragraph MinHash banding.

Passages are inserted into lines as well as beside them, so the paragraphs that are compared are the sentences of at least MIN_WORDS
words: whatever surrounds a passage, the sentences inside it stay whole. Shorter neighbours are compared as units of at least MIN_WORDS
words, one from each short sentence on, so verse, lists and wrapped lines are found wherever the first of them stands. Stretches of more than
LONG words without a sentence end are cut where their own words say so: after a pair of words whose hash is the least of the CUT_WINDOW
before and after it. Equal passages are cut equally wherever they stand, but for the words at their edges.

1. A scan lists the units of every text with a key, the hash of the normalised words.
2. In the same scan distinct long sentences of a task are banded: BANDS bands of ROWS MinHash values, which miss a pair of similarity 0.8 with
   probability (1 - 0.8^2)^5 = 0.6 %. A bucket's least key leads, each other key is paired with it; copies share their
   key and cost a row per task. The pairs are verified by exact Jaccard on the shingle sets of both sentences.
3. A bucket's further keys are searched for links as well: where they lie in several components, blocks of those outside the
   leader's component meet blocks of all, and pairs of different components that can be similar by prefix filtering (which
   loses none) are verified. At most a link a key leaves a block, so every pair of a bucket is tested or already connected.
4. Components of all links make classes of keys; a class whose sentences lie in two or more documents repeats.
   Units of short sentences have at most 14 words and are compared by their key alone: two of them are similar if they are equal,
   or if of 13 or 14 words and unlike in a word at their edge, where the units beside them hold the rest.
5. Runs of repeating units in a row are passages: an unrepeated sentence of MIN_WORDS words or more ends a run, as do shorter
   ones of PASSAGE_WORDS words together. From PASSAGE_WORDS repeating words on, each counted once, they are reported. The
   smallest document id of a class owns it and keeps its sentences; a passage lists what units that others own cover, which
   are its removals. Owners get smaller from unit to unit, so what is removed is kept somewhere. A sentence-aligned passage
   of 50 words counts PASSAGE_WORDS at least: short sentences without a unit lie between or beside ones that count.

Words are runs of anything but white space, lower-cased; in scripts that put no space between words each character is one, and their full
stops end sentences. Null texts count as empty. Null ids count as one document, as do
rows that repeat an id; passages are by row. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.llm.common import bounded_batches, drop_tables, materialise
from vistrel.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 5, 2
#: Least words of a unit that is compared, and of a passage that is reported.
MIN_WORDS, PASSAGE_WORDS = 8, 24
#: Keys up to which those that pick sentences for verification are sent to each task (8 bytes each).
BROADCAST_ROWS = 1_000_000
CACHE_WORDS, CACHE_KEYS, CACHE_SHINGLES = 200_000, 100_000, 200_000
#: Outlying and all further keys of a block in step 3.
BLOCK_OUT, BLOCK_ALL = 256, 2048
#: Words of a sentence beyond which it is cut, and words on either side that decide on a cut. No shorter sentence holds a passage of 50 words.
LONG, CUT_WINDOW = 40, 4
#: Literal beginnings, which the search leaps to; a mark belongs to the sentence that it ends.
_END = re.compile(r"\.\s+|!\s+|\?\s+|\n\n*")
#: Characters of scripts without spaces between words (Thai to Khmer, kana, Han), and sentence ends where such stand.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TOKEN = re.compile(r"\S+")
_WIDE_TOKEN = re.compile(f"{_UNSPACED.pattern}|[^\\s{_UNSPACED.pattern[1:-1]}]+")
_WIDE_END = re.compile(r"(?<=[.!?])\s+|\n+|(?<=[\u3002\uff01\uff1f])\s*(?=\S)")

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_WEIGHTS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(words: list[str]) -> list[int]:
    """Places before which a long sentence is cut, from 0 to the number of its words."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)
    n = len(h) - 2 * CUT_WINDOW
    mid = h[CUT_WINDOW : CUT_WINDOW + n]
    least = np.ones(max(n, 0), bool)
    for k in range(2 * CUT_WINDOW + 1):
        if k != CUT_WINDOW:
            least &= mid < h[k : k + n] if k < CUT_WINDOW else mid <= h[k : k + n]
    return [0, *(np.flatnonzero(least) + CUT_WINDOW + 1).tolist(), len(words)]


def _pieces(lower: str, at: int, end: int, words: list[str], token: re.Pattern) -> Iterator[tuple[int, int, list[str]]]:
    """A sentence, in pieces if it is long."""
    if len(words) <= LONG:
        yield at, end, words
        return
    places = [m.span() for m in token.finditer(lower, at, end)]
    edges = cuts(words)
    for a, b in zip(edges, edges[1:], strict=False):
        yield (at if a == 0 else places[a][0]), (end if b == len(words) else places[b - 1][1]), words[a:b]


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence, of long ones of each piece."""
    text, at = text or "", 0
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow; places are those of the text
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    unspaced = not text.isascii() and _UNSPACED.search(text)
    split = (lambda s: _UNSPACED.sub(r" \g<0> ", s).split()) if unspaced else str.split
    token = _WIDE_TOKEN if unspaced else _TOKEN
    for gap in (_WIDE_END if unspaced else _END).finditer(text):
        end, after = gap.span()
        if not unspaced and text[end] != "\n":
            end += 1
        if words := split(lower[at:end]):
            yield from _pieces(lower, at, end, words, token)
        at = after
    if words := split(lower[at:]):
        yield from _pieces(lower, at, len(text), words, token)


def _key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - 2**63


def units(found: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, list[str]]]:
    """First and last sentence and words of each unit: long sentences, and from each short one on as many of its short
    neighbours as make MIN_WORDS words; the last ones of a run of short sentences are reached from its end."""
    k = 0
    while k < len(found):
        if len(found[k][2]) >= MIN_WORDS:
            yield k, k, found[k][2]
            k += 1
            continue
        end = k
        while end < len(found) and len(found[end][2]) < MIN_WORDS:
            end += 1
        upto, words = k, []
        for at in range(k, end):
            while len(words) < MIN_WORDS and upto < end:
                words = words + found[upto][2]
                upto += 1
            if len(words) < MIN_WORDS:
                if at > k and reached < end:  # a unit back from the end holds what is left
                    while len(words) < MIN_WORDS:
                        at -= 1
                        words = found[at][2] + words
                    yield at, end - 1, words
                break
            yield at, upto - 1, words
            reached = upto
            words = words[len(found[at][2]) :]
        k = end


def _weight(words: int) -> int:
    """What an unrepeated sentence weighs against a run."""
    return words if words < MIN_WORDS else PASSAGE_WORDS


class _Bands:
    """The buckets of long sentences, those of a key once in a while of a task."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.seen: set[int] = set()
        self.flat: list[str] = []
        self.sizes: list[int] = []

    def add(self, key: int, words: list[str]) -> bool:
        """Whether this sentence gets buckets."""
        if len(words) < MIN_WORDS or key in self.seen:
            return False
        if len(self.seen) >= CACHE_KEYS:
            self.seen.clear()
        self.seen.add(key)
        self.flat += words
        self.sizes.append(len(words))
        return True

    def buckets(self) -> np.ndarray:
        """A row of buckets for each sentence that was added since."""
        flat, sizes, known = self.flat, self.sizes, self.known
        self.flat, self.sizes = [], []
        if not sizes:
            return np.zeros((0, BANDS), np.int64)
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(flat).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        total = sum(h[k : len(h) - SHINGLE + 1 + k] * _WEIGHTS[k] for k in range(SHINGLE))
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # alternate starts and last shingles, so that no shingle across two sentences counts
        edges = np.stack([starts, ends - SHINGLE + 1], 1).reshape(-1)
        out = np.empty((len(sizes), BANDS), np.uint64)
        for band in range(BANDS):
            mixed = np.full(len(sizes), band + 1, np.uint64)
            for row in range(band * ROWS, band * ROWS + ROWS):
                value = (total * _MULTIPLY[row] + _ADD[row]) >> np.uint64(32)
                least = np.minimum.reduceat(np.append(value, np.uint64(2**63)), edges)[::2]
                mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            out[:, band] = mixed
        return out.view(np.int64)


_UNIT = ["row", "doc_id", "start", "end", "low", "high", "light", "heavy", "key"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per unit: its place, the words of the text before it and up to its end, the weight of the same, its key, and the
    buckets of a long sentence where a task meets it first."""
    bands = _Bands()
    for b in batches:
        columns, has = [[] for _ in _UNIT], []
        row, ids, start, end, low, high, light, heavy, key = columns
        for r, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = list(sentences(text))
            count, weight = [0], [0]
            for _, _, words in found:
                count.append(count[-1] + len(words))
                weight.append(weight[-1] + _weight(len(words)))
            for first, last, words in units(found):
                k = _key(words)
                row.append(r)
                ids.append(i)
                start.append(found[first][0])
                end.append(found[last][1])
                low.append(count[first])
                high.append(count[last + 1])
                light.append(weight[first])
                heavy.append(weight[last + 1])
                key.append(k)
                has.append(first == last and bands.add(k, words))
        upto = np.concatenate([[0], np.cumsum(has)]) * BANDS
        listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(bands.buckets().reshape(-1)))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), listed], names=[*_UNIT, "buckets"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key): each further key of a bucket with the bucket and its first key."""
    bucket = lead = None
    for b in batches:
        if not b.num_rows:
            continue
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        first = np.append(True, k[1:] != k[:-1])
        if k[0] == bucket:
            first[0] = False
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        leader = np.where(at >= 0, v[at], lead if lead is not None else 0)
        bucket, lead = k[-1], leader[-1]
        keep = leader != v
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(leader[keep]), pa.array(v[keep])], names=["bucket", "a", "b"])


def _picked_sentences(wanted: Broadcast | None):
    """Sentences with their keys: those whose key is wanted, or all where the wanted keys are too many to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = [], []
            for text in b.column(0).to_pylist():
                for _, _, words in sentences(text):
                    if len(words) >= MIN_WORDS:
                        keys.append(_key(words))
                        texts.append(words)
            k = np.array(keys, np.int64)
            at = np.unique(k, return_index=True)[1]
            if wanted is not None and len(wanted.value):
                place = np.minimum(np.searchsorted(wanted.value, k[at]), len(wanted.value) - 1)
                at = at[wanted.value[place] == k[at]]
            elif wanted is not None:
                at = at[:0]
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array([" ".join(texts[i]) for i in at], pa.string())], names=["key", "sentence"])

    return run


def shingles(sentence: str) -> set[tuple[str, ...]]:
    words = sentence.split(" ")
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


def _similar(p: set, q: set) -> bool:
    shared = len(p & q)
    return shared >= SIMILARITY * (len(p) + len(q) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [_similar(shingles(x), shingles(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def block_links(rows: list[tuple[int, int, bool, str]]) -> list[tuple[int, int]]:
    """Links between components of one block of (key, component, outlying, sentence); each joins two of them."""
    index: dict[int, list[int]] = defaultdict(list)
    prefixes = []
    for n, (_, _, outlying, text) in enumerate(rows):
        # sets of similarity t share one of the least (1 - t) n + 1 values of each, in any common order
        values = sorted(map(hash, shingles(text)))
        prefixes.append(values[: len(values) - math.ceil(SIMILARITY * len(values) - 1e-9) + 1] if outlying else [])
        if not outlying:
            for v in values[: len(values) - math.ceil(SIMILARITY * len(values) - 1e-9) + 1]:
                index[v].append(n)
    above: dict[int, int] = {}
    sets: dict[int, set] = {}
    held = 0

    def root(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    links = []
    for x, prefix in enumerate(prefixes):
        for y in {y for v in prefix for y in index.get(v, ())}:
            p, q = root(rows[x][1]), root(rows[y][1])
            if p == q:
                continue
            for r in (x, y):
                if r not in sets:
                    if held > CACHE_SHINGLES:
                        sets, held = {k: v for k, v in sets.items() if k in (x, y)}, 0
                    sets[r] = shingles(rows[r][3])
                    held += len(sets[r])
            if _similar(sets[x], sets[y]):
                above[max(p, q)] = min(p, q)
                links.append((rows[x][0], rows[y][0]))
    return links


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j): the links of each block."""

    def out(rows: list) -> pa.RecordBatch:
        got = np.array(block_links(rows), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    block, held = None, []
    for b in batches:
        for bucket, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (bucket, i, j) != block and held:
                yield out(held)
                held = []
            block = (bucket, i, j)
            held.append(row)
    if held:
        yield out(held)


def _links_across(led: DataFrame, component: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (a, b) between further keys of a bucket whose components differ; led has bucket, leader a, further key b."""
    main = component.select(F.col("node").alias("a"), F.col("component").alias("main"))
    shared = led.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    labelled = (
        led.join(shared, "bucket")
        .join(component.withColumnRenamed("node", "b"), "b", "left")
        .join(main, "a", "left")
        .select("bucket", F.col("b").alias("key"), F.coalesce("component", "b").alias("comp"), (F.coalesce("component", "b") != F.coalesce("main", "a")).alias("outlying"))
    )
    labelled = materialise(labelled, "unit-labelled")
    spread = (
        labelled.groupBy("bucket")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_all"), F.count_if("outlying").alias("n_out"))
        .where("low <> high")
        .select("bucket", F.ceil(F.col("n_out") / BLOCK_OUT).cast("int").alias("i_n"), F.ceil(F.col("n_all") / BLOCK_ALL).cast("int").alias("j_n"))
    )
    blocks = labelled.join(spread, "bucket").join(chosen, "key")
    place = F.abs(F.xxhash64("key") % 1_000_003)
    i, j = (place % F.col("i_n")).cast("int"), (place % F.col("j_n")).cast("int")
    out_rows = blocks.where("outlying").select("bucket", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"), "key", "comp", "outlying", "sentence")
    all_rows = blocks.select("bucket", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), j.alias("j"), "key", "comp", F.lit(False).alias("outlying"), "sentence")
    cross = out_rows.unionByName(all_rows).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_across, "a long, b long")
    found = materialise(cross.distinct(), "unit-links")
    drop_tables(labelled)
    return found


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """A row per passage of docs (columns doc_id, text) that other documents share:
    doc_id, start, end (code points), words, removed, removals as (start, end, component, owner_doc_id)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialise(rows.mapInArrow(_units, ", ".join([*(f"{c} long" for c in _UNIT), "buckets array<long>"])), "units")
    listed, texts = scanned.select(_UNIT), docs.select("text")
    banded = scanned.select(F.explode("buckets").alias("bucket"), "key").repartition("bucket").sortWithinPartitions("bucket", "key")
    led = materialise(banded.mapInArrow(_leads, "bucket long, a long, b long").distinct(), "unit-buckets")
    near = materialise(led.select("a", "b").distinct(), "unit-pairs")
    wanted = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    sent = None
    if wanted.count() <= BROADCAST_ROWS:  # at most 8 MB, as a sorted array
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["key"].to_numpy(np.int64)))
    picked = texts.mapInArrow(_picked_sentences(sent), "key long, sentence string")
    picked = picked if sent is not None else picked.join(wanted, "key", "left_semi")
    chosen = materialise(picked.groupBy("key").agg(F.min("sentence").alias("sentence")), "unit-texts")
    paired = near.join(chosen.select(F.col("key").alias("a"), F.col("sentence").alias("sa")), "a").join(chosen.select(F.col("key").alias("b"), F.col("sentence").alias("sb")), "b")
    links = paired.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")
    component = connected_components(links)
    more = _links_across(led, component, chosen)
    if not more.isEmpty():
        component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    keys = listed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    classed = keys.join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    repeating = classed.groupBy("component").agg(F.min("least").alias("owner"), F.max("most").alias("last")).where("owner <> last").select("component", "owner")
    marked = classed.select("key", "component").join(repeating, "component").select("key", "component", "owner")
    by = W.Window.partitionBy("row").orderBy("start", "end")
    past = by.rowsBetween(W.Window.unboundedPreceding, -1)
    others = ~F.col("owner").eqNullSafe(F.col("doc_id"))
    found = listed.join(marked, "key").select(
        "*",
        F.greatest(F.col("high") - F.greatest("low", F.max("high").over(past)), F.lit(0)).alias("words"),
        F.coalesce((F.col("light") - F.max("heavy").over(past) >= PASSAGE_WORDS).cast("int"), F.lit(0)).alias("apart"),
        F.when(others, F.greatest("start", F.max(F.when(others, F.col("end"))).over(past))).alias("cut"),
    )
    removal = F.when(F.col("cut") < F.col("end"), F.struct(F.col("cut").alias("start"), "end", "component", F.col("owner").alias("owner_doc_id")))
    passages = (
        found.withColumn("run", F.sum("apart").over(by))
        .groupBy("row", "doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.array_sort(F.collect_list(removal)).alias("removals"))
        .where(F.col("words") >= passage_words)
    )
    return passages.select("doc_id", "start", "end", "words", (F.size("removals") > 0).alias("removed"), "removals")
