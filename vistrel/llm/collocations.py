"""Phrase collocation mining: exact counts of the phrases that a sketch cannot rule out, from Aho-Corasick scans.

1. Scan tasks add hashes of words, then of two to four words all of which may be frequent, to a count-min sketch of two rows. A task sends
   its non-empty cells in packed pieces; pieces of a shard of cells are added up, in two steps where there are many (saturating, as only
   "at least the threshold" matters), and leave a bit a cell. Counts of a sketch are upper bounds, so no frequent phrase is lost.
2. The phrases and words whose own cells and those of all their parts pass are the candidates. A scan takes its texts in stretches; the
   candidates of a stretch are its dictionary, of bounded size.
3. A dictionary is compiled into Aho-Corasick automata, one for each language. Phrases are guarded by a space on either side, in texts whose
   words stand between single spaces and whose pieces are parted by a line feed, so matches are whole words within a piece. The
   automata count all matches in their stretch, overlapping ones included; counts are summed by phrase. A text is scanned once, however
   many phrases are frequent, and no dictionary leaves its task.
4. Thresholds, scores and the rule about longer phrases are joins over the counted phrases.

The sketch's width follows the input up to MOST_CELLS (its bits go to every task); beyond that it lets more phrases pass and stretches get
shorter: slower, with the same result.

A null language is ``und``, a null text empty; repeated rows count each. Other columns play no part. An empty table has no phrases.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.llm.common import bounded_batches, materialise

#: Occurrences from which a phrase is a candidate, words of a phrase at most, and the percentage of a phrase's occurrences inside a longer one that drops it.
LEAST, MOST_WORDS, INSIDE = 30, 4, 80
#: Cells of a row of the sketch: at least and at most, and occurrences for each; cells that are added up together.
LEAST_CELLS, MOST_CELLS, PER_CELL, SHARD_CELLS = 1 << 18, 1 << 28, 4, 1 << 16
#: Counters stop here. Occurrences a cell that are added up in one place (beyond, in two steps), and hashes that a task collects before it sends them.
FULL, ADDED, HELD = 255, 64, 4_000_000
#: Bytes and phrases of a dictionary, and bytes of text that it is for at most; 400 000 phrases take a task some 150 MB.
DICTIONARY_BYTES, DICTIONARY_ROWS, STRETCH = 12 << 20, 400_000, 32 << 20
#: Words of the corpus for each list that counts are dealt to by hash, and such lists at most.
BUCKET_WORDS, MOST_BUCKETS = 500_000, 1 << 16
#: Bytes of text that are worked on together, and bytes of a word that its hash looks at.
CHUNK, HASHED = 1 << 20, 1024

_FOLDED = bytes.maketrans(f"{string.ascii_uppercase}\t.,;:!?\n\v\f\r".encode(), f"{string.ascii_lowercase} ".encode() + b"\n" * 10)
_BREAK, _GAP = re.compile(rb" *\n[ \n]*"), re.compile(rb" {2,}")
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def normal(text: str) -> bytes:
    """Words between single spaces, pieces parted by a line feed that stands as a word."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLDED)
    return _GAP.sub(b" ", _BREAK.sub(b" \n ", folded)).strip(b" ")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """(lang, text, limit) of rows (lang, text): what begins before ``limit`` belongs to the chunk, the words after it only continue it."""
    for b in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text and (words := normal(text)):
                by.setdefault(lang, []).append(words)
        for lang, texts in by.items():
            whole, at = b" " + b" \n ".join(texts) + b" ", 0
            while at < len(whole) - 1:
                cut = whole.find(b" ", at + CHUNK)
                cut = len(whole) - 1 if cut < 0 else cut
                end = cut
                for _ in range(MOST_WORDS - 1):
                    further = whole.find(b" ", end + 1)
                    end = end if further < 0 else further
                yield lang, whole[at : end + 1], cut - at
                at = cut


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_powers: list[np.ndarray] = []


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial in the bytes of each word, from running sums over all."""
    if not _powers or len(_powers[0]) < len(data):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(len(data) + CHUNK, base, np.uint64)
            steps[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(steps)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _powers[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return (sums[end] - sums[start]) * _powers[1][start]


def _beginnings(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same of the first HASHED bytes of each word, where some are longer."""
    parts, out = [text[s : min(e, s + HASHED)] for s, e in zip(start.tolist(), end.tolist(), strict=True)], []
    for at in range(0, len(parts), 512):
        some = parts[at : at + 512]
        size = np.array([len(p) for p in some])
        ends = np.cumsum(size)
        out.append(_word_hashes(np.frombuffer(b"".join(some), np.uint8), ends - size, ends))
    return np.concatenate(out)


class _Words:
    """The words of a chunk with hashes of the phrases that begin at each."""

    def __init__(self, lang: str, text: bytes, limit: int):
        data = np.frombuffer(text, np.uint8)
        spaces = np.flatnonzero(data == 32)
        self.text, self.start, self.end = text, spaces[:-1] + 1, spaces[1:]
        length = self.end - self.start
        self.word = ~((length == 1) & (data[self.start] == 10))
        self.own = spaces[:-1] < limit
        hashes = _word_hashes(data, self.start, self.end) if not len(length) or length.max() <= HASHED else _beginnings(text, self.start, self.end)
        seed = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
        self.hashes = _mixed(_mixed(hashes + length.astype(np.uint64)) + seed)

    def phrases(self, m: int, shorter: tuple[np.ndarray, np.ndarray] | None, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it may be one) of the phrase of m words at each place, from those of m - 1 words, which ``may`` be frequent."""
        if shorter is None:
            return self.hashes, self.word & may
        before, _ = shorter
        if len(before) < 2:
            return before[:0], np.zeros(0, bool)
        return _mixed(before[:-1] * np.uint64(_BASE) + self.hashes[m - 1 :]), may[:-1] & may[1:]


class Sketch:
    """Bits of two rows of cells: whether a cell's count reaches the threshold."""

    def __init__(self, cells: int, bits: list[np.ndarray]):
        self.cells, self.bits = cells, bits

    @staticmethod
    def places(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
        mask = np.uint64(cells - 1)
        return [(hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32)]

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for bits, at in zip(self.bits, self.places(hashes, self.cells), strict=True):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _frequent(words: _Words, sketches: list[Broadcast], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, hashes, whether all parts pass the sketches) for m up to ``most``; a phrase's own cells are looked up where there is a sketch for m words."""
    shorter, may = None, np.ones(len(words.hashes), bool)
    for m in range(1, most + 1):
        shorter = words.phrases(m, shorter, may)
        hashes, may = shorter
        if sketch := next((s.value for s in sketches[(m > 1) :][:1]), None):
            at = np.flatnonzero(may)
            may = may.copy()
            may[at] = sketch.passes(hashes[at])
        yield m, hashes, may


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(cells, prepend=0).astype("<u2")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 2).T.tobytes() + counts.astype(np.uint8).tobytes(), 1)


def _unpacked(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(piece), np.uint8)
    n = len(raw) // 3
    return np.cumsum(raw[:n].astype(np.uint32) + (raw[n : 2 * n].astype(np.uint32) << 8)), raw[2 * n :]


_PIECES = "row int, shard int, salt int, piece binary, lang string, n long"
_PIECES_ARROW = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("salt", pa.int32()), ("piece", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])


def _sketch_task(cells: int, salts: int, sizes: tuple[int, ...], sketches: list[Broadcast]):
    """Rows (lang, text) -> pieces of the sketch of phrases of ``sizes`` words, and for single words the number of all by language."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
        for row, at in enumerate(Sketch.places(hashes, cells)):
            at, n = np.unique(at, return_counts=True)
            edges = np.searchsorted(at, np.arange(0, cells + 1, SHARD_CELLS))
            full = np.flatnonzero(np.diff(edges))
            pieces = [_packed(at[edges[s] : edges[s + 1]] % SHARD_CELLS, np.minimum(n[edges[s] : edges[s + 1]], FULL)) for s in full]
            none = pa.nulls(len(full))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), row), pa.int32()), pa.array(full, pa.int32()), pa.array(np.full(len(full), salt), pa.int32()), pa.array(pieces, pa.binary()), none.cast(pa.string()), none.cast(pa.int64())], schema=_PIECES_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, totals = [], 0, {}
        for lang, text, limit in _chunks(batches):
            words = _Words(lang, text, limit)
            if sizes[0] == 1:
                totals[lang] = totals.get(lang, 0) + int((words.word & words.own).sum())
            for m, hashes, may in _frequent(words, sketches, sizes[-1]):
                if m in sizes:
                    held.append(hashes[may & words.own[: len(may)]])
                    size += len(held[-1])
            if size >= HELD:
                yield from send(held)
                held, size = [], 0
        yield from send(held)
        numbers, none = pa.array([-1] * len(totals), pa.int32()), pa.nulls(len(totals)).cast(pa.binary())
        shards = pa.array([zlib.crc32(lang.encode("utf-8", "surrogatepass")) % 1024 for lang in totals], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, shards, pa.array([0] * len(totals), pa.int32()), none, pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], schema=_PIECES_ARROW)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their keys (row, shard, salt) -> one piece for each key; rows of totals pass."""
    key, counts = None, None

    def piece() -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_pylist([{"row": key[0], "shard": key[1], "salt": key[2], "piece": _packed(at, counts[at])}], schema=_PIECES_ARROW)

    for b in batches:
        yield pa.RecordBatch.from_arrays(b.filter(pc.is_valid(b.column(4))).columns, schema=_PIECES_ARROW)
        for *k, packed in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
            if packed is None:
                continue
            if k != key:
                if key is not None:
                    yield piece()
                key, counts = k, np.zeros(SHARD_CELLS, np.uint16)
            at, n = _unpacked(packed)
            counts[at] = np.minimum(counts[at] + n, FULL)
    if key is not None:
        yield piece()


def _bits(least: int):
    """Pieces -> a bit for each cell of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for packed in b.column(2).to_pylist():
                counts = np.zeros(SHARD_CELLS, np.uint8)
                at, n = _unpacked(packed)
                counts[at] = n
                bits.append(np.packbits(counts >= min(least, FULL), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=["row", "shard", "bits"])

    return run


def _sketch(texts: DataFrame, expected: int, sizes: tuple[int, ...], sketches: list[Broadcast], least: int) -> tuple[Broadcast, DataFrame]:
    """The sketch of the phrases of ``sizes`` words, of some ``expected`` words in all, for every task, and (lang, n) of all words where single ones are among them."""
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells * PER_CELL < expected:
        cells *= 2
    salts = max(1, math.ceil(expected * len(sizes) / (cells * ADDED)))
    keys = ["row", "shard", "salt"]
    sent = texts.mapInArrow(_sketch_task(cells, salts, sizes, sketches), _PIECES)
    added = materialise(sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, _PIECES), "phrase-pieces")
    pieces = added.where("row >= 0")
    if salts > 1:
        pieces = pieces.withColumn("salt", F.lit(0)).repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(_added, _PIECES)
    found = pieces.select("row", "shard", "piece").mapInArrow(_bits(least), "row int, shard int, bits binary").toArrow()  # a bit a cell: at most 64 MB
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    for row, shard, packed in zip(*(c.to_pylist() for c in found.columns), strict=True):
        bits[row][shard * SHARD_CELLS // 8 : (shard + 1) * SHARD_CELLS // 8] = np.frombuffer(packed, np.uint8)
    totals = added.where("row < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return texts.sparkSession.sparkContext.broadcast(Sketch(cells, bits)), totals


_LISTS = "lang string, bucket int, counts binary"
_LISTS_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary())])


def _matches(phrases: list[bytes], texts: list[tuple[bytes, int]]) -> np.ndarray:
    """How often each phrase begins in the texts (text, limit) before their limits, overlapping matches included."""
    automaton = ahocorasick.Automaton()
    for n, p in enumerate(phrases):
        automaton.add_word(f" {p.decode('latin-1')} ", n)
    automaton.make_automaton()
    lengths, counts = np.array([len(p) + 2 for p in phrases]), np.zeros(len(phrases), np.int64)
    for text, limit in texts:
        found = np.fromiter(automaton.iter(text.decode("latin-1")), "i8,i8")
        ends, which = found["f0"], found["f1"]
        counts += np.bincount(which[ends - lengths[which] + 1 < limit], minlength=len(phrases))
    return counts


def _scan(sketches: list[Broadcast], most: int, buckets: int):
    """Rows (lang, text) -> counts of the phrases that no sketch rules out, as packed lists by a hash, for one stretch of a task's texts after another."""

    def sent(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        lists: dict[int, list[int]] = {}
        for n, p in enumerate(phrases):
            lists.setdefault(zlib.crc32(p) % buckets, []).append(n)
        # phrases hold no line feed, so the first two in a row end them
        packs = [zstandard.compress(b"\n".join([phrases[n] for n in at]) + b"\n\n" + counts[at].astype("<u4").tobytes(), 1) for at in lists.values()]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(packs), pa.string()), pa.array(list(lists), pa.int32()), pa.array(packs, pa.binary())], schema=_LISTS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[set[bytes], list[tuple[bytes, int]]]] = {}
        rows = size = stretch = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                found, texts = held.pop(lang)
                if found:
                    phrases = sorted(found)
                    yield sent(lang, phrases, _matches(phrases, texts))

        for lang, text, limit in _chunks(batches):
            words, (phrases, texts) = _Words(lang, text, limit), held.setdefault(lang, (set(), []))
            texts.append((text, limit))
            stretch += len(text)
            for m, _, may in _frequent(words, sketches, most):
                at = np.flatnonzero(may & words.own[: len(may)])
                new = {text[s:e] for s, e in zip(words.start[at].tolist(), words.end[at + m - 1].tolist(), strict=True)} - phrases
                phrases |= new
                rows, size = rows + len(new), size + sum(map(len, new))
            if rows > DICTIONARY_ROWS or size > DICTIONARY_BYTES or stretch > STRETCH:
                yield from counted()
                rows = size = stretch = 0
        yield from counted()

    return run


def _summed(least: int):
    """Lists in the order of their keys (lang, bucket) -> (lang, phrase, f) of the phrases that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            listed = [(p, f) for p, f in counts.items() if f >= least]
            for at in range(0, len(listed), 20_000):
                part = listed[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(part), pa.string()), pa.array([p for p, _ in part], pa.binary()).cast(pa.string()), pa.array([f for _, f in part], pa.int64())], names=["lang", "phrase", "f"])

        for b in batches:
            for *k, packed in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
                if k != key:
                    yield from rows()
                    key, counts = k, {}
                phrases, _, numbers = zstandard.decompress(packed).partition(b"\n\n")
                for p, n in zip(phrases.split(b"\n"), np.frombuffer(numbers, "<u4").tolist(), strict=True):
                    counts[p] = counts.get(p, 0) + n
        yield from rows()

    return run


def phrase_frequencies(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f), exact, of all phrases of up to ``most_words`` words, single ones too, that occur ``least`` times in a language, and
    (lang, n) of all words."""
    if not 2 <= most_words <= MOST_WORDS:
        raise ValueError(f"phrases have 2 to {MOST_WORDS} words")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    words, totals = _sketch(texts, int(size / 6), (1,), [], least)
    n = totals.agg(F.sum("n")).first()[0] or 0
    phrases, _ = _sketch(texts, n, tuple(range(2, most_words + 1)), [words], least)
    buckets = min(MOST_BUCKETS, max(16, n // BUCKET_WORDS))
    lists = texts.mapInArrow(_scan([words, phrases], most_words, buckets), _LISTS).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return materialise(lists.mapInArrow(_summed(least), "lang string, phrase string, f long"), "phrase-frequencies"), totals


def collocations(docs: DataFrame, top: int | None, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases, or all, best first.

    a counts the phrase, l and r the parts of the cut with the least score floor(2000000 a / (l + r)); a phrase that mostly occurs
    inside a longer one is left out.
    """
    f, totals = phrase_frequencies(docs, least, most_words)
    kept = f.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    kept = kept.where((F.col("m") > 1) & (F.col("f") >= least))
    joined = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "decimal(20,0)"
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as {wide}) * cast(2000000 as {wide})) div (cast(l as {wide}) + cast(r as {wide}))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = kept.where(F.col("m") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    inside = longer.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("inside"))
    free = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("inside").cast(wide), F.lit(0).cast(wide)) * 100 < F.col("a").cast(wide) * INSIDE)
    placed = free.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        placed = placed.where(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
