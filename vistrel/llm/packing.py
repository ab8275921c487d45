"""Bounded-space online best-fit packing of token sequences.

A document becomes the ids of its text and an end mark; only longer ones than a sequence are cut. Pieces are dealt to
shards of a fixed mean size by a hash of their identity and their row's number, so repeated rows spread like any others, and meet their
shard's packer longest first. The packer holds
a fixed number of open bins in a bitset keyed by free space: a piece goes to the fullest bin that takes it; where none
does, a new bin opens, and if that is one too many the fullest open bin closes. Memory is the open bins, whatever the
shard's size. With half as many open bins as a shard has pieces, hardly a bin closes early, and what is lost is less
than a sequence or two a shard.

Null texts count as empty and give the end mark alone. Repeated rows are packed like any others.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import bounded_batches, materialise

#: Tokens of a sequence, the end mark, open bins of a shard, and pieces that a shard gets on average.
SEQUENCE, END_ID, OPEN_BINS, SHARD_PIECES = 2048, 0, 1 << 14, 1 << 15
#: Distinct words of which a worker remembers the ids.
CACHE_WORDS = 300_000

#: Texts of these characters alone are split here; all others go to the tokenizer whole. Within them lower-casing is
#: a character's own affair, nothing composes, and letters, numbers and white space are the ranges below.
_PLAIN = re.compile("[\t\n\r -~\xa0-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Token ids of texts under a lower-casing BPE that drops white space, word by word with a memory of words.

    The tokenizer's merges never cross a word, so the ids of a text are those of its words in a row. The tests
    compare this with the tokenizer itself.
    """

    _shared: ClassVar[dict[str, WordEncoder]] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One encoder for all tasks of a worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        known = self.known
        words = _WORD.findall(text.lower())
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for word in set(words).difference(known):
                known[word] = self._word(word)
            return b"".join(map(known.__getitem__, words))

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(self.letters[b] for b in word.encode())
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.shared(path), END_ID.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 34
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row += 1
                ids = encoder.encode(text or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((i, n, at // 4, len(part) // 4, zlib.crc32(part), row))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )

    return run


class BestFit:
    """Bounded-space online best fit. ``place`` gives a bin's number and the offset in it."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = [[] for _ in range(size + 1)]  # open bins by free space
        self.bits, self.open, self.made = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.made, self.size
            self.made += 1
        if left := space - length:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return number


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, last = BestFit(size, open_bins), None
        for b in batches:
            sequence, offset = [], []
            for shard, length in zip(b.column(6).to_pylist(), b.column(3).to_pylist(), strict=True):
                if shard != last:  # several shards may share a task
                    packer, last = BestFit(size, open_bins), shard
                number, at = packer.place(length)
                sequence.append(shard << 40 | number)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per piece of docs (columns doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    pieces = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_cut(tokenizer_path, size), _PIECES), "pieces")
    shards = max(1, round(pieces.count() / shard_pieces))
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32", "row")
    return (
        pieces.withColumn("shard", F.pmod(mixed, F.lit(shards)))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "ids_crc32", "row")
        .mapInArrow(_pack(size, open_bins), _PACKED)
    )
