"""Exact unigram token counts without tokens: Aho-Corasick matches and a Viterbi pass that carries best score and count.

The model is a unigram over the pieces of a vocabulary file: a piece's score is the log of its Zipf share by its place in the file, and
a character that is no piece costs UNKNOWN below the least score and counts as its UTF-8 bytes. A text gets a
word mark in front, spaces become word marks, and each stretch from a mark to the next is segmented alone. The
automaton gives every piece that ends at a place; among equal scores the piece that starts first wins, which is the
rule of the tokenizers library's unigram model, and sums are added in its order, so counts agree exactly.
A worker remembers the counts of stretches.

Null and empty texts count 0. Rows without an id and repeated rows are counted like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import bounded_batches

WORD_MARK, UNKNOWN = "▁", 10.0
CACHE_STRETCHES, CACHE_CHARS = 300_000, 64


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """All pieces of a sentencepiece file in their order with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = math.log(sum(1 / (r + 1) for r in range(model.get_piece_size())))
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(model.get_piece_size())]


class UnigramCounter:
    _shared: ClassVar[dict[str, UnigramCounter]] = {}

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        self.known: dict[str, int] = {}

    @classmethod
    def shared(cls, path: str) -> UnigramCounter:
        if path not in cls._shared:
            cls._shared[path] = cls(unigram_vocabulary(path))
        return cls._shared[path]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(" ", WORD_MARK).split(WORD_MARK)
        if not parts[0]:
            del parts[0]
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > CACHE_STRETCHES:
                known.clear()
            fresh = {p: self._stretch(WORD_MARK + p) for p in set(parts).difference(known)}
            known.update((p, n) for p, n in fresh.items() if len(p) <= CACHE_CHARS)
            return sum(known[p] if p in known else fresh[p] for p in parts)

    def _stretch(self, s: str) -> int:
        best, count = [0.0] + [None] * len(s), [0] * (len(s) + 1)
        singles, unknown = self.singles, self.unknown
        matches = self.automaton.iter(s)
        following = next(matches, None)
        for end in range(1, len(s) + 1):
            top, pieces, begin = None, 0, 0
            while following is not None and following[0] == end - 1:
                length, score = following[1]
                start = end - length
                total = score + best[start]
                if top is None or total > top or (total == top and start < begin):
                    top, pieces, begin = total, count[start] + 1, start
                following = next(matches, None)
            if s[end - 1] not in singles:
                total = unknown + best[end - 1]
                if top is None or total > top:
                    top, pieces = total, count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[-1]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.shared(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """A row per row of docs (columns doc_id, text): doc_id, n_tokens, n_chars."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts(vocabulary_path), "doc_id long, n_tokens long, n_chars long")
