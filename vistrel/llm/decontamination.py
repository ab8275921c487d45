"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-cased runs of letters and digits. A mask of ones and zeros lies over a window of tokens; the hash of the
tokens under its ones ignores the others, so a substituted token under a zero does not hide the window. Every window
of a benchmark item and of a document is hashed under every mask. A shared hash is a hit on a
diagonal, the difference of the two positions; along it the whole item is laid over the document, and the best
segment of matches minus mismatches is the overlap. An item is in a document from MIN_OVERLAP on, or from MIN_SHARE of
the item where that is less. Any run of SPAN common tokens has a hit.

Items of fewer than SHORT tokens are seeded by runs of as many tokens as each segment of theirs that is an overlap must hold in a
row, so none of their overlaps is missed; documents are hashed in runs of those lengths that such items have. Items
without tokens are in no document. Null texts count as empty. A null doc_id groups with itself, like any other id; repeated rows give
one result row. Items and ids may repeat, with other texts too: each text is judged by itself, results are by id pair.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import materialise

#: Windows of ten tokens with six ones: each inner position is a zero in one of the masks.
MASKS = ("1101100101", "1011010011", "1010111001")
SPAN = len(MASKS[0])
#: Tokens below which an item is seeded by plain runs.
SHORT = 12
#: Matches minus mismatches of a segment that is an overlap, or this share of the item's tokens.
MIN_OVERLAP, MIN_SHARE = 12, 0.6
#: Hash rows of the benchmark up to which its side is broadcast (each has 28 bytes); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _plain(tokens: int, min_overlap: int, min_share: float) -> str:
    """The mask of a short item: ones, as many as any segment that is an overlap has matches in a row."""
    need = max(1, math.ceil(min(min_overlap, tokens * min_share) - 1e-9))
    missed = max(0, (tokens - need) // 2)
    return "1" * min(tokens, math.ceil((need + missed) / (missed + 1)))


def _seeds(tokens: Column, masks: tuple[str, ...]) -> Column:
    """One hash per window and mask of one length: all windows of the first mask, then all of the second, and so on."""
    last = F.size(tokens) - len(masks[0])
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def under(mask: str) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + p) for p, bit in enumerate(mask) if bit == "1")))

    return F.flatten(F.array(*map(under, masks)))


def _exploded(df: DataFrame, masks: tuple[str, ...], place: str, *carried: str) -> DataFrame:
    """A row per window and mask with the columns ``carried``.

    The seeds are a column of their own before they are exploded, so the explosion and a broadcast join behind it compile
    into one loop, in which a carried array is a reference; only rows that meet a seed are ever written. A text
    without windows leaves a null seed, which no join matches; an inner explode would hash all windows a second
    time, in the filter that the optimizer infers from it.
    """
    windows = F.size("tokens") - len(masks[0]) + 1
    seeded = df.select("*", windows.alias("windows"), _seeds(F.col("tokens"), masks).alias("seeds"))
    return seeded.select(*carried, "windows", F.posexplode_outer("seeds").alias("k", "seed")).select(*carried, "seed", (F.col("k") % F.col("windows")).alias(place))


def _best_segment(same: Column) -> Column:
    """Best sum of a run where a match counts 1 and a mismatch -1."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, hit: Column) -> Column:
        run = F.greatest(s["run"] + F.when(hit, 1).otherwise(-1), F.lit(0))
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(same, zero, step, lambda s: s["best"])


def _hits(docs: DataFrame, benchmark: DataFrame, min_overlap: int, min_share: float) -> DataFrame:
    """(doc_id, text_hash, diagonal, part, item_id, item): each diagonal of a text with a hit, the text's tokens (hashed) that the
    item lies over there, and the item's.

    Where the seeds of the benchmark can be broadcast, a hit takes its part of the text along from the scan: no text is
    shuffled or read again, however many hits there are.
    """

    def hashed(words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(w))

    items = benchmark.select("item_id", hashed(_tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0).distinct()
    items = items.select("item_id", "tokens", F.xxhash64("item_id", "tokens").alias("item_key"), F.size("tokens").alias("size"))
    sizes = sorted(r["size"] for r in items.where(F.col("size") < SHORT).select("size").distinct().collect())  # fewer than SHORT
    plain: dict[str, list[int]] = {}
    for n in sizes:
        plain.setdefault(_plain(n, min_overlap, min_share), []).append(n)
    seeded = [(MASKS, items.where(F.col("size") >= SHORT)), *(((mask,), items.where(F.col("size").isin(of))) for mask, of in plain.items())]
    keys = reduce(DataFrame.unionByName, (_exploded(part, masks, "q", "item_key", "size") for masks, part in seeded)).where("seed is not null").distinct()
    whole = items.select("item_key", "item_id", F.col("tokens").alias("item"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), hashed(_tokens(F.col("text"))).alias("tokens"))

    diagonal = F.col("p") - F.col("q")
    by = ("doc_id", "text_hash", "item_key", "diagonal")
    part = F.slice("tokens", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("size") + F.least(F.col("diagonal"), F.lit(0)))

    def met(side: DataFrame, *carried: str) -> DataFrame:
        each = (_exploded(texts, masks, "p", "doc_id", "text_hash", *carried).join(side, "seed") for masks, _ in seeded)
        return reduce(DataFrame.unionByName, (e.select("doc_id", "text_hash", "item_key", "size", diagonal.alias("diagonal"), *carried) for e in each))

    if keys.count() <= BROADCAST_ROWS:
        hits = met(F.broadcast(keys), "tokens").select(*by, part.alias("part")).groupBy(*by).agg(F.first("part").alias("part"))
        return hits.join(F.broadcast(whole), "item_key")
    found = materialise(met(keys).distinct(), "hits")
    again = texts.join(found, (texts["text_hash"] == found["text_hash"]) & texts["doc_id"].eqNullSafe(found["doc_id"])).drop(found["doc_id"]).drop(found["text_hash"])
    return again.select(*by, part.alias("part")).join(whole, "item_key")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, overlap, matched, item_tokens, token_start) for each item that a row's text holds."""
    hits = _hits(docs, benchmark, min_overlap, min_share)
    same = F.zip_with("part", F.slice("item", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("part")), lambda a, b: a == b)
    laid = hits.select("doc_id", "text_hash", "item_id", F.greatest(F.col("diagonal"), F.lit(0)).alias("token_start"), F.size("item").alias("item_tokens"), same.alias("same"))
    scored = laid.select(*laid.columns[:-1], _best_segment(F.col("same")).alias("overlap"), F.size(F.filter("same", lambda s: s)).alias("matched"))
    return scored.where(F.col("overlap") >= F.least(F.lit(float(min_overlap)), F.col("item_tokens") * min_share))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, overlap, matched, item_tokens, token_start) for each item that a document holds."""
    best = F.max(F.struct("overlap", "matched", "item_tokens", (-F.col("token_start")).alias("back")))
    return (
        contaminated_rows(docs, benchmark, min_overlap, min_share)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("overlap", "matched", "item_tokens")), (-F.col("b.back")).cast("long").alias("token_start"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns are kept. Rows are told apart by id and text, so rows without an
    id or with another's are judged by themselves."""
    gone = contaminated_rows(docs, benchmark).select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["text_hash"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
