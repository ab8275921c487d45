"""Exact deduplication by Patricia-trie owners.

Texts are equal when they are identical after lower-casing A-Z. Each scan task builds a radix trie over the full
byte strings it reads (a segment of bounded size at a time) and keeps one owner row per distinct string, so a group
of copies shrinks to a row per segment before anything is shuffled. Owner rows then go to partitions by length and
content hash; there a second trie, which spills by subtree, merges the owners of all segments. Terminal nodes hold
the winning identifier, here the largest one.

A text with owners in more than HOT_COPIES segments is merged in two levels: its owners are dealt to as many parts as keep
each at HOT_COPIES, every part's trie gives one owner, and these meet in the merge of all. Which texts are dealt is
found by counting lengths and hashes; where more than BROADCAST_ROWS are that frequent, the most frequent are dealt. It changes
no result, only which tasks do the work.

Null texts count as empty. Null ids lose to all others; repeated rows of one id and text are one group, counted
row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrel.llm.common import bounded_batches, free_name, materialise
from vistrel.llm.radix import RadixTrie

#: Bytes of text in one segment of a scan task, and bytes that a merging trie holds before it spills.
SEGMENT_BYTES, TRIE_BYTES = 48 << 20, 96 << 20
#: Segments with a text from which its owners are merged in two levels, and how many such texts are sent to each task (24 bytes each).
HOT_COPIES, BROADCAST_ROWS = 1024, 500_000


def _key(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _later(a: int | None, b: int | None) -> bool:
    """Whether id a wins over id b."""
    return b is None or (a is not None and a > b)


def _merge_rows(old: list, new: list) -> list:
    """Values are [best id, its row, count, rows]; the first of equal ids stays."""
    if _later(new[0], old[0]) and not (new[0] is None and old[0] is None):
        old[0], old[1] = new[0], new[1]
    old[2] += new[2]
    old[3] += new[3]
    return old


def _content_hash(key: bytes) -> int:
    return struct.unpack("<q", hashlib.blake2b(key, digest_size=8).digest())[0]


def _segments(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _local_classes(limit: int):
    """(doc_id, text) -> a row per document; the row of a segment's owner also carries the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 34, 0
        for held in _segments(batches, "text", limit):
            trie = RadixTrie(_merge_rows, 4 * limit)
            ids = [i for b in held for i in b.column(0).to_pylist()]
            shas: list[str] = []
            row = 0
            for b in held:
                for t in b.column(1).to_pylist():
                    key = _key(t)
                    shas.append(hashlib.sha256(key).hexdigest())
                    trie.insert(key, [ids[row], row, 1, [row]])
                    row += 1
            local, texts, sizes, hashes, counts = [0] * row, [None] * row, [None] * row, [None] * row, [None] * row
            for n, (key, (_, best, count, rows)) in enumerate(trie.items()):
                for r in rows:
                    local[r] = base + used + n
                texts[best], sizes[best], hashes[best], counts[best] = key, len(key), _content_hash(key), count
            used += row
            for at in range(0, row, 2000):
                part = slice(at, at + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part], pa.int64()), pa.array(shas[part], pa.string()), pa.array(local[part], pa.int64()), pa.array(texts[part], pa.binary()), pa.array(sizes[part], pa.int64()), pa.array(hashes[part], pa.int64()), pa.array(counts[part], pa.int64())],
                    names=["doc_id", "text_sha256", "local_id", "owner_text", "length", "content_hash", "copies"],
                )

    return run


_LOCAL = "doc_id long, text_sha256 string, local_id long, owner_text binary, length long, content_hash long, copies long"


def _merge_owners(limit: int):
    """Owner rows of a partition -> (local_id, keep_id, group_size) for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(_merge_rows, limit)
        for b in batches:
            for i, local, key, n in zip(*(b.column(k).to_pylist() for k in ("doc_id", "local_id", "owner_text", "copies")), strict=True):
                trie.insert(key, [i, local, n, [local]])
        out: list[tuple] = []
        names, kinds = ["local_id", "keep_id", "group_size"], [pa.int64()] * 3

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for _, (best, _, count, members) in trie.items():
            out.extend((m, best, count) for m in members)
            if len(out) >= 5000:
                yield packed()
                out = []
        if out:
            yield packed()

    return run


def _first_owners(limit: int):
    """Owner rows of a part -> the same rows with their part's owner of the string in ``head``; only its row keeps the text, with all copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(_merge_rows, limit)
        for b in batches:
            for i, local, key, n in zip(*(b.column(k).to_pylist() for k in ("doc_id", "local_id", "owner_text", "copies")), strict=True):
                trie.insert(key, [i, local, n, [local]])
        for key, (best, head, count, members) in trie.items():
            texts = [key if m == head else None for m in members]
            yield pa.RecordBatch.from_arrays(
                [pa.array([best] * len(members), pa.int64()), pa.array(members, pa.int64()), pa.array([head] * len(members), pa.int64()), pa.array(texts, pa.binary()), pa.array([count] * len(members), pa.int64()), pa.array([len(key)] * len(members), pa.int64()), pa.array([_content_hash(key)] * len(members), pa.int64())],
                names=["doc_id", "local_id", "head", "owner_text", "copies", "length", "content_hash"],
            )

    return run


_FIRST = "doc_id long, local_id long, head long, owner_text binary, copies long, length long, content_hash long"


def _hot(owners: DataFrame, length: str, content_hash: str, copies: int) -> DataFrame | None:
    """The texts of more than ``copies`` owner rows, by length and hash, with the number of parts to deal them to; None without any."""
    counts = owners.groupBy(length, content_hash).agg(F.count("*").alias("_n")).where(F.col("_n") > copies)
    hot = counts.orderBy(F.desc("_n"), length, content_hash).limit(BROADCAST_ROWS).select(length, content_hash, F.ceil(F.col("_n") / copies).alias("_parts"))
    hot = materialise(hot, "exact-hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def exact_groups(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, trie_bytes: int = TRIE_BYTES, hot_copies: int = HOT_COPIES) -> DataFrame:
    """A row per row of docs (columns doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    bounded_batches(docs.sparkSession)
    local = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_local_classes(segment_bytes), _LOCAL), "exact-local")
    columns = ["doc_id", "local_id", "owner_text", "copies", "length", "content_hash"]
    owners = local.where("owner_text is not null").select(columns)

    def merged(rows: DataFrame) -> DataFrame:
        return rows.repartition("length", "content_hash").mapInArrow(_merge_owners(trie_bytes), "local_id long, keep_id long, group_size long")

    hot = _hot(local.where("length is not null"), "length", "content_hash", hot_copies)
    if hot is None:
        found = merged(owners)
    else:
        dealt = owners.join(hot, ["length", "content_hash"]).withColumn("_part", F.pmod(F.xxhash64("local_id"), "_parts"))
        first = materialise(dealt.repartition("length", "content_hash", "_part").select(columns).mapInArrow(_first_owners(trie_bytes), _FIRST), "exact-first")
        heads = first.where("owner_text is not null").select(columns)
        by_head = materialise(merged(owners.join(hot, ["length", "content_hash"], "left_anti").select(columns).unionByName(heads)), "exact-merged")
        members = first.where("local_id <> head").select(F.col("local_id").alias("member"), F.col("head").alias("local_id"))
        found = by_head.unionByName(members.join(by_head, "local_id").select(F.col("member").alias("local_id"), "keep_id", "group_size"))
    return (
        local.select("doc_id", "text_sha256", "local_id")
        .join(found, "local_id")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def _local_owners(text: str, doc_id: str, limit: int):
    """Whole rows -> the owner row of each distinct string of a segment, with length and content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _segments(batches, text, limit):
            trie = RadixTrie(_merge_rows, 4 * limit)
            rows = pa.Table.from_batches(held)
            for row, (i, t) in enumerate(zip(rows.column(doc_id).to_pylist(), rows.column(text).to_pylist(), strict=True)):
                trie.insert(_key(t), [i, row, 1, []])
            best = sorted((row, len(key), _content_hash(key)) for key, (_, row, _, _) in trie.items())
            out = rows.take(pa.array([b[0] for b in best], pa.int64()))
            for k in (1, 2):
                out = out.append_column(f"_{k}", pa.array([b[k] for b in best], pa.int64()))
            yield from out.to_batches(max_chunksize=1000)

    return run


def _winning_rows(text: str, doc_id: str, limit: int, keep: int = 0):
    """Owner rows of a partition -> the winning row of each string, with ``keep`` of its two last columns; rows wait in a local file meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at, sink = RadixTrie(_merge_rows, limit), 0, None
        with tempfile.TemporaryFile() as f:
            for b in batches:
                if sink is None:
                    sink = pa.ipc.new_stream(f, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                sink.write_batch(b)
                for i, t in zip(b.column(b.schema.get_field_index(doc_id)).to_pylist(), b.column(b.schema.get_field_index(text)).to_pylist(), strict=True):
                    trie.insert(_key(t), [i, at, 1, []])
                    at += 1
            if sink is None:
                return
            sink.close()
            wins = bytearray(at)
            for _, (_, row, _, _) in trie.items():
                wins[row] = 1
            f.seek(0)
            at = 0
            for b in pa.ipc.open_stream(f):
                mask = pa.array([bool(x) for x in wins[at : at + b.num_rows]], pa.bool_())
                at += b.num_rows
                if pc.any(mask).as_py():
                    yield b.filter(mask).select(range(b.num_columns - 2 + keep))

    return run


def drop_exact_copies(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, trie_bytes: int = TRIE_BYTES, hot_copies: int = HOT_COPIES) -> DataFrame:
    """docs without copies: of equal texts one row, that of the largest doc_id, stays; all columns are kept."""
    bounded_batches(docs.sparkSession)
    extra = [free_name(docs, "_length"), free_name(docs, "_content_hash")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in extra)])
    local = _local_owners("text", "doc_id", segment_bytes)
    renamed = [f.name for f in schema.fields]
    owners = materialise(docs.mapInArrow(lambda it: (b.rename_columns(renamed) for b in local(it)), schema), "exact-owners")
    hot = _hot(owners, *extra, hot_copies)
    if hot is not None:
        at = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), "_parts")
        part = free_name(owners, "_part")
        dealt = owners.join(hot, extra).withColumn(part, at).repartition(*extra, part).select(renamed)
        first = dealt.mapInArrow(_winning_rows("text", "doc_id", trie_bytes, keep=2), schema)
        owners = owners.join(hot, extra, "left_anti").select(renamed).unionByName(first)
    return owners.repartition(*extra).mapInArrow(_winning_rows("text", "doc_id", trie_bytes), docs.schema)
