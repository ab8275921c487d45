from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vistrel.llm.packing import BestFit, WordEncoder, pack
from vistrel.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, tokenizer, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda p: p["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), size))
        for p in parts:
            part = np.array(ids[p["start"] : p["start"] + size], "<u4")
            assert (p["length"], p["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_query_is_whole_exact_and_dense(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    pieces = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    n = check(pieces, dict(zip(docs["doc_id"], docs["text"], strict=True)), tokenizer)
    assert n <= sum(p["length"] for p in pieces) / 2048 * 1.03 + 2


def test_edges(documents, edge_rows, tokenizer):
    rows = [r for r in dict(edge_rows).items()]
    pieces = pack(documents(rows), PATH, size=64, shard_pieces=100).collect()
    check(pieces, dict(rows), tokenizer, 64)
    assert pack(documents(rows).limit(0), PATH).count() == 0


def test_repeated_rows_are_packed_like_others(documents):
    assert pack(documents([(1, "a b"), (1, "a b")]), PATH).count() == 2


def test_encoder_equals_the_tokenizer(tokenizer):
    rng, encoder = random.Random(3), WordEncoder(PATH)
    letters = "aB'stREvmld019 \n\t.,!?-_<>|\"éÉßñ²½ªµ\xa0€“”…–İſŉαΣσ中́​\x85\x1c😀"
    for k in range(6000):
        text = "".join(rng.choice(letters if k % 2 else letters[:50]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_bounded_space_best_fit():
    rng = random.Random(1)
    for open_bins in (1, 2, 8):
        packer, fill, opened = BestFit(100, open_bins), defaultdict(int), {}
        for _ in range(500):
            length = rng.randint(1, 100)
            fits = {b: f for b, f in opened.items() if 100 - f >= length}
            number, offset = packer.place(length)
            assert offset == fill[number]
            if fits:
                assert fill[number] == max(fits.values())
            elif len(opened) == open_bins:
                closed = max(opened, key=lambda b: opened[b])
                del opened[next(b for b in opened if opened[b] == opened[closed] and b not in [k for s in packer.free for k in s])]
            fill[number] += length
            opened[number] = fill[number]
            if fill[number] == 100:
                del opened[number]
            assert packer.open == len(opened) <= open_bins


def test_repeated_rows_spread_over_shards(documents):
    got = pack(documents([(None, "")] * 3000, 4), PATH, shard_pieces=100).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["sequence_id"] >> 40] += 1
    assert len(got) == 3000 and len(sizes) == 30 and max(sizes.values()) < 160
