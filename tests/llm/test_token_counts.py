from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from vistrel.llm.queries import QUERIES, tokenizer_file
from vistrel.llm.token_counts import WORD_MARK, UnigramCounter, token_counts, unigram_vocabulary

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=WORD_MARK, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text or "").ids)


@pytest.fixture(scope="module")
def count():
    return reference(unigram_vocabulary(PATH))


def test_query(spark, sf_dir, count):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: count(t) for i, t in texts.items()}


def test_any_text(count):
    rng, counter = random.Random(1), UnigramCounter(unigram_vocabulary(PATH))
    for _ in range(5000):
        text = "".join(rng.choice("ab the▁ \n<0x41>éß中😀क्षİ\x01") for _ in range(rng.randint(0, 12)))
        assert counter.count(text) == count(text), text


def test_ties_and_unknown_characters():
    """Equal scores all over, and characters without a piece."""
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), WORD_MARK, "a", "b", "ab", "ba", "aba", "bab", WORD_MARK + "a"]
    for scores in ([-1.0] * len(pieces), [-float(len(p)) for p in pieces]):
        vocabulary = list(zip(pieces, scores, strict=True))
        exact, counter, rng = reference(vocabulary), UnigramCounter(vocabulary), random.Random(3)
        for _ in range(1500):
            text = "".join(rng.choice("abé z") for _ in range(rng.randint(0, 15)))
            assert counter.count(text) == exact(text), text


def test_edges(documents, edge_rows, count):
    got = token_counts(documents(edge_rows), PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), count(t)) for i, t in edge_rows)
    assert token_counts(documents(edge_rows).limit(0), PATH).count() == 0
