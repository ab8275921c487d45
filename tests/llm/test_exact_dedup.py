from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import assert_same, connect
from vistrel.llm.exact_dedup import drop_exact_copies, exact_groups
from vistrel.llm.queries import ORACLES, QUERIES
from vistrel.llm.radix import RadixTrie, common_prefix


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        members = groups[lowered(t)]
        keep = max((m for m in members if m is not None), default=None)
        out.append((i, keep, len(members), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_oracle(spark, sf_dir):
    assert_same(QUERIES["op5_exact_dedup"](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES["op5_exact_dedup"]).df())


def test_edges(documents, edge_rows):
    rows = [*edge_rows, (7, "ÄB"), (8, "äB"), (9, "Äb")]
    got = exact_groups(documents(rows, 5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_tiny_segments_and_tries_give_the_same(documents, edge_rows):
    got = exact_groups(documents(edge_rows, 3), segment_bytes=200, trie_bytes=500).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(edge_rows)


def test_rows_that_stay(documents, edge_rows):
    docs = documents(edge_rows, 4)
    kept = drop_exact_copies(docs, segment_bytes=300, trie_bytes=2000)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((lowered(r["text"]) for r in kept.collect())) == sorted({lowered(t) for _, t in edge_rows})
    assert {r["doc_id"] for r in kept.where("text like 'The same%'").collect()} == {159}
    assert kept.where("doc_id = 4").count() == 0 and kept.where("doc_id = 5").count() == 1
    assert kept.where("score = 0.5 and _length = 8").count() == kept.count()


def test_empty_table(documents):
    docs = documents([(1, "a")]).limit(0)
    assert exact_groups(docs).count() == 0 and drop_exact_copies(docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 9)), max_size=60), st.sampled_from([300, 900, 1 << 20]))
def test_trie_is_a_map(items, limit):
    """Also under limits at which subtrees spill, and spill again."""
    trie, expected = RadixTrie(lambda a, b: a + b, limit), defaultdict(int)
    for key, value in items:
        trie.insert(key * 3, value)
        expected[key * 3] += value
    assert dict(trie.items()) == dict(expected)


@given(st.binary(max_size=80), st.binary(max_size=80), st.integers(0, 80))
def test_common_prefix(a, b, n):
    b = a[:n] + b
    k = common_prefix(a, b)
    assert a[:k] == b[:k] and (k in (len(a), len(b)) or a[k] != b[k])


def test_hot_texts_are_merged_in_two_levels(documents, edge_rows):
    """Segments of a batch each, so the hot text has an owner in many; two copies make a text hot."""
    rows = [*edge_rows, *((1000 + k, "Hot Text" if k % 3 else f"text {k % 50}") for k in range(600))]
    docs = documents(rows, 30)
    got = exact_groups(docs, segment_bytes=1, trie_bytes=1 << 20, hot_copies=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = drop_exact_copies(docs, segment_bytes=1, hot_copies=2)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], lowered(r["text"])) for r in kept.collect()), key=str) == sorted({(keep, lowered(t)) for (_, t), (_, keep, *_) in zip(rows, sorted_like(rows), strict=True)}, key=str)


def sorted_like(rows):
    """brute() in the order of the rows."""
    largest = {}
    for i, t in rows:
        largest[lowered(t)] = max((x for x in (largest.get(lowered(t)), i) if x is not None), default=None)
    return [(i, largest[lowered(t)]) for i, t in rows]
