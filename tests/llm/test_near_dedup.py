from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vistrel.llm import near_dedup
from vistrel.llm.common import materialise
from vistrel.llm.components import connected_components
from vistrel.llm.near_dedup import LEAST_MATCHES, drop_near_copies, near_components
from vistrel.llm.queries import QUERIES


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by_shingle = defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by_shingle[x]).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            by_shingle[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def agree(df, rows):
    expected = brute(rows)
    for r in df.collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    agree(QUERIES["op9_near_dedup"](spark, sf_dir), [tuple(r) for r in docs])


def test_edges(documents, edge_rows):
    agree(near_components(documents(edge_rows)), [r for r in edge_rows if r[0] is not None])
    assert near_components(documents(edge_rows).limit(0)).count() == 0
    docs = documents(edge_rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("text like 'The same%'").count() == 1


def group(rng, n, words, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("pairs_per_row", [0, 1, 1000])
def test_group_of_near_copies_below_and_above_the_threshold(documents, monkeypatch, pairs_per_row):
    """Many members that only some others link to, and blocks so small that the search across components is split.
    Survivors are all confirmed within blocks with texts, or some, or none."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", pairs_per_row)
    monkeypatch.setattr(near_dedup, "BLOCK_OUT", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_ALL", 32)
    rng = random.Random(4)
    texts = group(rng, 160, 80, 7) + group(rng, 60, 120, 10) + group(rng, 40, 9, 2)
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    agree(near_components(documents(rows, 4)), rows)


def test_unlinked_followers_of_a_leader_are_searched_without_their_texts(spark, documents, monkeypatch):
    """Documents that share a long boilerplate and little else: blocks carry signatures, and pairs are found behind the leader."""
    rng = random.Random(7)
    boiler = " ".join(f"b{k}" for k in range(100))
    texts = []
    for k in range(400):
        own = [f"o{rng.randint(0, 10**6)}" for _ in range(60)]
        texts.append(boiler + " " + " ".join(own))
        if k % 40 == 0:
            own[0] = "changed"
            texts.append(boiler + " " + " ".join(own))
    rows = list(enumerate(texts, 1))
    written = []
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label: (written.append((label, df.columns)), materialise(df, label))[1])
    agree(near_components(documents(rows, 4)), rows)
    assert "near-dense" not in [label for label, _ in written]
    assert all("text" not in columns for _, columns in written)


def test_a_copy_without_an_id_before_one_with_an_id(documents):
    rows = [(None, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "a b c d e f g h"), (5, "a b c d e f g h i j k l m n o p q r s t u v w")]
    rows.append((6, rows[-1][1] + " x"))
    agree(near_components(documents(rows, 1)), [r for r in rows if r[0] is not None])


def test_pruning_gives_up_little():
    """Signatures of pairs right at the threshold pass the test almost surely; those far below seldom."""
    rng = np.random.default_rng(1)

    def share(similarity):
        same = rng.random((20_000, near_dedup.HASHES)) < similarity
        return len(near_dedup.survivors(same.astype(int), np.ones_like(same, int))) / len(same)

    assert share(0.85) > 0.9995 and share(0.5) < 0.001
    assert [n for n, _ in LEAST_MATCHES][-1] == near_dedup.HASHES


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 1000 for k in range(1000, 1100)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
