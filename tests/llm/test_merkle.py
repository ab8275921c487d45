"""The manifest against one plain pass over all rows, and the monoid's laws."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tests.llm.conftest import SCHEMA
from vistrel.llm import merkle
from vistrel.llm.queries import op13_manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root and, for each leaf, its left and right siblings a level."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for n, at in enumerate(own):
            run = runs[at // 16]
            paths[n].append((run[: at % 16], run[at % 16 + 1 :]))
        own, level = [at // 16 for at in own], [h(*run) for run in runs]
    return level[0], paths


def plain(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], {}
    for s in order:
        ordered = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in ordered])
        subroots.append(root)
        inner[s] = (ordered, paths)
    root, outer = climb(subroots)
    out = []
    for n, s in enumerate(order):
        for r, path in zip(*inner[s], strict=True):
            path = path + outer[n]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            changed = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            value = leaf((r[0], changed, *r[2:])) if cut else leaf(r)
            for left, right in path:
                value = h(*left, value, *right)
            proof = h(*(x for left, right in path for x in (*left, *right)))
            out.append((r[0], leaf(r), subroots[n], root, proof, value, value == root))
    return sorted(out, key=str)


def got(spark, rows, monkeypatch, partitions=5):
    extra = [(*r, "x", 1, b"y") for r in rows]
    df = spark.createDataFrame(extra, f"{SCHEMA}, tree string, leaves long, digest binary").repartition(partitions)
    monkeypatch.setattr("vistrel.llm.queries.table", lambda *_: df)
    out = op13_manifest(spark, "")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(n: int, source) -> list[tuple]:
    return [(k, f"Text number {k}", "en", source(k), 10 + k) for k in range(n)]


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 2], [300, 5, 1, 40, *[1] * 18]])
def test_plain(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "PART_ROWS", 40)
    rows = [r for s, n in enumerate(sizes) for r in made(n, lambda _, s=s: f"s{s}")]
    rows = [(1000 * k + r[0], *r[1:]) for k, r in enumerate(rows)]
    assert got(spark, rows, monkeypatch) == plain(rows)


def test_blocks_and_rounds(spark, monkeypatch):
    """Trees over several blocks, whose nodes meet in more than one round."""
    monkeypatch.setattr(merkle, "ROUND_LEVELS", 1)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 1)
    rows = made(9000, lambda k: "hot" if k % 3 else None)
    random.Random(1).shuffle(rows)
    assert got(spark, rows, monkeypatch) == plain(rows)


def test_edges(spark, monkeypatch, edge_rows):
    """Nulls in each column, repeated rows and ids, sources that sort by bytes, one long text."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in edge_rows]
    rows += [(7, "A", None, None, None), (7, "A", None, None, None), (7, "B", "", "", 0), (-8, "é", "de", "ß", 1), (9, "z", "de", "Z", -1), (10, "y", "de", "\U0001f600", 2), (11, "y", "de", "～", 2)]
    assert got(spark, rows, monkeypatch) == plain(rows)


def test_empty(spark, monkeypatch):
    assert got(spark, [], monkeypatch) == []


def test_forest_is_associative():
    """However leaves are split and fragments merged, the same nodes come into being."""
    leaves = [("t", 1000, 0, k, hashlib.sha256(str(k).encode()).digest()) for k in range(1000)]
    whole = merkle.Forest().merge(leaves)
    for seed in range(5):
        rng = random.Random(seed)
        held = [merkle.Forest() for _ in range(7)]
        for node in leaves:
            rng.choice(held).add(*node)
        nodes = [n for f in held for n in f.made]
        while len(held) > 1:
            rng.shuffle(held)
            joined = held.pop().merge(held.pop().open())
            nodes += joined.made
            joined.made = []
            held.append(joined)
        assert sorted(set(nodes)) == sorted(whole.made)
        assert not list(held[0].open())


def test_a_proof_stands_alone(spark):
    """The proof of a row folds to the root without any other row; a changed digest in it does not."""
    df = spark.createDataFrame(made(200, lambda k: f"s{k % 3}"), SCHEMA)
    row = merkle.manifest(df).where("doc_id = 77").first()
    value, at = bytes.fromhex(row["leaf"]), 0
    for place, size in zip(row["steps"][::2], row["steps"][1::2], strict=True):
        others = row["proof"][at : at + 32 * (size - 1)]
        value, at = merkle.digest(others[: 32 * place] + value + others[32 * place :]), at + len(others)
    assert value.hex() == row["root"] and at == len(row["proof"])
    wrong = spark.createDataFrame([(row["leaf"], bytearray([row["proof"][0] ^ 1]) + row["proof"][1:], row["steps"])], "leaf string, proof binary, steps binary")
    assert merkle.fold(wrong, "leaf", "r").first()["r"] != row["root"]
