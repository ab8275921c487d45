"""Collocations against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from tests.oracle import assert_same, connect
from vistrel.llm import collocations as c
from vistrel.llm.queries import ORACLES, QUERIES


def folded(text: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def plain_counts(rows, most=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(" ".join(words[k : k + m]) for k in range(len(words) - m + 1))
    return f, n


def plain(rows, top=2000, least=30):
    f, n = plain_counts(rows)
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and " " in p}
        dropped = set()
        for p, a in kept.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for k in range(len(w) - m + 1):
                    if 100 * a >= 80 * kept[" ".join(w[k : k + m])]:
                        dropped.add(" ".join(w[k : k + m]))
        scored = []
        for p, a in kept.items():
            if p in dropped:
                continue
            w = p.split(" ")
            cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
            scored.append((-score, -a, p.encode(), (left, right)))
        out += [(lang, r, p.decode(), -a, lr[0], lr[1], n[lang], -s) for r, (s, a, p, lr) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(spark, rows, top=2000, **more):
    full = [(k, t, lang, "s", 1, 9, "x", "y", 3) for k, (lang, t) in enumerate(rows)]
    df = spark.createDataFrame(full, f"{SCHEMA}, n long, phrase string, shard string, salt int").repartition(3)
    out = c.collocations(df, top, **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def invented(seed: int, rows: int, words: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" if k % 3 else f"Wö{k}" for k in range(40)]
    made = []
    for k in range(rows):
        parts = [rng.choice(vocabulary[: 6 + k % 30]) + rng.choice(["", "", "", ",", ".", " ", "\t", "\n"]) for _ in range(words)]
        for _ in range(3):
            parts.insert(rng.randrange(len(parts)), "alpha Beta  gamma\tdelta")
        made.append((("en", "de", None)[k % 3], " ".join(parts)))
    return made


def test_plain(spark):
    rows = invented(1, 60)
    assert got(spark, rows) == plain(rows)


def test_small_parts(spark, monkeypatch):
    """Chunks of a few words, a narrow sketch that lets almost all pass, a dictionary in many shards, many sends: the same rows."""
    monkeypatch.setattr(c, "DICTIONARY_ROWS", 60)
    monkeypatch.setattr(c, "LEAST_CELLS", 1 << 16)
    monkeypatch.setattr(c, "MOST_CELLS", 1 << 16)
    monkeypatch.setattr(c, "ADDED", 0.01)
    rows = invented(2, 24)
    assert got(spark, rows, least=12) == plain(rows, least=12)
    assert got(spark, rows, top=3, least=12) == plain(rows, top=3, least=12)


def test_one_scan_however_large_the_dictionary(spark, monkeypatch):
    """Texts are scanned once, not once for each part of the dictionary; stretches of one chunk count the same."""
    scans, scan = [], c._scan
    monkeypatch.setattr(c, "DICTIONARY_ROWS", 20)
    monkeypatch.setattr(c, "CHUNK", 3000)
    monkeypatch.setattr(c, "_scan", lambda *given: scans.append(1) or scan(*given))
    rows = invented(4, 24)
    assert got(spark, rows, least=12) == plain(rows, least=12)
    assert len(scans) == 1


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_chunks_count_each_place_once(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(c, "CHUNK", size)
    rows = invented(3, 4, 80)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    seen = defaultdict(Counter)
    for lang, text, limit in c._chunks(iter([batch])):
        words = c._Words(lang, text, limit)
        for m, _, may in c._frequent(words, [], 4):
            at = np.flatnonzero(may & words.own[: len(may)])
            seen[lang].update(text[s:e].decode() for s, e in zip(words.start[at], words.end[at + m - 1], strict=True))
    assert seen == plain_counts(rows)[0]


def test_hash_depends_on_the_phrase_alone():
    """A phrase has the same hash wherever it stands, also beside words that are longer than a hash looks at."""
    places = [" a bb ccc dd ", " zz a bb ccc ", " " + "q" * 5000 + " a bb ccc " + "r" * 3000 + " "]
    found = []
    for text in places:
        words = c._Words("en", text.encode(), len(text))
        at = text.split().index("a")
        found.append([int(h[at]) for m, h, _ in c._frequent(words, [], 3)])
    assert found[0] == found[1] == found[2]
    assert len(set(found[0])) == 3


def test_pieces_of_a_sketch_survive_packing():
    rng = np.random.default_rng(0)
    at = np.sort(rng.choice(c.SHARD_CELLS, 5000, replace=False)).astype(np.uint32)
    at[0], at[-1] = 0, c.SHARD_CELLS - 1
    n = rng.integers(1, 256, 5000)
    where, counts = c._unpacked(c._packed(at, n))
    assert (where == at).all() and (counts == n).all()


def test_edges(spark):
    """Nulls, blanks, overlapping repeats, pieces without words, words as long as texts, a text of a hundred thousand words, repeated rows."""
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t\n.,;:!? "), ("und", "x y"), (None, "X Y"), ("fr", "a\xa0b c"), ("xx", "İ I ı K")]
    rows += [("en", " ".join(["a"] * 90)), ("en", "a a a. a a, a"), ("en", "q" * 200_000 + " a a " + "q" * 200_000)]
    rows += [("de", " ".join(f"k{k % 50}" for k in range(100_000)))] + [("en", "The same row, the same row")] * 40 + [(None, "X Y z")] * 31
    assert got(spark, rows) == plain(rows)


def test_longer_phrases_are_refused(spark):
    with pytest.raises(ValueError, match="2 to 4 words"):
        got(spark, [("en", "a b")], most_words=5)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", None), (None, "")]) == []


def test_oracle(spark):
    """At the size of the smallest table few phrases are frequent, so the next one."""
    sf_dir = "/root/testdata/sf0.01"
    assert_same(QUERIES["op11_collocations"](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES["op11_collocations"]).df())
