from __future__ import annotations

import random
import re

import pytest

from vistrel.llm.decontamination import contaminated, drop_contaminated
from vistrel.llm.queries import QUERIES


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(rows, items):
    """Best segment over all diagonals, for pairs that share a run of twelve tokens on one or more of them."""
    out = {}
    for i, t in rows:
        d = tokens(t)
        for j, u in items:
            b = tokens(u)
            best = 0
            for diagonal in range(-len(b) + 1, len(d)):
                run = 0
                for k in range(max(0, -diagonal), min(len(b), len(d) - diagonal)):
                    run = max(0, run + (1 if d[k + diagonal] == b[k] else -1))
                    best = max(best, run)
            if best >= min(12, 0.6 * len(b)):
                out[i, j] = best
    return out


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"b{rng.randint(0, 500)}" for _ in range(n))) for k, n in enumerate((16, 30, 55, 20))]
    return items, spark.createDataFrame([*items, (9, "too short to seed"), (10, None)], "item_id long, text string")


def test_substitutions_are_tolerated(documents, bench):
    rng, (items, table) = random.Random(2), bench
    rows, planted = [], set()
    for k in range(60):
        w = [f"d{rng.randint(0, 500)}" for _ in range(rng.randint(0, 120))]
        if k % 2:
            j, text = items[k % 4]
            part = text.split()
            for n in range(0 if k % 3 else rng.randrange(12), len(part), 12 if k % 3 == 0 else 10**6):
                part[n] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [p.upper() + rng.choice(["", ".", ","]) for p in part]
            planted.add((k, j))
        rows.append((k, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in contaminated(documents(rows), table).collect()}
    assert planted <= set(got)
    assert got == brute(rows, items)


def test_items_at_every_place_and_with_substitutions_are_found(spark, documents):
    rng = random.Random(4)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (1, 2, 3, 5, 7, 9, 10, 11, 12, 14)]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for j, text in items:
        for at in range(6):
            part = text.split()
            for n in range(at % 3 if j < 12 else 0):
                part[rng.randrange(len(part))] = "changed"
            rows.append((len(rows), " ".join([f"d{k}" for k in range(at)] + part + ["end"] * (at % 2))))
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in contaminated(documents(rows), table).collect()}
    assert got == brute(rows, items)
    assert len(got) > 40


def test_edges(documents, edge_rows, bench):
    items, table = bench
    docs = documents([*edge_rows, (50, items[2][1])])
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, table).collect()] == [(50, 2)]
    kept = drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert contaminated(docs.limit(0), table).count() == 0
    assert contaminated(docs, table.limit(0)).count() == 0


def test_rows_are_judged_by_their_own_text(documents, bench):
    items, table = bench
    rows = [(None, "a clean text without an id"), (None, "x " + items[1][1]), (7, "clean"), (7, items[1][1] + " y"), (8, "clean too")]
    docs = documents(rows)
    assert sorted(str(r["doc_id"]) for r in contaminated(docs, table).collect()) == ["7", "None"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_contaminated(docs, table).collect()) == [("7", "clean"), ("8", "clean too"), ("None", rows[0][1])]


def test_a_common_item_in_very_many_places_of_one_text(documents, bench):
    items, table = bench
    text = " ".join([items[0][1]] * 400)
    got = contaminated(documents([(1, text), (2, items[0][1])]), table).collect()
    assert {(r["doc_id"], r["item_id"], r["overlap"], r["matched"], r["token_start"]) for r in got} == {(1, 0, 16, 16, 0), (2, 0, 16, 16, 0)}


def test_query_finds_every_verbatim_item(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    held = {(i, j) for j, t in zip(items["item_id"], items["text"], strict=True) for i in docs["doc_id"][docs["text"].str.contains(t, regex=False)]}
    got = QUERIES["op6_decontamination"](spark, sf_dir)
    assert held <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
