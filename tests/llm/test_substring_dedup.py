from __future__ import annotations

import random

from vistrel.llm import substring_dedup
from vistrel.llm.queries import QUERIES
from vistrel.llm.substring_dedup import MIN_WORDS, repeated_passages, sentences, shingles, units


def prose(rng, n):
    out, k = [], 0
    while k < n:
        size = rng.randint(6, 16)
        out.append(" ".join(f"w{rng.randint(0, 5000)}" for _ in range(size)).capitalize() + ".")
        k += size
    return out


def test_planted_passages_are_found_and_clean_documents_left_alone(documents):
    rng = random.Random(5)
    passages = [prose(rng, 60) for _ in range(6)]
    line = "This common line of exactly ten words stands in many."
    rows, holds = [], set()
    for k in range(80):
        s = prose(rng, 150) + [line]
        if k % 4 == 0:
            at = rng.randint(0, len(s) - 1)
            part = [p if rng.random() > 0.15 else p.replace("w1", "x1") for p in passages[k // 4 % 6]]
            s[at:at] = part
            holds.add(k)
        rows.append((k, " ".join(s)))
    got = repeated_passages(documents(rows, 4)).collect()
    assert {r["doc_id"] for r in got} == holds
    owners = {}
    for r in got:
        text = dict(rows)[r["doc_id"]][r["start"] : r["end"]]
        assert len(text.split()) >= r["words"] >= 24
        assert r["removed"] == bool(r["removals"])
        for x in r["removals"]:
            assert x["owner_doc_id"] < r["doc_id"] and r["start"] <= x["start"] < x["end"] <= r["end"]
            owners.setdefault(x["component"], set()).add(x["owner_doc_id"])
    assert len(owners) > 20 and all(len(o) == 1 for o in owners.values())


def test_every_removed_sentence_is_kept_somewhere(documents):
    rng = random.Random(6)
    shared = [prose(rng, 40) for _ in range(4)]
    rows = [(k, " ".join(shared[rng.randrange(4)] + prose(rng, 20) + shared[rng.randrange(4)])) for k in range(30)]
    left = dict(rows)
    for r in sorted(repeated_passages(documents(rows)).collect(), key=lambda r: -r["start"]):
        for x in sorted(r["removals"], key=lambda x: -x["start"]):
            left[r["doc_id"]] = left[r["doc_id"]][: x["start"]] + left[r["doc_id"]][x["end"] :]
    everything = " ".join(left.values())
    before = {" ".join(w) for _, t in rows for _, _, w in sentences(t)}
    assert all(s in everything.lower() for s in before)
    assert sum(map(len, left.values())) < 0.6 * sum(len(t) for _, t in rows)


def test_near_sentences_link_and_far_ones_do_not(documents):
    base = [f"a{k}" for k in range(40)]
    near, far = list(base), list(base)
    near[0] = "other"
    for k in range(0, 40, 4):
        far[k] = "other"
    rows = [(1, " ".join(base) + "."), (2, " ".join(near) + "."), (3, " ".join(far) + ".")]
    got = repeated_passages(documents(rows)).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and [x["owner_doc_id"] for r in got for x in r["removals"]] == [1]
    a, b = shingles(" ".join(base)), shingles(" ".join(near))
    assert len(a & b) / len(a | b) >= 0.8


def test_near_pairs_behind_an_unlike_leader_of_their_bucket_link(documents):
    """All sentences share 26 of 36 shingles, so loose buckets hold many of them and their leader is mostly unlike a pair."""
    common = [f"c{k}" for k in range(30)]
    rows = []
    for k in range(150):
        tail = [f"p{k}t{n}" for n in range(9)]
        rows += [(2 * k, " ".join([*common, *tail, "one."])), (2 * k + 1, " ".join([*common, *tail, "two."]))]
    got = repeated_passages(documents(rows, 4)).collect()
    assert {r["doc_id"] for r in got} == set(range(300))
    assert {(r["doc_id"], x["owner_doc_id"]) for r in got for x in r["removals"]} == {(2 * k + 1, 2 * k) for k in range(150)}


def verse(rng, n):
    return [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_passages_of_short_lines_are_found_whatever_short_lines_surround_them(documents):
    rng = random.Random(8)
    shared = [verse(rng, 20) for _ in range(3)]
    rows = [(k, "\n".join(verse(rng, rng.randint(1, 30)) + (shared[k % 3] if k % 2 else []) + verse(rng, rng.randint(1, 30)))) for k in range(40)]
    got = repeated_passages(documents(rows)).collect()
    assert {r["doc_id"] for r in got} == {k for k in range(40) if k % 2}
    left = dict(rows)
    for r in got:
        assert r["words"] >= len(" ".join(shared[r["doc_id"] % 3]).split()) - MIN_WORDS
        assert r["end"] - r["start"] <= len("\n".join(shared[r["doc_id"] % 3]))
        for x in sorted(r["removals"], key=lambda x: -x["start"]):
            left[r["doc_id"]] = left[r["doc_id"]][: x["start"]] + left[r["doc_id"]][x["end"] :]
    everything = "\n".join(left.values())
    assert all(line in everything for part in shared for line in part)
    assert sum(map(len, left.values())) < sum(len(t) for _, t in rows) - 0.8 * 17 * sum(len(" ".join(p)) for p in shared) / 3


def test_units_cover_every_run_of_short_sentences():
    rng = random.Random(9)
    for _ in range(300):
        found = list(sentences("\n".join(verse(rng, rng.randint(0, 6)) + ["a long line of eight words or more here"] * rng.randint(0, 1) + verse(rng, rng.randint(0, 6)))))
        covered, at = set(), []
        for first, last, words in units(found):
            assert len(words) >= MIN_WORDS and words == [w for s in found[first : last + 1] for w in s[2]]
            assert first == last or all(len(s[2]) < MIN_WORDS for s in found[first : last + 1])
            covered |= set(range(first, last + 1))
            at.append((first, last))
        assert len(at) == len(set(at))
        short = 0
        for n, s in enumerate([*found, (0, 0, [""] * MIN_WORDS)]):
            if len(s[2]) >= MIN_WORDS:
                assert short >= n or n - short == len(covered & set(range(short, n))) or sum(len(f[2]) for f in found[short:n]) < MIN_WORDS
                short = n + 1


def test_passages_of_a_script_without_spaces_are_found(documents):
    rng = random.Random(10)

    def line(n):
        return "".join(chr(rng.randint(0x4E00, 0x6E00)) for _ in range(n)) + "\u3002"

    shared = "".join(line(12) for _ in range(5))
    near = shared[:3] + "\u7000" + shared[4:]
    rows = [(1, line(30) + shared + line(20)), (2, shared), (3, line(40) + near), (4, "".join(line(15) for _ in range(8)))]
    got = repeated_passages(documents(rows)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    assert all(dict(rows)[r["doc_id"]][r["start"] : r["end"]][-30:] == shared[-30:] for r in got)


def test_recall_of_near_sentences_among_templated_strangers(documents):
    """Units of two alike sentences against brute force, where all strangers share a template (mutual similarity 0.7)."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(28)]
    rows, sets = [], []
    for k in range(400):
        tail = [f"t{rng.randint(0, 10**6)}" for _ in range(6)]
        for n in range(2 if k % 2 else 1):
            words = [*common, *tail[: 6 - n], *([f"v{rng.randint(0, 10**6)}"] * n)]
            rows.append((len(rows), " ".join(words) + "."))
            sets.append(shingles(" ".join(words)))
    planted = {(i, i + 1) for i in range(len(rows) - 1) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8}
    assert len(planted) > 150
    got = {r["doc_id"] for r in repeated_passages(documents(rows, 4)).collect()}
    assert sum(a in got and b in got for a, b in planted) >= 0.98 * len(planted)
    assert got <= {i for pair in planted for i in pair}


def test_edges(documents, edge_rows):
    got = repeated_passages(documents(edge_rows), passage_words=MIN_WORDS).collect()
    assert {r["doc_id"] for r in got} == set(range(100, 160)) and {x["owner_doc_id"] for r in got for x in r["removals"]} == {100}
    assert sum(not r["removed"] for r in got) == 1
    assert repeated_passages(documents(edge_rows).limit(0)).count() == 0


def test_sentence_places():
    text = " One two. Three\n\nfour!  Five"
    assert [(text[s:e].strip(), w) for s, e, w in sentences(text)] == [("One two.", ["one", "two."]), ("Three", ["three"]), ("four!", ["four!"]), ("Five", ["five"])]
    assert list(sentences(None)) == []


def test_query_finds_repeated_long_passages(spark):
    """Most documents that share fifty words in a row, whatever surrounds them."""
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seen: dict[tuple, set] = {}
    for i, w in texts.items():
        if len(set(w)) >= 30:
            for k in range(len(w) - 49):
                seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    repeated = set().union(*(s for s in seen.values() if len(s) > 1))
    got = {r["doc_id"] for r in QUERIES["op7_substring_dedup"](spark, d).collect()}
    assert len(repeated & got) >= 0.9 * len(repeated)


def test_pieces_of_long_sentences_make_up_the_text():
    """Cuts depend on the words around them alone, and places are those of the text, also in scripts without spaces."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    text = "  ".join(words).replace("w1", "W1")
    found = list(sentences(text))
    assert len(found) > 10 and [w for _, _, part in found for w in part] == words
    assert all(text[a:b].lower().split() == part for a, b, part in found)
    inner = {tuple(part) for _, _, part in found[1:-1]}
    other = {tuple(part) for _, _, part in sentences(" ".join(["x"] * 60 + words + ["y"] * 60))}
    assert inner <= other
    wide = "，".join(["这是一个没有句号的很长的句子我们来看看它怎么被切开"] * 3)
    assert all("".join(part) == wide[a:b] for a, b, part in sentences(wide)) and "".join(w for *_, part in sentences(wide) for w in part) == wide
    assert [len(part) for *_, part in sentences("same " * 100)] == [100]  # nothing tells its places apart
    assert [len(part) for *_, part in sentences(" ".join(words[:40]))] == [40]


def test_passages_in_text_without_sentence_ends(documents):
    """Forty documents of words alone, in pairs that share sixty words in a row; strangers beside them."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for pair in range(20):
        shared = words(60)
        rows += [(2 * pair + side, " ".join(words(rng.randint(40, 200)) + shared + words(rng.randint(40, 200)))) for side in (0, 1)]
    rows += [(100 + k, " ".join(words(250))) for k in range(20)]
    got = {r["doc_id"] for r in repeated_passages(documents(rows)).collect()}
    assert len(got & set(range(40))) >= 38 and not got & set(range(100, 120))


def test_units_carry_the_buckets_of_new_long_sentences():
    """One parse gives units and bands: a task's first sight of a long sentence has them, and near sentences share one."""
    import pyarrow as pa

    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words) + ". Short one.", " ".join(words) + ".", " ".join([*words[:-1], "other"]) + ".", " ".join(f"v{k}" for k in range(30)) + ".", "Verse of\nfew words\nin a\nline and\nanother one", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["row", "doc_id", "text"])
    rows = pa.Table.from_batches(substring_dedup._units(iter([batch]))).to_pylist()
    first, again, near, apart = (next(r["buckets"] for r in rows if r["row"] == k) for k in range(4))
    assert again == [] and len(first) == len(near) == len(apart) == substring_dedup.BANDS
    assert set(first) & set(near) and not set(first) & set(apart)
    assert all(r["buckets"] == [] for r in rows if r["row"] == 4)
