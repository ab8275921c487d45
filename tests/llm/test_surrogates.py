from __future__ import annotations

import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from vistrel.llm import surrogates
from vistrel.llm.queries import QUERIES
from vistrel.llm.surrogates import replace_personal_data, resolve

TEXT = (
    "Mr. Smith met MRS JONES and Mr. Smith. Госпожа Иванова wrote; κυρία Παππά too. Call +49 30 1234567 or (030) 555-1234, "
    "ssn 123-45-6789, card 4111 1111 1111 1111 or 4111111111111111, mail a.B@x.co and A.b@X.CO from 10.20.30.40"
)


def by_doc(df):
    return {r["doc_id"]: r for r in df.collect()}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10


def test_types_formats_and_coreference(documents):
    row = by_doc(replace_personal_data(documents([(1, TEXT), (2, "again Mr. Smith at a.b@x.co"), (3, "clean text 12.5 v1.2.3.4.5")]), "key"))
    assert set(row) == {1, 2}
    found = defaultdict(list)
    for e in row[1]["entities"]:
        found[e["kind"]].append((TEXT[e["start"] : e["end"]], e["surrogate"]))
    assert {k: [a for a, _ in v] for k, v in found.items()} == {
        "name": ["Smith", "JONES", "Smith", "Иванова", "Παππά"],
        "phone": ["+49 30 1234567", "(030) 555-1234"],
        "ssn": ["123-45-6789"],
        "card": ["4111 1111 1111 1111", "4111111111111111"],
        "email": ["a.B@x.co", "A.b@X.CO"],
        "ipv4": ["10.20.30.40"],
    }
    for pairs in found.values():
        for raw, new in pairs:
            assert raw != new
    shape = lambda s: re.sub(r"\d", "9", s)
    for kind in ("phone", "ssn", "card"):
        assert all(shape(a) == shape(b) for a, b in found[kind])
    names = found["name"]
    assert names[0][1] == names[2][1] and names[0][1].endswith("nor")
    assert names[1][1].isupper() and names[1][1].endswith("LIA")
    assert re.fullmatch("[А-Я][а-я]+лина", names[3][1]) and re.fullmatch("[Α-Ω][α-ως]+λια", names[4][1])
    cards = [re.sub(r"\D", "", b) for _, b in found["card"]]
    assert cards[0] == cards[1] and luhn(cards[0]) == 0
    assert found["email"][0][1].lower() == found["email"][1][1].lower() and found["email"][0][1].endswith(".example.net")
    assert all(0 < int(o) < 256 for o in found["ipv4"][0][1].split("."))
    text, at = "", 0
    for e in row[1]["entities"]:
        text += TEXT[at : e["start"]] + e["surrogate"]
        at = e["end"]
    assert row[1]["text"] == text + TEXT[at:]
    assert row[2]["entities"][0]["surrogate"] == names[0][1]


def test_another_key_gives_other_surrogates(documents):
    docs = documents([(1, TEXT)])
    one, other = (by_doc(replace_personal_data(docs, k))[1] for k in ("a", "b"))
    assert all(x["surrogate"] != y["surrogate"] for x, y in zip(one["entities"], other["entities"], strict=True))


def test_colliding_surrogates_are_resolved(spark, monkeypatch):
    """With two digits' space, many of sixty entities meet at first, also real ones; in the end none does."""
    from pyspark.sql import functions as F

    def narrow(key, kind, norm, gender, attempt):
        return F.lpad((F.abs(F.xxhash64(norm, attempt)) % 300).cast("string"), 3, "0")

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    entities = spark.createDataFrame([("ssn", f"{k:03d}", "open") for k in range(60)], "kind string, norm string, gender string")
    rows = resolve(entities, "key").collect()
    made = [r["surrogate"] for r in rows]
    assert len(rows) == len(set(made)) == 60 and not set(made) & {f"{k:03d}" for k in range(60)}


def test_edges(documents, edge_rows):
    hot = [(k, "write to someone@mail.example.com now") for k in range(300, 340)]
    got = replace_personal_data(documents([*edge_rows, *hot, (None, "x someone@mail.example.com")]), "key").collect()
    assert len(got) == 41 and len({r["entities"][0]["surrogate"] for r in got}) == 1
    assert replace_personal_data(documents(hot).limit(0), "key").count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op3_surrogates"](spark, sf_dir)
    email = re.compile(surrogates.EMAIL)
    rows = by_doc(got)
    assert {i for i, t in texts.items() if email.search(t)} <= set(rows)
    new, real = defaultdict(set), set()
    for i, r in rows.items():
        for e in r["entities"]:
            raw = texts[i][e["start"] : e["end"]]
            real.add((e["kind"], raw))
            new[e["kind"], raw].add(e["surrogate"])
    assert all(len(v) == 1 for v in new.values())
    made = {(k, *v) for (k, _), v in new.items()}
    assert len(made) == len(new) and not made & real
    assert not re.search("Python|Pandas|InArrow", got._jdf.queryExecution().toString())


def test_more_one_word_names_than_four_syllables_have_are_kept_apart(spark):
    from pyspark.sql import functions as F

    name = F.concat(F.lit("N"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    entities = spark.range(70_000).select(F.lit("name").alias("kind"), name.alias("norm"), F.lit("open").alias("gender"))
    got = resolve(entities, "key")
    assert got.count() == got.select("surrogate").distinct().count() == 70_000
    assert got.join(entities.select(F.col("norm").alias("surrogate")), "surrogate").isEmpty()


SHOWN = [
    ("Mr. John Smith called. Dr. John Smith, or Smith, is John. Prof. Smith too.", "person"),
    ("Ring +353 1 234 5678 or +49 30 123456, then +1 415 555 1234, (415) 555-1234 and 415-555-1234; +33 1 23 45 67 89.", "phone"),
    ("Write to jo.ann_7@corp.example, JO.ANN_7@CORP.EXAMPLE and bob@corp.example; \x01 and \x02 stay.", "email"),
]


def test_one_person_number_or_address_however_it_is_written(documents):
    rows = [(k, t) for k, (t, _) in enumerate(SHOWN)]
    got = by_doc(replace_personal_data(documents(rows), "key"))
    pairs = {k: [(t[e["start"] : e["end"]], e["surrogate"]) for e in got[k]["entities"]] for k, t in rows}
    people = pairs[0]
    assert [a for a, _ in people] == ["John", "Smith", "John", "Smith", "Smith", "John", "Smith"]
    john, smith = people[0][1], people[1][1]
    assert john != smith and [b for _, b in people] == [john, smith, john, smith, smith, john, smith]
    assert got[0]["text"] == SHOWN[0][0].replace("John", john).replace("Smith", smith)
    phones = dict(pairs[1])
    assert list(phones) == ["+353 1 234 5678", "+49 30 123456", "+1 415 555 1234", "(415) 555-1234", "415-555-1234", "+33 1 23 45 67 89"]
    for raw, new in phones.items():
        assert re.sub(r"\d", "9", raw) == re.sub(r"\d", "9", new) and raw != new
        if raw[0] == "+":
            assert raw.split()[0] == new.split()[0]
    national = {re.sub(r"\D", "", phones[p])[-10:] for p in list(phones)[2:5]}
    assert len(national) == 1
    mails = pairs[2]
    assert mails[0][1] == mails[1][1].lower() and mails[1][1].isupper() and mails[0][1].split("@")[1] == mails[2][1].split("@")[1]
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}_\d@[a-p]{8}\.example\.net", mails[0][1]) and re.fullmatch(r"[a-z]{3}@[a-p]{8}\.example\.net", mails[2][1])
    assert got[2]["text"].endswith("; \x01 and \x02 stay.")


def expected_entities(text):
    """Kind, start and end of what plain Python detects."""
    pattern = regex.compile(surrogates.ANY.replace("(?iu:", "(?i:"))
    found, names = [], set()
    for m in pattern.finditer(text):
        raw = m.group()
        kind = next((k for k, p in surrogates.KINDS if regex.fullmatch(p.replace("(?iu:", "(?i:"), raw)), "name")
        if kind != "name":
            found.append((kind, m.start(), m.end()))
            continue
        at = m.start() + raw.index(" ") + 1
        for part in raw[raw.index(" ") + 1 :].split(" "):
            pieces = [(m.start(), m.group()) for m in regex.finditer(r"\p{L}+", part) if len(m.group()) > 1]
            found += [("name", at + k, at + k + len(piece)) for k, piece in pieces]
            names.update(piece.lower() for _, piece in pieces)
            at += len(part) + 1
    edges = [0, *(x for m in pattern.finditer(text) for x in m.span()), len(text)]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        for word in regex.finditer(surrogates.WORD, text[a:b]):
            pieces = [m for m in regex.finditer(r"\p{L}+", word.group()) if regex.match(r"\p{Lu}\p{L}", m.group()) and m.group().lower() in names]
            found += [("name", a + word.start() + m.start(), a + word.start() + m.end()) for m in pieces]
    return sorted(found, key=lambda e: e[1])


def test_detection_is_that_of_plain_python(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: sorted(((e["kind"], e["start"], e["end"]) for e in r["entities"]), key=lambda e: e[1]) for r in QUERIES["op3_surrogates"](spark, sf_dir).collect()}
    expected = {i: found for i, t in texts.items() if (found := expected_entities(t))}
    assert got == expected and len(expected) > 10


def test_a_full_format_grows(spark):
    """More numbers than their length has: all of three digits and those between them."""
    entities = spark.range(1000).selectExpr("'ssn' AS kind", "lpad(id, 3, '0') AS norm", "'open' AS gender")
    rows = resolve(entities, "key").collect()
    made = [r["surrogate"] for r in rows]
    assert len(set(made)) == 1000 and not set(made) & {f"{k:03d}" for k in range(1000)}


def test_a_text_of_very_many_entities(documents):
    text = " ".join(f"u{k}@mail.example.com Mr. Na{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}" for k in range(6000))
    row = replace_personal_data(documents([(1, text)]), "key").first()
    assert row["n_entities"] == 12_000 and [text[e["start"] : e["end"]] for e in row["entities"][:2]] == ["u0@mail.example.com", "Naaku"]
    rebuilt, at = [], 0
    for e in row["entities"]:
        rebuilt += [text[at : e["start"]], e["surrogate"]]
        at = e["end"]
    assert row["text"] == "".join(rebuilt) + text[at:]


def test_possessives_hyphens_and_apostrophes(documents):
    """A possessive is no part of the name; hyphenated and apostrophe names keep their signs, single letters and case."""
    texts = ["Mr Smith's car and Smith’s dog. Mr. Smith came.", "Dr. Müller-Lüdenscheidt met Frau Müller and MR. O'BRIEN; O'Brien left.", "Mr James' hat, Mrs D'Angelo-Smith. Smith-like, Smith-Jones", "Herr Jean-luc Picard", "Mr X said so"]
    got = {r["doc_id"]: r for r in replace_personal_data(documents(list(enumerate(texts))), "k").collect()}
    smith = re.fullmatch(r"Mr (\w+)'s car and (\w+)’s dog\. Mr\. (\w+) came\.", got[0]["text"]).groups()
    assert len(set(smith)) == 1 and smith[0] != "Smith"
    double, first, single, upper, lower = re.fullmatch(r"Dr\. (\w+)-(\w+) met Frau (\w+) and MR\. O'(\w+); O'(\w+) left\.", got[1]["text"]).groups()
    assert double == single and first != double and upper.isupper() and upper.lower() == lower.lower() and lower.istitle()
    third = re.fullmatch(r"Mr (\w+)' hat, Mrs D'(\w+)-(\w+)\. (\w+)-like, (\w+)-Jones", got[2]["text"]).groups()
    assert third[2] == third[3] == third[4] == smith[0] and "James" not in third
    assert re.fullmatch(r"Herr [A-Z][a-z]+-[a-z]+ [A-Z][a-z]+", got[3]["text"]) and got[3]["n_entities"] == 3
    assert 4 not in got
    for k, r in got.items():
        assert all(texts[k][e["start"] : e["end"]].isalpha() for e in r["entities"])


def plain_surrogate(key, kind, norm, gender, attempt):
    """A surrogate's normal form, written out for names, numbers and addresses."""
    import hashlib

    stream = "".join(hashlib.sha256("\x1f".join((key, str(n), kind, norm, str(attempt))).encode()).hexdigest() for n in range(2))
    at = lambda k, width: int(stream[k : k + width], 16)
    if kind == "name":
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", norm) else "greek" if regex.search(r"\p{Greek}", norm) else "latin"
        ending = surrogates.ENDINGS[script][{"male": 0, "female": 1}.get(gender, 2)]
        syllables = surrogates.SYLLABLES[script]
        name = "".join(syllables[at(2 * k, 2) % len(syllables)] for k in range(min(attempt, 58) + 4)) + ending
        return name[0].upper() + name[1:].lower()
    if kind == "ipv4":
        return ".".join(str(at(k, 4) % 254 + 1) for k in (0, 4, 8, 12))
    if kind in ("ssn", "phone"):
        kept = len(re.match(surrogates.CODE, norm).group(1)) if kind == "phone" else 0
        n = min(len(norm) + max(attempt - surrogates.GROW, 0), 30)
        return "".join(norm[i] if i < kept else str(at(4 * i, 4) % 10) for i in range(n))
    local, domain = norm.split("@")
    drawn = lambda i: at(2 * (i % 60), 2)
    spelt = "".join(chr(drawn(i) % 26 + 97) if "a" <= c <= "z" else str(drawn(i) % 10) if c.isdigit() else c for i, c in enumerate(local))
    more = "".join(chr(drawn(i + len(local)) % 26 + 97) for i in range(1, attempt + 1))
    label = hashlib.sha256("\x1f".join((key, "domain", domain)).encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop"))
    return f"{spelt}{more}@{label}.example.net"


def test_surrogates_are_those_of_plain_python(spark):
    cases = [("name", "Smith", "male"), ("name", "Müller", "female"), ("name", "Иванов", "male"), ("name", "Παππά", "open"), ("ipv4", "10.0.0.1", "open"), ("ssn", "123456789", "open"), ("phone", "15551234567", "open"), ("phone", "442071234567", "open"), ("phone", "35312345678", "open"), ("email", "a.bc_7@example.org", "open"), ("email", "x@y.de", "open")]
    rows = [(k, n, g, a) for k, n, g in cases for a in (0, 1, 3, 6) if k != "ipv4" or a < 4]
    df = spark.createDataFrame(rows, "kind string, norm string, gender string, attempt int")
    made = df.select("*", surrogates.surrogate("key", *(F.col(c) for c in ("kind", "norm", "gender", "attempt"))).alias("s")).collect()
    for r in made:
        assert r["s"] == plain_surrogate("key", r["kind"], r["norm"], r["gender"], r["attempt"]), r
