"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, social security numbers, phone numbers, card numbers and names after a form
of address. An entity is its kind and normal form, so one entity gets the same surrogate wherever and however it is written:

* addresses in lower case; the surrogate keeps the local part's pattern of letters, digits and signs and moves to a reserved domain, the same
  for all addresses of a domain;
* phone numbers with their country code, which stays. Numbers in the two North American ways without a code have code 1;
* other numbers as their digits; digits and separators stay in place, card numbers keep whether they pass the Luhn test, octets stay octets;
* names part by part, so a person keeps the same parts after any title, with or without a given name, and where a document repeats
  a part of a name it has shown after a title. The pieces of a hyphenated or apostrophe name are parts of their own, so the signs stay,
  as do single letters and a possessive ending. Script, capitals and title stay; the ending follows the gender of the
  titles that the part stands after, if they agree.

Distinctness is checked, not hoped for: of entities that meet in a surrogate, and of those whose surrogate is another real entity, all but
the least get the next surrogate of their sequence, until none meets another. Surrogates get longer from attempt to attempt
(numbers and octets from attempt GROW on), so no format can run out. Entities are counted and compared as table rows, so a
frequent one costs a row. Documents without an entity are left alone and are not in the result.

Work is linear in a text's length and n log n in its entities. Null texts count as empty. Rows without an id and repeated rows are
treated like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import drop_tables, materialise
from vistrel.llm.matches import texts_and_matches, totals

#: Patterns by kind, the first that fits wins.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)"
PHONE = r"\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]*\d)"
CARD = r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-]*\d)"
MALE, FEMALE, OPEN = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"), ("Dr", "Prof")
JOINED = r"(?:-\p{L}+|['’](?![sS](?!\p{L}))\p{L}+)"
PART = rf"\p{{Lu}}(?:\p{{L}}+{JOINED}*|{JOINED}+)"
NAME = rf"(?<!\p{{L}})(?iu:{'|'.join((*MALE, *FEMALE, *OPEN))})\.? {PART}(?: {PART})?"
WORD = rf"(?<![\p{{L}}'’-]){PART}"
#: Calling codes; those with three digits are the rest.
CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
KINDS = (("email", EMAIL), ("ipv4", IPV4), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("name", NAME))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: Syllables of surrogate names by script, and what ends a given name of each gender.
SYLLABLES = {
    "latin": ("ba", "do", "fe", "ga", "li", "ma", "no", "pe", "ra", "sa", "to", "ve", "wi", "ze", "ka", "lu"),
    "cyrillic": ("ба", "до", "фе", "га", "ли", "ма", "но", "пе", "ра", "са", "то", "ве", "ви", "зе", "ка", "лу"),
    "greek": ("βα", "δο", "φε", "γα", "λι", "μα", "νο", "πε", "ρα", "σα", "το", "βε", "θι", "ζε", "κα", "λου"),
}
ENDINGS = {"latin": ("nor", "lia", "rin"), "cyrillic": ("нов", "лина", "рин"), "greek": ("νος", "λια", "ριν")}
#: Attempts after which numbers get a digit more each time. Names of a document up to which its words are looked up before they are joined.
GROW, FEW_NAMES = 4, 32


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(raw: Column) -> Column:
    title = F.lower(F.regexp_replace(F.regexp_extract(raw, r"^(\S+) ", 1), r"\.", ""))
    return F.when(title.isin(*map(str.lower, MALE)), "male").when(title.isin(*map(str.lower, FEMALE)), "female")


def _segment(text: Column, kind: Column | None = None, norm: Column | None = None, gender: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(text.alias("t"), (none if kind is None else kind).alias("kind"), (none if norm is None else norm).alias("norm"), (none if gender is None else gender).alias("gender"))


def _segments(raw: Column) -> Column:
    """A match as segments: the parts of a name with what stands before each, anything else whole."""
    kind = F.coalesce(*(F.when(raw.rlike(f"^(?:{p})$"), k) for k, p in KINDS), F.lit("name"))
    phone = F.when(raw.startswith("+"), _digits(raw)).otherwise(F.concat(F.lit("1"), _digits(raw)))
    norm = F.when(kind == "email", F.lower(raw)).when(kind == "ipv4", raw).when(kind == "phone", phone).otherwise(_digits(raw))
    parts = F.split(F.regexp_replace(raw, r"^\S+ ", ""), " ")
    title = F.regexp_extract(raw, r"^(\S+ )", 1)
    named = F.flatten(F.transform(parts, lambda p, i: F.concat(F.array(_segment(F.when(i == 0, title).otherwise(" "))), _pieces(p, lambda x: _segment(x, F.when(F.length(x) > 1, "name"), F.initcap(x), _gender(raw))))))
    return F.when(kind == "name", named).otherwise(F.array(_segment(raw, kind, norm)))


def _pieces(part: Column, made: Callable[[Column], Column]) -> Column:
    """The pieces of a part of a name as segments, with the signs between them."""
    found, around = F.regexp_extract_all(part, F.lit(r"\p{L}+"), F.lit(0)), F.split(part, r"\p{L}+", -1)
    return F.flatten(F.zip_with(F.slice(around, 1, F.size(found)), found, lambda sign, x: F.array(_segment(sign), made(x))))


def _words(text: Column, names: Column) -> Column:
    """A text between matches as segments, its capitalised words on their own: they may be parts of the document's names."""
    found, around = texts_and_matches(text, WORD)

    def word(w: Column) -> Column:
        known = (F.length(w) > 1) & w.rlike(r"^\p{Lu}") & ((F.size(names) > FEW_NAMES) | F.array_contains(names, F.initcap(w)))
        return _segment(w, F.when(known, F.lit("word")), F.initcap(w))

    each = F.zip_with(found, F.slice(around, 1, F.size(found)), lambda w, t: F.concat(F.array(_segment(t)), _pieces(w, word)))
    return F.concat(F.flatten(each), F.array(_segment(F.element_at(around, -1))))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can foresee."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(n)), kind, norm, attempt.cast("string")), 256) for n in range(2)))


def _at(stream: Column, at: Column, width: int) -> Column:
    return F.conv(stream.substr(at, F.lit(width)), 16, 10).cast("long")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test over a string of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(places, F.lit(0), lambda s, p: s + F.when(p["i"] % 2 == 0, p["d"]).otherwise(F.when(p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"])))


def _more(attempt: Column) -> Column:
    return F.greatest(attempt - GROW, F.lit(0))


def _new_digits(stream: Column, norm: Column, kept: Column, attempt: Column) -> Column:
    """As many digits as norm has, and more in late attempts; the first ``kept`` stay."""
    n = F.least(F.length(norm) + _more(attempt), F.lit(30))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i <= kept, norm.substr(i, F.lit(1))).otherwise((_at(stream, i * 4 - 3, 4) % 10).cast("string"))), "")


def _card(stream: Column, norm: Column, attempt: Column) -> Column:
    made = _new_digits(stream, norm, F.lit(1), attempt)
    body = made.substr(F.lit(1), F.length(made) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    valid = _luhn(norm) % 10 == 0
    last = made.substr(F.length(made), F.lit(1)).cast("int")
    return F.concat(body, F.when(valid, check).otherwise(F.when(last == check, (last + 1) % 10).otherwise(last)).cast("string"))


def _part(stream: Column, name: Column, gender: Column, attempt: Column) -> Column:
    """A part of a name in its script, with the ending of its gender; each attempt has a syllable more."""
    last = F.least(attempt, F.lit(58)) + 3

    def in_script(script: str) -> Column:
        table = F.array(*map(F.lit, SYLLABLES[script]))
        ending = F.when(gender == "male", ENDINGS[script][0]).when(gender == "female", ENDINGS[script][1]).otherwise(ENDINGS[script][2])
        syllables = F.transform(F.sequence(F.lit(0), last), lambda k: F.get(table, (_at(stream, k * 2 + 1, 2) % len(SYLLABLES[script])).cast("int")))
        return F.initcap(F.concat(F.array_join(syllables, ""), ending))

    script = _script(name)
    return F.when(script == "cyrillic", in_script("cyrillic")).when(script == "greek", in_script("greek")).otherwise(in_script("latin"))


def _letter(n: Column) -> Column:
    return F.chr(n % 26 + 97)


def _email(key: str, stream: Column, norm: Column, attempt: Column) -> Column:
    """The local part's pattern with other letters and digits, a letter more each attempt; the domain's own label."""
    local, domain = F.split_part(norm, F.lit("@"), F.lit(1)), F.split_part(norm, F.lit("@"), F.lit(2))

    def drawn(i: Column) -> Column:
        return _at(stream, (i % 60) * 2 + 1, 2)

    spelt = F.transform(F.split(local, ""), lambda c, i: F.when(c.rlike("[a-z]"), _letter(drawn(i))).when(c.rlike("[0-9]"), (drawn(i) % 10).cast("string")).otherwise(c))
    more = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, _letter(drawn(i + F.length(local)))).otherwise(""))
    label = F.translate(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256).substr(1, 8), "0123456789", "ghijklmnop")
    return F.concat(F.array_join(spelt, ""), F.array_join(more, ""), F.lit("@"), label, F.lit(".example.net"))


def surrogate(key: str, kind: Column, norm: Column, gender: Column, attempt: Column) -> Column:
    """Normal form of the entity's surrogate number ``attempt``."""
    s = _stream(key, kind, norm, attempt)
    octets = F.concat_ws(".", *((_at(s, F.lit(k), 4) % 254 + 1).cast("string") for k in (1, 5, 9, 13)))
    wide = F.concat(F.lit("2001:db8"), *(x for k in range(17, 41, 4) for x in (F.lit(":"), s.substr(F.lit(k), F.lit(4)))))  # the range kept for documents
    return (
        F.when(kind == "email", _email(key, s, norm, attempt))
        .when(kind == "ipv4", F.when(_more(attempt) > 0, wide).otherwise(octets))
        .when(kind == "ssn", _new_digits(s, norm, F.lit(0), attempt))
        .when(kind == "phone", _new_digits(s, norm, F.length(F.regexp_extract(norm, CODE, 1)), attempt))
        .when(kind == "card", _card(s, norm, attempt))
        .otherwise(_part(s, norm, gender, attempt))
    )


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate): distinct entities (kind, norm, gender) with surrogates that no other entity has, real or replaced."""
    kind, norm, gender = F.col("kind"), F.col("norm"), F.col("gender")
    table = materialise(entities.select("kind", "norm", "gender", F.lit(0).alias("attempt"), surrogate(key, kind, norm, gender, F.lit(0)).alias("surrogate")), "entities")
    while True:  # each attempt's space is larger than the last one's, so ever fewer meet
        meeting = table.groupBy("kind", "surrogate").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "first")
        losers = table.join(meeting, ["kind", "surrogate"]).where("norm <> first").select("kind", "norm")
        real = table.join(table.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        again = materialise(losers.unionByName(real).distinct(), "meeting")
        if again.isEmpty():
            return table.select("kind", "norm", "surrogate")
        again = again.withColumn("again", F.lit(True))
        attempt = F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)
        moved = table.join(again, ["kind", "norm"], "left").select(
            "kind", "norm", "gender", attempt.alias("attempt"), F.when(F.col("again"), surrogate(key, kind, norm, gender, attempt)).otherwise(F.col("surrogate")).alias("surrogate")
        )
        following = materialise(moved, "entities")
        drop_tables(table)
        table = following


def _written(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the way the entity was written."""
    digits = F.when((kind == "phone") & ~raw.startswith("+"), made.substr(F.lit(2), F.length(made))).otherwise(made)
    placed = F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(r"^\d$"), digits.substr(F.length(_digits(raw.substr(F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    more = digits.substr(F.length(_digits(raw)) + 1, F.length(digits))
    lettered = F.when(F.upper(raw) == raw, F.upper(made)).when((kind == "name") & (F.lower(raw) == raw), F.lower(made)).otherwise(made)
    return F.when(kind.isin("email", "name"), lettered).when(kind == "ipv4", made).otherwise(F.concat(F.array_join(placed, ""), more))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """A row per document with entities: doc_id, n_entities, entities (kind, start, end, surrogate), text with the surrogates.

    An entity of kind name is one part of a name.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(F.col("t").rlike(ANY))
    found, around = texts_and_matches(F.col("t"), ANY)
    matched = text.select("doc_id", F.transform(found, _segments).alias("found"), around.alias("around"))
    names = F.array_distinct(F.transform(F.filter(F.flatten("found"), lambda s: s["kind"] == "name"), lambda s: s["norm"]))
    named = matched.select("doc_id", "found", "around", names.alias("names"))

    def between(text: Column) -> Column:
        return F.when(F.size("names") > 0, _words(text, F.col("names"))).otherwise(F.array(_segment(text)))

    every = F.concat(F.flatten(F.zip_with("found", F.slice("around", 1, F.size("found")), lambda f, t: F.concat(between(t), f))), between(F.element_at("around", -1)))
    held = materialise(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", every.alias("segments")), "personal")
    flat = held.select("row", F.posexplode("segments").alias("at", "s")).where("s.kind is not null").select("row", "at", "s.t", "s.kind", "s.norm", "s.gender")
    shown = flat.where("kind <> 'word'")
    repeats = flat.where("kind = 'word'").join(shown.where("kind = 'name'").select("row", "norm").distinct(), ["row", "norm"], "left_semi").withColumn("kind", F.lit("name"))
    entities = shown.unionByName(repeats)
    male, female = F.max(F.col("gender").eqNullSafe("male")), F.max(F.col("gender").eqNullSafe("female"))
    distinct = shown.groupBy("kind", "norm").agg(F.when(male & ~female, "male").when(female & ~male, "female").otherwise("open").alias("gender"))
    new = entities.join(resolve(distinct, key), ["kind", "norm"]).select("row", "at", "kind", _written(F.col("kind"), F.col("t"), F.col("surrogate")).alias("t"))
    by_row = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "t"))).alias("new"))  # no more than its text holds

    joined = held.join(by_row, "row").select("doc_id", "segments", "new", totals(F.transform("segments", lambda s: F.length(s["t"]))).alias("ends"))
    spans = F.transform(
        "new",
        lambda e: F.struct(
            e["kind"].alias("kind"), (F.get("ends", e["at"]) - F.length(F.get("segments", e["at"])["t"])).alias("start"), F.get("ends", e["at"]).alias("end"), e["t"].alias("surrogate")
        ),
    )
    # old and new segments by place, the new one last; of a place the last one counts
    merged = F.array_sort(
        F.concat(
            F.transform("segments", lambda s, i: F.struct(i.alias("at"), F.lit(0).alias("by"), s["t"].alias("t"))),
            F.transform("new", lambda e: F.struct(e["at"].alias("at"), F.lit(1).alias("by"), e["t"].alias("t"))),
        )
    )
    ready = joined.select("doc_id", F.size("new").cast("long").alias("n_entities"), spans.alias("entities"), merged.alias("merged"))
    last = F.filter("merged", lambda m, i: ~F.get("merged", i + 1)["at"].eqNullSafe(m["at"]))
    return ready.select("doc_id", "n_entities", "entities", F.array_join(F.transform(last, lambda m: m["t"]), "").alias("text"))
