"""Secret scanning with a randomness test battery, in DataFrame functions only.

Three base patterns find assignments, access keys and long hex runs. Besides, every long run of token characters that has
both letters and digits is a candidate: its encoding is inferred (hex, base32, lower-case, base62 or base64), its characters
become numbers of that alphabet, and three tests ask whether it could be uniformly random over the alphabet:

* chi-squared for the frequencies of the characters. Where a character is expected fewer than LEAST_EXPECTED times, which short
  strings always have, characters are counted in four cells (vowels, other small letters, other capitals, the rest).
* runs of characters below and above the alphabet's middle. Its halves are equally likely, so the number of changes is
  binomial and its two-sided p-value is exact; strings too long for a sum use the normal limit.
* the lag-one serial correlation with its mean and variance under random order.

Chi-squared and serial correlation have approximate tails, so their p-values count as FLOOR at least. Runs and serial correlation depend
on each other, so twice the lesser of their p-values counts; Fisher's rule combines it with that of chi-squared.
Ordinary identifiers fail; within each length class, where the tests have similar power, Benjamini-Hochberg over all
candidates of the table chooses below which p-value they are cleared, so the share of random strings among the cleared
ones stays under FALSE_SHARE. What is not cleared is reported as `random`, unless a base span covers it. P-values are
counted in bins, whose upper edges count, so the rule needs a small table only.

Work is linear in a text's length and n log n in its matches. Null texts count as empty. Rows without an id and repeated rows are
scanned like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.llm.common import materialise
from vistrel.llm.matches import running, spans, texts_and_matches

#: The base patterns and their least lengths (of group 2, of the match, of the match).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: A candidate: so many token characters at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Inferred encodings, the first that fits: pattern and alphabet in the order of its numbers.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", _LOWER.upper() + "234567"),
    ("^[a-z0-9]+$", _LOWER + _DIGITS),
    ("^[A-Za-z0-9]+$", _LOWER.upper() + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
#: Cells of short strings: all vowels, then the other small letters and the other capitals; all else is the fourth.
CELLS = ("aeiouAEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ")
#: Expected count below which characters are counted in cells; least p-value of the approximate tests; changes that are summed up.
LEAST_EXPECTED, FLOOR, EXACT_CHANGES = 5, 1e-6, 400
#: Share of random strings among the cleared candidates; bins of a factor of 10 of the p-value, and the last bin.
FALSE_SHARE, BINS, LAST_BIN = 0.05, 4, 80


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    x = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, 1 - tail).otherwise(tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _bound(name: str, value: Column, use) -> Column:
    """``use`` of a value that is computed once; inside a lambda the optimizer shares nothing."""
    return F.get(F.transform(F.array(F.struct(value.alias(name))), lambda s: use(s[name])), F.lit(0))


def p_random(token: Column) -> Column:
    """Combined p-value of the three tests for a string of letters, digits and token characters."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.coalesce(*(F.when(body.rlike(p), F.lit(a)) if p else F.lit(a) for p, a in ENCODINGS))
    return _bound("text", F.struct(body.alias("body"), alphabet.alias("alphabet")), lambda t: _tests(t["body"], t["alphabet"]))


def _count_of(text: Column, characters: Column) -> Column:
    return (F.length(text) - F.length(F.call_function("translate", text, characters, F.lit("")))).cast("double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def p_uniform(body: Column, alphabet: Column) -> Column:
    """Chi-squared over characters, or over cells of them, with the Wilson-Hilferty normal limit."""
    n, a = F.length(body).cast("double"), F.length(alphabet).cast("double")
    cells = F.transform(F.array(*map(F.lit, CELLS)), lambda c: F.struct(_count_of(alphabet, c).alias("size"), _count_of(body, c).alias("seen")))
    rest = F.struct((a - _total(F.transform(cells, lambda c: c["size"]))).alias("size"), (n - _total(F.transform(cells, lambda c: c["seen"]))).alias("seen"))
    letters = F.transform(F.split(alphabet, ""), lambda c: F.struct(F.lit(1.0).alias("size"), _count_of(body, c).alias("seen")))
    counted = F.when(n < LEAST_EXPECTED * a, F.filter(F.concat(cells, F.array(rest)), lambda c: c["size"] > 0)).otherwise(letters)

    def test(of: Column) -> Column:
        chi = _total(F.transform(of, lambda c: (c["seen"] - n * c["size"] / a) * (c["seen"] - n * c["size"] / a) / (n * c["size"] / a)))
        df = (F.size(of) - 1).cast("double")
        return _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    return _bound("cells", counted, test)


def p_runs(changes: Column, n: Column) -> Column:
    """Two-sided p-value of a number of changes among n characters: binomial with n - 1 trials of one half."""
    trials = n - 1
    less = F.least(changes, trials - changes)
    first = F.struct(F.pow(F.lit(0.5), trials).alias("term"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(less, F.lit(float(EXACT_CHANGES))).cast("int")),
        first,
        lambda s, k: F.struct((s["term"] * (trials - k) / (k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(trials <= EXACT_CHANGES, F.least(F.lit(1.0), 2 * summed)).otherwise(_two_sided((changes - trials / 2) / F.sqrt(trials / 4)))


def p_serial(v: Column, n: Column) -> Column:
    """Two-sided p-value of the lag-one correlation, whose mean is -1/n and whose variance is (n-2)^2 / (n^2 (n-1))."""
    before, after = F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v))

    def test(centre: Column) -> Column:
        around = _total(F.transform(v, lambda x: (x - centre) * (x - centre)))
        lagged = _total(F.zip_with(before, after, lambda x, y: (x - centre) * (y - centre)))
        return F.when(around == 0, F.lit(0.0)).otherwise(_two_sided((lagged / around + 1 / n) * n * F.sqrt(n - 1) / (n - 2)))

    return _bound("centre", _total(v) / n, test)


def _tests(body: Column, alphabet: Column) -> Column:
    values = F.transform(F.split(body, ""), lambda c: F.greatest(F.instr(alphabet, c) - 1, F.lit(0)).cast("double"))
    n, a = F.length(body).cast("double"), F.length(alphabet).cast("double")

    def combined(v: Column) -> Column:
        changes = _total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda x, y: F.when((x >= a / 2) != (y >= a / 2), 1.0).otherwise(0.0)))
        each = (F.greatest(p_uniform(body, alphabet), F.lit(FLOOR)), F.greatest(p_runs(changes, n), F.lit(1e-30)), F.greatest(p_serial(v, n), F.lit(FLOOR)))
        order = F.least(F.lit(1.0), 2 * F.least(each[1], each[2]))
        return _bound("half", -(F.log(each[0]) + F.log(order)), lambda half: F.exp(-half) * (1 + half))

    return _bound("values", values, combined)


def _span(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and the tested candidates (start, end, stratum, bin) that no base span covers."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "free": CANDIDATE}
    matched = text.select("doc_id", "t", *(texts_and_matches(F.col("t"), p)[0].alias(k) for k, p in patterns.items()))
    parted = matched.select("doc_id", *patterns, *(F.when(F.size(k) > 0, texts_and_matches(F.col("t"), p)[1]).alias(f"{k}_around") for k, p in patterns.items()))
    placed = parted.select("doc_id", *(F.when(F.size(k) > 0, spans(F.col(k), F.col(f"{k}_around"))).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>")).alias(k) for k in patterns))
    found = placed.select(
        "doc_id",
        F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        "access",
        "hex",
        F.filter("free", lambda s: s["match"].rlike("[A-Za-z]") & s["match"].rlike("[0-9]")).alias("free"),
    )
    based = found.select("doc_id", F.concat(*(F.transform(k, _span(i)) for i, k in enumerate(KINDS[:3]))).alias("base"), "free")

    def tested(s: Column) -> Column:
        p = F.greatest(p_random(s["match"]), F.lit(1e-30))
        stratum = F.floor(2 * F.log2(F.length(s["match"]))).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), stratum.alias("stratum"), F.least(F.floor(-F.log10(p) * BINS), F.lit(LAST_BIN)).cast("int").alias("bin"))

    # by start, base spans before candidates: one is covered if a base span so far ends no earlier
    events = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("free"), b["end"].alias("end"), F.lit("").alias("match"))),
            F.transform("free", lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("free"), c["end"].alias("end"), c["match"].alias("match"))),
        )
    )
    ordered = based.select("doc_id", "base", F.when(F.size("free") > 0, events).otherwise(F.array().cast("array<struct<start:int,free:int,end:int,match:string>>")).alias("events"))
    reach = running(F.transform("events", lambda e: F.when(e["free"] == 0, e["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
    open_ones = F.filter(F.zip_with("events", reach, lambda e, r: F.when((e["free"] == 1) & (r < e["end"]), e)), lambda e: e.isNotNull())
    return ordered.select("doc_id", "base", F.transform(open_ones, tested).alias("tested"))


def cleared_from(tested: DataFrame) -> dict[int, int]:
    """For each length class the least bin whose candidates are cleared: Benjamini-Hochberg on counts by bin."""
    counts = tested.select(F.explode("tested").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    by = W.Window.partitionBy("stratum")
    ranked = counts.withColumn("up_to", F.sum("n").over(by.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(by))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= FALSE_SHARE * F.col("up_to") / F.col("all"))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}  # a row per length class


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs (columns doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    tested = materialise(candidates(docs), "secrets")
    cuts = cleared_from(tested)
    limit = F.create_map(*(F.lit(x) for kv in cuts.items() for x in kv)) if cuts else None

    def open_still(c: Column) -> Column:
        return F.lit(True) if limit is None else c["bin"] < F.coalesce(F.try_element_at(limit, c["stratum"]), F.lit(LAST_BIN + 1))

    random = F.transform(F.filter("tested", open_still), _span(3))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return tested.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base", random.alias("random")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
