"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.llm.collocations import collocations
from vistrel.llm.common import table
from vistrel.llm.decontamination import contaminated
from vistrel.llm.exact_dedup import exact_groups
from vistrel.llm.labelled import held_out
from vistrel.llm.merkle import fold, manifest, row_digest
from vistrel.llm.near_dedup import near_components
from vistrel.llm.packing import pack
from vistrel.llm.pivot_search import top_k
from vistrel.llm.quality import GOOD_FROM, fit_quality, quality_score
from vistrel.llm.secrets import scan_secrets
from vistrel.llm.substring_dedup import repeated_passages
from vistrel.llm.surrogates import replace_personal_data
from vistrel.llm.token_counts import token_counts
from vistrel.llm.toxicity import fit_toxicity, score_toxicity

#: A document is toxic from this score on.
TOXIC_FROM = 0.7
#: The key of the surrogates that the registered query makes; a deployment passes its own secret.
SURROGATE_KEY = "registered query"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality_score(fit_quality(docs, table(spark, sf_dir, "labels")), spark)
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= GOOD_FROM).cast("int")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), top=2000)


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = row_digest(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    found = docs.withColumn("found_leaf", F.when(tampered, lowered).otherwise(row_digest()))
    folded = fold(manifest(found, ("doc_id", "found_leaf")), "found_leaf", "folded_root")
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _manifest_sql(levels: int = 7) -> str:
    """The manifest as levels of nodes, for sources of at most 16 ** levels rows and as many sources."""

    def level(k: int, tree: str, by: str) -> str:
        """Level k's nodes with their siblings, and level k + 1's nodes; a tree of one node stays as it is."""
        run = f"(PARTITION BY {by} i // 16 ORDER BY i ROWS BETWEEN"
        nodes = f"{by} i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n"
        return f"""{tree}w{k} AS (SELECT *, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
                   coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {tree}{k}),
        {tree}{k + 1} AS (SELECT {nodes} FROM {tree}{k} GROUP BY {by} i // 16)"""

    def item(v: str) -> str:
        return f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"

    def climb(k: int, tree: str, at: str, on: str) -> str:
        """The value and the siblings after one more level."""
        below = f"{tree}p{k - 1}" if k else {"s": "first", "r": "half"}[tree]
        return f"""{tree}p{k} AS (SELECT p.* EXCLUDE (v, sib), sib || lo || hi AS sib, CASE WHEN w.n > 1 THEN sha256(lo || v || hi) ELSE v END AS v
                   FROM {below} p JOIN {tree}w{k} w ON {on} w.i = p.{at} // {16**k})"""

    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    leaf, forged = (f"sha256({' || '.join(item(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})" for text in ("text", lowered))
    steps = [
        f"d AS (SELECT doc_id, coalesce('s' || source, '') AS t, {leaf} AS h, {forged} AS lowered, crc FROM documents JOIN crcs USING (doc_id))",
        "first AS (SELECT doc_id, t, h AS leaf, row_number() OVER (PARTITION BY t ORDER BY doc_id, h) - 1 AS place, CASE WHEN crc % 5 = 0 THEN lowered ELSE h END AS v, '' AS sib FROM d)",
        "s0 AS (SELECT t, place AS i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM first)",
        *(level(k, "s", "t,") for k in range(levels)),
        f"r0 AS (SELECT t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, h, count(*) OVER () AS n FROM s{levels})",
        *(level(k, "r", "") for k in range(levels)),
        *(climb(k, "s", "place", "w.t = p.t AND") for k in range(levels)),
        f"half AS (SELECT p.*, r0.i AS source_place, r0.h AS subroot FROM sp{levels - 1} p JOIN r0 USING (t))",
        *(climb(k, "r", "source_place", "") for k in range(levels)),
    ]
    # crc32 of the ids as text: bit by bit, as a table of the ids' bytes is short
    crc = """crcs AS (SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(CAST(doc_id AS VARCHAR)[k])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM documents)"""
    return f"""WITH {crc}, {", ".join(steps)}
        SELECT doc_id, leaf, subroot, (SELECT h FROM r{levels}) AS root, sha256(sib) AS proof_sha256, v AS folded_root, v = (SELECT h FROM r{levels}) AS verified FROM rp{levels - 1}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_best_fit_packing,
        op3_surrogates,
        op4_token_counts,
        op5_exact_dedup,
        op6_decontamination,
        op7_substring_dedup,
        op8_secrets,
        op9_near_dedup,
        op10_quality,
        op11_collocations,
        op12_pivot_search,
        op13_manifest,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH lowered AS (
            SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM lowered
    """,
    # every shingle of every text meets every other; components by reachability
    "op9_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
        fives AS (SELECT doc_id, m, p, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        flat AS (SELECT DISTINCT doc_id, shingle FROM fives WHERE p = 1 OR p <= m - 4),
        sized AS (SELECT doc_id, count(shingle) AS n FROM documents LEFT JOIN flat USING (doc_id) GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.other = a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
    """,
    # every diagonal of every text and item on which enough tokens match, without seeds
    "op6_decontamination": """
        WITH dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
        it AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM benchmark),
        d AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM dt),
        i AS (SELECT item_id, len(t) AS n, unnest(t) AS token, generate_subscripts(t, 1) AS q FROM it),
        met AS (SELECT doc_id, item_id, n, p - q AS diagonal, q FROM d JOIN i USING (token)),
        rich AS (SELECT doc_id, item_id, n, diagonal, list(q ORDER BY q) AS qs FROM met GROUP BY ALL HAVING count(*) >= least(12, 0.6 * n)),
        placed AS (SELECT doc_id, item_id, n, diagonal, len(qs) AS matched, unnest(qs) AS q, generate_subscripts(qs, 1) AS j FROM rich),
        ends AS (SELECT *, 2 * j - q + 1 + max(q - 2 * j) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS best FROM placed),
        laid AS (SELECT doc_id, item_id, n, diagonal, matched, max(best) AS overlap FROM ends GROUP BY ALL),
        ranked AS (SELECT *, greatest(diagonal, 0) AS token_start, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, matched DESC, n DESC, greatest(diagonal, 0)) AS rn FROM laid WHERE overlap >= least(12, 0.6 * n))
        SELECT doc_id, item_id, CAST(overlap AS BIGINT) AS overlap, CAST(matched AS BIGINT) AS matched, CAST(n AS BIGINT) AS item_tokens, CAST(token_start AS BIGINT) AS token_start FROM ranked WHERE rn = 1
    """,
    "op11_collocations": f"""
        WITH split AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
        pieces AS (SELECT d, lang, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM split),
        lists AS (SELECT d, lang, k, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        words AS (SELECT d, lang, k, unnest(w) AS a, generate_subscripts(w, 1) AS j FROM lists),
        runs AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM words WINDOW o AS (PARTITION BY d, k ORDER BY j)),
        f AS (SELECT lang, phrase, count(*) AS f FROM (
            SELECT lang, a AS phrase FROM runs UNION ALL SELECT lang, a || ' ' || b FROM runs UNION ALL SELECT lang, a || ' ' || b || ' ' || c FROM runs
            UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || e FROM runs) WHERE phrase IS NOT NULL GROUP BY ALL),
        kept AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE f >= 30 AND contains(phrase, ' ')),
        cuts AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM kept),
        scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, (2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS score, k FROM cuts
            JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        sizes AS (SELECT lang, w, a, unnest(range(2, len(w))) AS size FROM kept),
        places AS (SELECT lang, w, a, size, unnest(range(1, len(w) - size + 2)) AS place FROM sizes),
        inside AS (SELECT lang, array_to_string(list_slice(w, place, place + size - 1), ' ') AS phrase, max(a) AS most FROM places GROUP BY ALL),
        free AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(score AS BIGINT) AS score FROM free)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op12_pivot_search": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS f FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        scored AS (SELECT q.row, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.f, x.f) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.row <> x.row),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_manifest": _manifest_sql(),
}
