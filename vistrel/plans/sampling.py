"""Sampling queries: annotation, pairs, questions, batches, option tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.functions import permute
from vistrel.operators import runs, samples
from vistrel.plans.registry import query
from vistrel.sources.readers import task_plan
from vistrel.sources.views import IMAGES, RUNS, images, table
from vistrel.sources.views import runs as run_rows



def _key(seed: str, *columns: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}))"


def _slim(spark: SparkSession, sf_dir: str, subset: str = "train") -> DataFrame:
    return images(spark, sf_dir, subset, feat=False)


_ANNOTATED = f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    anchors AS (SELECT * FROM (SELECT image_idx, pid, camid, row_number() OVER (ORDER BY {_key('3', 'image_idx')}, image_idx) AS pos FROM t) WHERE pos <= 16),
    n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos) AS nth FROM anchors),
    o AS (SELECT n.pos, b.image_idx AS partner_idx, row_number() OVER (PARTITION BY n.pos ORDER BY {_key('3', 'n.image_idx', 'b.image_idx')}, b.image_idx) AS rn
          FROM n JOIN t b ON b.pid = n.pid AND b.image_idx <> n.image_idx AND b.camid <> n.camid WHERE n.nth = 1),
    annotated AS (SELECT n.pos, n.image_idx, n.pid, o.partner_idx, CASE WHEN n.nth > 1 THEN 'dup' WHEN o.partner_idx IS NULL THEN 'fail' ELSE 'pair' END AS outcome
                  FROM n LEFT JOIN o ON n.pos = o.pos AND o.rn = 1)"""


@query(f"{_ANNOTATED} SELECT pos, image_idx, pid, coalesce(partner_idx, -1) AS partner_idx, outcome FROM annotated")
def annotate_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's null for no partner is shown as -1, so that the column stays a whole number everywhere."""
    train = _slim(spark, sf_dir)
    annotated = samples.annotate(samples.draw_k(train.drop("pid"), "image_idx", 16, 3), train, 3)
    return annotated.withColumn("partner_idx", F.coalesce("partner_idx", F.lit(-1).cast("long")))


@query(f"{_ANNOTATED} SELECT count(*) AS k, count(*) FILTER (outcome = 'pair') AS n_pairs, count(*) FILTER (outcome = 'fail') AS n_fail, count(*) FILTER (outcome = 'dup') AS n_dup FROM annotated")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.annotation_counts(annotate_random(spark, sf_dir))


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    e AS (SELECT pid FROM t GROUP BY pid HAVING count(DISTINCT camid) >= 2),
    b AS (SELECT * FROM (SELECT pid, camid, image_idx, row_number() OVER (PARTITION BY pid, camid ORDER BY {_key('5', 'image_idx')}, image_idx) AS rn FROM t WHERE pid IN (SELECT pid FROM e)) WHERE rn = 1),
    c AS (SELECT pid, image_idx, row_number() OVER (PARTITION BY pid ORDER BY {_key('5', 'pid', 'camid')}, camid) AS cam FROM b)
    SELECT pid, max(image_idx) FILTER (cam = 1) AS a_idx, max(image_idx) FILTER (cam = 2) AS b_idx FROM c WHERE cam <= 2 GROUP BY pid"""
)
def two_camera_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.two_camera_pairs(_slim(spark, sf_dir), 5)


@query(
    f"""WITH {IMAGES}, t AS (SELECT pid, camid, image_idx, {_key('5', 'image_idx')} AS h FROM images WHERE subset = 'train'),
    n AS (SELECT *, row_number() OVER (PARTITION BY pid, camid ORDER BY h, image_idx) AS in_cam, min(h) OVER (PARTITION BY pid, camid) AS lead FROM t),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY pid ORDER BY lead) AS cam FROM n),
    s AS (SELECT pid, image_idx, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN in_cam = 1 AND cam <= 2 THEN cam ELSE 3 END, h, image_idx) AS slot FROM c)
    SELECT pid, slot, image_idx FROM s WHERE slot <= 4"""
)
def images_per_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.images_per_identity(_slim(spark, sf_dir), 4, 5)


def _permuted(place: str, n: str, seed: str, *columns: str) -> str:
    """Where the keyed permutation of 0..n-1 takes a place."""
    numbers = f"list_transform(range(0, {permute.ROUNDS}), lambda k: CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}, CAST(k AS VARCHAR))), 1, 8)) AS BIGINT))"
    partner = f"((r % {n} - x) % {n} + {n}) % {n}"
    swap = f"(((greatest(x, {partner}) % 2147483648) * {permute.MULTIPLIER} + r) % 4294967296) // 65536 % 2 = 1"
    return f"list_reduce(list_prepend(CAST({place} AS BIGINT), {numbers}), lambda x, r: CASE WHEN {swap} THEN {partner} ELSE x END)"


@query(
    f"""WITH {IMAGES}, b AS (SELECT image_idx // 320 AS batch, image_idx, pid, row_number() OVER (PARTITION BY image_idx // 320 ORDER BY pid, image_idx) - 1 AS p FROM images WHERE subset = 'train'),
    pairs AS (SELECT x.batch, x.image_idx AS a, y.image_idx AS b, x.p, y.p AS q, CAST(x.pid = y.pid AS BIGINT) AS label, min(y.p) OVER (PARTITION BY y.batch, y.pid) AS start, y.pid FROM b x JOIN b y ON x.batch = y.batch AND x.p < y.p),
    placed AS (SELECT *, row_number() OVER (PARTITION BY batch, label ORDER BY pid, q, p) - 1 AS number, count(*) OVER (PARTITION BY batch, label) AS n FROM pairs),
    counts AS (SELECT batch, count(*) FILTER (label = 1) AS same, count(*) FILTER (label = 0) AS other FROM pairs GROUP BY batch),
    drawn AS (SELECT batch, same, other, unnest(range(0, least(same, other, 128))) AS i FROM counts),
    numbers AS (
        SELECT batch, CAST(1 AS BIGINT) AS label, {_permuted("i", "same", "9:same", "batch")} AS number FROM drawn
        UNION ALL SELECT batch, 0, {_permuted("i", "other", "9:other", "batch")} FROM drawn)
    SELECT batch, least(a, b) AS a_idx, greatest(a, b) AS b_idx, label FROM numbers JOIN placed USING (batch, label, number)"""
)
def balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.balanced_pairs(_slim(spark, sf_dir).withColumn("batch", F.floor(F.col("image_idx") / 320)), 9)


@query(
    f"""WITH {IMAGES}, t AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS i FROM (SELECT DISTINCT pid FROM images)),
    r AS (SELECT i * 2 + n.range AS i, pid AS label FROM t, range(2) n)
    SELECT i // 2 AS pair, max(label) FILTER (i % 2 = 0) AS first, max(label) FILTER (i % 2 = 1) AS second FROM r GROUP BY i // 2"""
)
def repeated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identity's label twice in a row, read again as pairs."""
    from vistrel.operators.identity import dense_relabel

    numbered = dense_relabel(images(spark, sf_dir, feat=False)).select(F.col("label").alias("i"), F.col("pid").alias("label"))
    return samples.paired(samples.repeat_labels(numbered, 2), "label")


@query(f"WITH {IMAGES}, t AS (SELECT image_idx, pid, row_number() OVER (ORDER BY {_key('17', 'image_idx')}, image_idx) AS rn FROM images WHERE subset = 'gallery') SELECT image_idx, pid FROM t WHERE rn <= 64")
def evaluation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator itself: 64 drawn gallery images."""
    return samples.evaluation_subset(images(spark, sf_dir, "gallery", feat=False), "image_idx", 64, 17).select("image_idx", "pid")


def _number(seed: str, *columns: str) -> str:
    return f"CAST(('0x' || substr({_key(seed, *columns)}, 1, 8)) AS BIGINT)"


_QUESTIONS = f"""WITH {IMAGES}, t AS (SELECT image_idx, pid, row_number() OVER (ORDER BY image_idx) - 1 AS i FROM images WHERE subset = 'gallery'),
    nth AS (SELECT pid, image_idx, (row_number() OVER (PARTITION BY pid ORDER BY image_idx) - 1) // 2 AS pr, (row_number() OVER (PARTITION BY pid ORDER BY image_idx) - 1) % 2 AS side FROM t),
    cp AS (SELECT max(image_idx) FILTER (side = 0) AS img_a, max(image_idx) FILTER (side = 1) AS img_b FROM nth GROUP BY pid, pr HAVING count(*) = 2),
    couples AS (SELECT img_a, img_b, row_number() OVER (ORDER BY img_a, img_b) - 1 AS i FROM cp),
    q AS (SELECT range AS q_idx, {_number('11:coin', 'range')} % 2 AS same FROM range(64)),
    asked AS (
        SELECT q_idx, img_a, img_b, CAST(1 AS BIGINT) AS truth FROM q JOIN couples c ON same = 1 AND c.i = {_number('11:pair', 'q_idx')} % (SELECT count(*) FROM couples)
        UNION ALL
        SELECT q_idx, a.image_idx, b.image_idx, CAST(a.pid = b.pid AS BIGINT) FROM q
        JOIN t a ON same = 0 AND a.i = {_number('11:a', 'q_idx')} % (SELECT count(*) FROM t) JOIN t b ON b.i = {_number('11:b', 'q_idx')} % (SELECT count(*) FROM t))"""


@query(f"{_QUESTIONS} SELECT * FROM asked")
def question_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.questions(_slim(spark, sf_dir, "gallery"), 64, 11)


@query(
    f"""{_QUESTIONS}, p AS (SELECT *, row_number() OVER (ORDER BY q_idx) AS p FROM asked),
    s AS (SELECT truth AS shuffle, row_number() OVER (ORDER BY {_key('13', 'q_idx')}, q_idx) AS p FROM asked)
    SELECT q_idx, truth, shuffle, 1 - truth AS flip, CAST(1 AS BIGINT) AS all_yes, CAST(0 AS BIGINT) AS all_no FROM p JOIN s USING (p)"""
)
def answer_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.answers(question_sample(spark, sf_dir), 13)


@query(
    f"""WITH {IMAGES}, ids AS (SELECT DISTINCT subset AS domain, pid FROM images),
    n AS (SELECT domain, pid, row_number() OVER (PARTITION BY domain ORDER BY pid) - 1 AS i FROM ids),
    sz AS (SELECT domain, count(*) AS n, row_number() OVER (ORDER BY domain) - 1 AS d FROM ids GROUP BY domain),
    b AS (SELECT range AS batch, {_number('17:domain', 'range')} % 3 AS d FROM range(50)),
    s AS (SELECT batch, slot.range AS slot, domain, {_number('17:slot', 'batch', 'slot.range')} % n AS i FROM b JOIN sz USING (d), range(8) slot)
    SELECT batch, slot, domain, pid FROM s JOIN n USING (domain, i)"""
)
def batch_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = images(spark, sf_dir, feat=False).select(F.col("subset").alias("domain"), "pid").distinct()
    return samples.batches(ids, 50, 8, 17)


@query(
    f"""WITH {IMAGES}, t AS (SELECT pid, image_idx, {_key('19', 'image_idx')} AS h FROM images WHERE subset = 'train'),
    r AS (SELECT image_idx, coalesce(lead(image_idx) OVER (PARTITION BY pid ORDER BY h, image_idx), first(image_idx) OVER (PARTITION BY pid ORDER BY h, image_idx)) AS partner_idx FROM t)
    SELECT * FROM r WHERE image_idx <> partner_idx"""
)
def anchor_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.anchor_partner(_slim(spark, sf_dir), 19)


@query(
    f"""WITH {RUNS}, d AS (SELECT DISTINCT domain FROM runs), s AS (SELECT DISTINCT split FROM runs), m AS (SELECT DISTINCT condition AS method FROM runs), k AS (SELECT DISTINCT k FROM runs), e AS (SELECT DISTINCT seed FROM runs)
    SELECT domain, split, method, k, seed FROM d, s, m, k, e"""
)
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of what the evaluation rows have of each option."""
    rows = run_rows(spark, sf_dir).withColumnRenamed("condition", "method")
    return runs.grid(*(rows.select(c).distinct() for c in ("domain", "split", "method", "k", "seed")))


@query(
    """WITH o AS (SELECT DISTINCT o_orderstatus AS plan, 'priority' AS name, substr(o_orderpriority, 1, 1) AS value FROM orders
        UNION SELECT DISTINCT o_orderstatus, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
        UNION SELECT DISTINCT o_orderstatus, 'ship', CAST(o_orderkey % 3 AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P'),
    p AS (SELECT plan, value FROM o WHERE name = 'priority'), s AS (SELECT plan, value FROM o WHERE name = 'ship'), y AS (SELECT plan, value FROM o WHERE name = 'year')
    SELECT p.plan, CASE WHEN s.value IS NULL THEN ['priority=' || p.value, 'year=' || y.value] ELSE ['priority=' || p.value, 'ship=' || s.value, 'year=' || y.value] END AS task
    FROM p JOIN y USING (plan) LEFT JOIN s USING (plan)"""
)
def option_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each order status, which stands for a plan, over the priorities and years of its orders; one plan has an option less."""
    rows = table(spark, sf_dir, "orders")
    option = lambda name, value, of: of.select(F.col("o_orderstatus").alias("plan"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    given = option("priority", F.substring("o_orderpriority", 1, 1), rows).unionByName(option("year", F.year("o_orderdate"), rows)).unionByName(option("ship", F.col("o_orderkey") % 3, rows.where("o_orderstatus <> 'P'")))
    return runs.option_grids(given)


@query(
    """WITH saved AS (SELECT CAST(c_custkey AS VARCHAR) AS name, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 < 2),
    given AS (SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY o_custkey)
    SELECT name, coalesce(s.value, g.value) AS value, CASE WHEN s.value IS NOT NULL THEN 'saved' ELSE 'given' END AS origin FROM saved s FULL JOIN given g USING (name)"""
)
def option_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for options: most have a saved value, their nation, those with orders a given one, their number."""
    name = lambda c: F.col(c).cast("string").alias("name")
    saved = table(spark, sf_dir, "customer").where("c_custkey % 3 < 2").select(name("c_custkey"), F.col("c_nationkey").cast("string").alias("value"))
    given = table(spark, sf_dir, "orders").groupBy(name("o_custkey")).agg(F.count("*").cast("string").alias("value"))
    return runs.merge_options(saved, given)


@query(
    """WITH l AS (SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 5 = 0 THEN '@wait' WHEN s_suppkey % 7 = 1 THEN '# ' || s_name WHEN s_suppkey % 11 = 2 THEN '' ELSE 'task_' || s_suppkey || ' | run --nation ' || s_nationkey || '|x' END AS value FROM supplier),
    w AS (SELECT line_no, value, count(*) FILTER (value = '@wait') OVER (ORDER BY line_no) AS waits FROM l),
    t AS (SELECT * FROM w WHERE value LIKE 'task%')
    SELECT line_no, dense_rank() OVER (ORDER BY waits) - 1 AS "group", trim(split_part(value, '|', 1)) AS name, trim(substr(value, strpos(value, '|') + 1)) AS command FROM t"""
)
def task_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for the lines of a task plan, with waits, comments and blank lines among them."""
    key = F.col("s_suppkey")
    task = F.concat(F.lit("task_"), key, F.lit(" | run --nation "), F.col("s_nationkey"), F.lit("|x"))
    value = F.when(key % 5 == 0, "@wait").when(key % 7 == 1, F.concat(F.lit("# "), F.col("s_name"))).when(key % 11 == 2, "").otherwise(task)
    return task_plan(table(spark, sf_dir, "supplier").select(key.cast("long").alias("line_no"), value.alias("value")))


@query(f"WITH {IMAGES}, f AS (SELECT image_idx, row_number() OVER (ORDER BY {_key('23', 'image_idx')}, image_idx) AS pos FROM images WHERE subset = 'train') SELECT pos, image_idx AS a_idx, image_idx AS b_idx FROM f WHERE pos <= 8")
def pseudo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.pseudo_pairs(_slim(spark, sf_dir), 8, 23)


def _unique(size: int, seed: int, pool: str) -> str:
    """Batches without repeats where the pool has enough identities, otherwise with."""
    return f"""WITH {IMAGES}, ids AS (SELECT DISTINCT {pool} AS pool, subset AS domain, pid FROM images),
    n AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY pid, domain) - 1 AS i FROM ids),
    sz AS (SELECT pool, count(*) AS n, row_number() OVER (ORDER BY pool) - 1 AS d, count(*) OVER () AS pools FROM ids GROUP BY pool),
    b AS (SELECT range AS batch, {_number(f"{seed}:domain", "range")} AS d FROM range(50)),
    s AS (SELECT batch, slot.range AS slot, pool, CASE WHEN n >= {size} THEN {_permuted("slot.range", "n", f"{seed}:order", "batch")} ELSE {_number(f"{seed}:slot", "batch", "slot.range")} % n END AS i
          FROM b JOIN sz ON b.d % sz.pools = sz.d, range({size}) slot)
    SELECT batch, slot, domain, pid FROM s JOIN n USING (pool, i)"""


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir, feat=False).select(F.col("subset").alias("domain"), "pid").distinct()


@query(_unique(6, 29, "subset"))
def batch_sampler_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.batches(_identities(spark, sf_dir), 50, 6, 29, unique=True)


@query(_unique(64, 31, "subset"))
def batch_sampler_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches larger than a domain stay full: they repeat identities."""
    return samples.batches(_identities(spark, sf_dir), 50, 64, 31, unique=True)


@query(_unique(16, 37, "'all'"))
def batch_sampler_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches from all domains together."""
    return samples.batches(_identities(spark, sf_dir), 50, 16, 37, unique=True, mixed=True)


@query(
    """WITH RECURSIVE o AS (SELECT s_nationkey AS plan, s_suppkey AS pos, CASE WHEN s_suppkey % 9 = 0 THEN 'no flag' ELSE '--f' || s_suppkey % 13 || ' 1 --g' || s_suppkey % 8 || ' 2' END AS option FROM supplier),
    r AS (SELECT *, regexp_extract_all(option, '(--\\w+)', 1) AS flags, row_number() OVER (PARTITION BY plan ORDER BY pos) AS n FROM o),
    fold AS (
        SELECT plan, n, pos, option, flags AS seen, true AS kept FROM r WHERE n = 1
        UNION ALL
        SELECT r.plan, r.n, r.pos, r.option, CASE WHEN list_has_any(seen, flags) THEN seen ELSE list_concat(seen, flags) END, NOT list_has_any(seen, flags) FROM fold JOIN r ON r.plan = fold.plan AND r.n = fold.n + 1)
    SELECT plan, pos, option FROM fold WHERE kept"""
)
def option_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for options, nations for the lists they are in."""
    key = F.col("s_suppkey")
    option = F.when(key % 9 == 0, "no flag").otherwise(F.concat(F.lit("--f"), key % 13, F.lit(" 1 --g"), key % 8, F.lit(" 2")))
    return runs.fold_options(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("plan"), key.alias("pos"), option.alias("option")), "plan")


@query("SELECT a.region AS val, string_agg(b.region, ',' ORDER BY b.region) AS sources FROM (SELECT r_name AS region FROM region) a JOIN (SELECT r_name AS region FROM region) b ON a.region <> b.region GROUP BY a.region")
def source_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region names stand for source domains."""
    return runs.source_folds(table(spark, sf_dir, "region").select(F.col("r_name").alias("domain")))


@query("SELECT a.region AS target, list(b.region ORDER BY b.region) AS sources FROM (SELECT r_name AS region FROM region) a JOIN (SELECT r_name AS region FROM region) b ON a.region <> b.region GROUP BY a.region")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region names stand for domains."""
    return runs.leave_one_out(table(spark, sf_dir, "region").select(F.col("r_name").alias("domain")))
