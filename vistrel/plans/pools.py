"""Pool queries over the train images: statistics, duplicate threshold, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.operators import pool, samples, selectors
from vistrel.plans.registry import query
from vistrel.sources.views import IMAGES, images

_SIM = f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    s AS (SELECT a.image_idx AS a_idx, b.image_idx AS b_idx, a.camid <> b.camid AS far, round(list_dot_product(a.feat, b.feat), 6) AS sim
          FROM t a JOIN t b ON a.image_idx <> b.image_idx),
    top AS (SELECT a_idx, sim, row_number() OVER (PARTITION BY a_idx ORDER BY sim DESC, b_idx) AS rn FROM s),
    dense AS (SELECT a_idx, max(sim) AS nn_sim, round(1 / avg(greatest(1 - sim, 1e-4)), 6) AS typicality FROM top WHERE rn <= 20 GROUP BY a_idx),
    best AS (SELECT * FROM (SELECT a_idx, b_idx, sim, row_number() OVER (PARTITION BY a_idx ORDER BY sim DESC, b_idx) AS rn FROM s WHERE far) WHERE rn = 1),
    stats AS (SELECT d.a_idx AS image_idx, nn_sim, typicality, b.sim AS pairability, b.b_idx AS best_idx FROM dense d LEFT JOIN best b ON d.a_idx = b.a_idx)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool that selectors see: no identities."""
    return images(spark, sf_dir, "train").drop("pid")


@query(f"{_SIM} SELECT * FROM stats")
def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool_statistics(_pool(spark, sf_dir))


@query(f"{_SIM} SELECT a.image_idx, a.best_idx AS partner_idx FROM stats a JOIN stats b ON a.best_idx = b.image_idx AND b.best_idx = a.image_idx")
def mutual_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.mutual_partners(pool.pool_statistics(_pool(spark, sf_dir)))


@query(f"{_SIM} SELECT round(quantile_cont(sim, 0.99), 6) AS dup_tau FROM s WHERE a_idx < b_idx")
def dup_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.dup_threshold(_pool(spark, sf_dir))


@query(f"{_SIM}, r AS (SELECT a_idx, b_idx, sim, row_number() OVER (PARTITION BY a_idx ORDER BY sim DESC, b_idx) AS rn FROM s) SELECT a_idx, b_idx, sim AS value, rn FROM r WHERE rn <= 20")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir)
    return pool.nearest(p, p, 20, same_set=True, similarity=True).withColumn("rn", F.col("rn").cast("long"))


@query(
    f"""{_SIM}, sel AS (SELECT * FROM t ORDER BY image_idx LIMIT 16),
    pr AS (SELECT list_dot_product(a.feat, b.feat) AS c FROM sel a JOIN sel b ON a.image_idx < b.image_idx)
    SELECT (SELECT count(DISTINCT camid) FROM sel) AS n_cams, (SELECT round(avg(typicality), 5) FROM stats JOIN sel USING (image_idx)) AS typicality,
           (SELECT round(avg(pairability), 5) FROM stats JOIN sel USING (image_idx)) AS pairability,
           (SELECT round(({' + '.join(f'stddev_pop(feat[{k}])' for k in range(1, 65))}) / 64, 6) FROM sel) AS style_spread,
           (SELECT round(1 - avg(c), 6) FROM pr) AS diversity, (SELECT round(max(c), 6) FROM pr) AS max_sim"""
)
def selection_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir)
    return pool.selection_properties(p, samples.first_k(p, "image_idx", 16), pool.pool_statistics(p))


@query(
    f"""WITH {IMAGES}, p AS (SELECT a.pid = b.pid AS same, list_dot_product(a.feat, b.feat) AS c FROM images a JOIN images b ON a.image_idx < b.image_idx)
    SELECT round(avg(c) FILTER (same), 6) AS within, round(avg(c) FILTER (NOT same), 6) AS across FROM p"""
)
def group_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.group_cosine(images(spark, sf_dir), "pid")


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train')
    SELECT image_idx, round((feat[1] - avg(feat[1]) OVER ()) / (stddev_pop(feat[1]) OVER () + 1e-6), 6) AS z1, round((feat[64] - avg(feat[64]) OVER ()) / (stddev_pop(feat[64]) OVER () + 1e-6), 6) AS z64,
        round({' + '.join(f'(feat[{k}] - avg(feat[{k}]) OVER ()) / (stddev_pop(feat[{k}]) OVER () + 1e-6)' for k in range(1, 65))}, 6) AS total FROM t"""
)
def style_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = pool.zscore(_pool(spark, sf_dir), "feat", 64)
    at = lambda k: F.round(F.get("feat", F.lit(k - 1)), 6).alias(f"z{k}")
    return z.select("image_idx", at(1), at(64), F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {IMAGES}, f AS (SELECT image_idx, row_number() OVER (ORDER BY image_idx) AS pos FROM images WHERE subset = 'train') SELECT pos, image_idx FROM f WHERE pos <= 16")
def select_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.first_k(_pool(spark, sf_dir), "image_idx", 16).select("pos", "image_idx")


_DRAWN = "md5(concat_ws(':', '3', CAST({0} AS VARCHAR))), {0}"


@query(f"WITH {IMAGES}, f AS (SELECT image_idx, row_number() OVER (ORDER BY {_DRAWN.format('image_idx')}) AS pos FROM images WHERE subset = 'train') SELECT pos, image_idx FROM f WHERE pos <= 16")
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.draw_k(_pool(spark, sf_dir), "image_idx", 16, 3).select("pos", "image_idx")


_ELIGIBLE = f"WITH {IMAGES}, e AS (SELECT pid FROM images WHERE subset = 'train' GROUP BY pid HAVING count(DISTINCT camid) >= 2)"


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vistrel.operators.identity import eligible_identities

    return eligible_identities(images(spark, sf_dir, "train", feat=False)).select("pid")


@query(f"{_ELIGIBLE}, f AS (SELECT pid, row_number() OVER (ORDER BY pid) AS pos FROM e) SELECT pos, pid FROM f WHERE pos <= 4")
def select_first_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.first_k(_eligible(spark, sf_dir), "pid", 4).select("pos", "pid")


@query(f"{_ELIGIBLE}, f AS (SELECT pid, row_number() OVER (ORDER BY {_DRAWN.format('pid')}) AS pos FROM e) SELECT pos, pid FROM f WHERE pos <= 4")
def select_random_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.draw_k(_eligible(spark, sf_dir), "pid", 4, 3).select("pos", "pid")


@query(
    f"""WITH {IMAGES}, n AS (SELECT image_idx, row_number() OVER (PARTITION BY camid ORDER BY md5(concat_ws(':', '3', CAST(image_idx AS VARCHAR))), image_idx) AS nth,
                                  md5(concat_ws(':', '3', 'cam', CAST(camid AS VARCHAR))) AS cam FROM images WHERE subset = 'train')
    SELECT row_number() OVER (ORDER BY nth, cam) AS pos, image_idx FROM n"""
)
def camera_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.round_robin(_pool(spark, sf_dir), 3)


#: Budget and seed of the registered selector queries.
BUDGET, SEED = 12, 3


_DRAW = "md5(concat_ws(':', '3', CAST(image_idx AS VARCHAR)))"
#: The orders in which the folding selectors offer images.
_OFFERED = {
    "dedup": f"ORDER BY {_DRAW}, image_idx",
    "pairable": f"ORDER BY pairability DESC NULLS LAST, {_DRAW}, image_idx",
    "camera_balanced": f"ORDER BY nth, md5(concat_ws(':', '3', 'cam', CAST(camid AS VARCHAR))), image_idx",
}


def _folded(name: str) -> str:
    """Images in their order are taken unless one taken before is a probable copy; the order's others fill what is left."""
    return f"""{_SIM.replace("WITH ", "WITH RECURSIVE ", 1)}, tau AS (SELECT quantile_cont(sim, 0.99) AS tau FROM s WHERE a_idx < b_idx),
    twin AS (
        SELECT a_idx, b_idx FROM s, tau WHERE sim > tau
        UNION SELECT a.image_idx, b.image_idx FROM stats a JOIN stats b ON a.best_idx = b.image_idx AND b.best_idx = a.image_idx),
    barring AS (SELECT b_idx AS image_idx, list(a_idx) AS by_idx FROM twin GROUP BY b_idx),
    drawn AS (SELECT image_idx, camid, row_number() OVER (PARTITION BY camid ORDER BY {_DRAW}, image_idx) AS nth FROM t),
    offered AS (
        SELECT row_number() OVER ({_OFFERED[name]}) AS pos, image_idx, coalesce(by_idx, []) AS by_idx
        FROM drawn LEFT JOIN barring USING (image_idx) LEFT JOIN stats USING (image_idx)),
    fold AS (
        SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS taken
        UNION ALL
        SELECT o.pos, CASE WHEN len(taken) >= {BUDGET} OR list_has_any(taken, by_idx) THEN taken ELSE list_append(taken, image_idx) END FROM fold JOIN offered o ON o.pos = fold.pos + 1),
    taken AS (SELECT unnest(taken) AS image_idx, generate_subscripts(taken, 1) AS nth FROM fold WHERE pos = (SELECT max(pos) FROM fold)),
    every AS (SELECT o.image_idx, row_number() OVER (ORDER BY nth NULLS LAST, o.pos) AS pos FROM offered o LEFT JOIN taken USING (image_idx))
    SELECT 'embeddings' AS domain, '{name}' AS selector, pos, image_idx FROM every WHERE pos <= {BUDGET}"""


_KCENTER = f"""{_SIM.replace("WITH ", "WITH RECURSIVE ", 1)},
    placed AS (SELECT image_idx, row_number() OVER (ORDER BY image_idx) AS i, row_number() OVER (ORDER BY {_DRAW}, image_idx) AS draw FROM t),
    gaps AS (SELECT a.i, list(1 - coalesce(sim, 1) ORDER BY b.i) AS gap FROM placed a JOIN placed b ON true LEFT JOIN s ON s.a_idx = a.image_idx AND s.b_idx = b.image_idx GROUP BY a.i),
    pick AS (
        SELECT CAST(1 AS BIGINT) AS pos, p.i AS i, [p.i] AS taken, gap FROM placed p JOIN gaps USING (i) WHERE draw = 1
        UNION ALL
        SELECT pos + 1, far, list_append(taken, far), list_transform(range(1, len(pick.gap) + 1), lambda x: least(pick.gap[x], g.gap[x]))
        FROM (SELECT *, list_position(left_, list_max(left_)) AS far FROM (
            SELECT *, list_transform(range(1, len(gap) + 1), lambda x: CASE WHEN list_contains(taken, x) THEN -1 ELSE gap[x] END) AS left_ FROM pick WHERE pos < {BUDGET})) pick
        JOIN gaps g ON g.i = far)
    SELECT 'embeddings' AS domain, 'kcenter' AS selector, pos, image_idx FROM pick JOIN placed USING (i)"""



def _stepwise(name: str) -> str:
    """One row after another among those not ruled out; these pools have enough of them for the budget."""
    order = {
        "hard_negative": "CASE WHEN pick.pos % 2 = 0 THEN draw ELSE -coalesce(u[pick.i], 0) END",
        "facility": "-gain",
        "facility_camera": "-gain / most - CASE WHEN list_contains(cams, camid) THEN 0 ELSE 0.5 END",
    }[name]
    return f"""{_SIM.replace("WITH ", "WITH RECURSIVE ", 1)}, tau AS (SELECT quantile_cont(sim, 0.99) AS tau FROM s WHERE a_idx < b_idx),
    placed AS (SELECT *, row_number() OVER (ORDER BY image_idx) AS i, row_number() OVER (ORDER BY {_DRAW}, image_idx) AS draw FROM t),
    mates AS (SELECT a.image_idx, a.best_idx FROM stats a JOIN stats b ON a.best_idx = b.image_idx AND b.best_idx = a.image_idx),
    grid AS (SELECT a.i, a.image_idx, b.i AS j, CAST(round(list_dot_product(a.feat, b.feat) * 1000000) AS BIGINT) AS u, a.i = b.i OR round(list_dot_product(a.feat, b.feat), 6) > tau OR b.image_idx = best_idx AS out
             FROM placed a JOIN placed b ON true JOIN tau ON true LEFT JOIN mates ON mates.image_idx = a.image_idx),
    wide AS (SELECT i, list(u ORDER BY j) AS u, list(greatest(u, 0) ORDER BY j) AS g, list(j) FILTER (out) AS rules_out FROM grid GROUP BY i),
    every AS (SELECT placed.i, image_idx, camid, draw, u, g, rules_out FROM placed JOIN wide USING (i)),
    pick AS (
        SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS image_idx, CAST([] AS BIGINT[]) AS barred, CAST([] AS INTEGER[]) AS cams, list_transform(range(0, (SELECT count(*) FROM t)), lambda x: CAST(0 AS BIGINT)) AS cover
        UNION ALL
        SELECT pos, i, image_idx, barred, cams, cover FROM (
            SELECT pick.pos + 1 AS pos, c.i, c.image_idx, list_concat(barred, rules_out) AS barred, list_append(cams, camid) AS cams, list_transform(list_zip(cover, g), lambda z: greatest(z[1], z[2])) AS cover,
                   row_number() OVER (ORDER BY {order}, c.i) AS rn
            FROM pick JOIN (SELECT p.pos AS at, e.*, list_sum(list_transform(list_zip(e.g, p.cover), lambda z: greatest(z[1] - z[2], 0))) AS gain, max(list_sum(list_transform(list_zip(e.g, p.cover), lambda z: greatest(z[1] - z[2], 0)))) OVER (PARTITION BY p.pos) AS most
                            FROM pick p JOIN every e ON NOT list_contains(p.barred, e.i)) c ON c.at = pick.pos
            WHERE pick.pos < {BUDGET}) WHERE rn = 1)
    SELECT 'embeddings' AS domain, '{name}' AS selector, pos, image_idx FROM pick WHERE pos > 0"""


_SELECTOR_SQL = {name: _folded(name) for name in _OFFERED} | {"kcenter": _KCENTER} | {name: _stepwise(name) for name in ("hard_negative", "facility", "facility_camera")}


def _selector(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pools = _pool(spark, sf_dir).withColumn("domain", F.lit("embeddings")).withColumn("style", F.col("feat"))
        return selectors.select(pools, ["domain"], [name], BUDGET, SEED)

    run.__name__ = f"select_{name}"
    run.__doc__ = f"The greedy selector {name}; typical and style_cover cluster and are tested against a plain version."
    query(_SELECTOR_SQL.get(name))(run)


for _name in selectors.SELECTORS:
    _selector(_name)


_IN_BATCH = f"""WITH RECURSIVE {IMAGES},
    unit AS (SELECT image_idx // 320 AS batch, pid, list_transform(feat, lambda x: x / sqrt(list_dot_product(feat, feat))) AS v FROM images WHERE subset = 'train'),
    mean AS (SELECT batch, pid, [{", ".join(f"avg(v[{k}])" for k in range(1, 65))}] AS m FROM unit GROUP BY batch, pid),
    t AS (SELECT batch, pid, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS feat, row_number() OVER (PARTITION BY batch ORDER BY pid) AS i,
                 row_number() OVER (PARTITION BY batch ORDER BY md5(concat_ws(':', '{SEED}', CAST(pid AS VARCHAR))), pid) AS draw FROM mean),
    s AS (SELECT a.batch, a.i, b.i AS j, CAST(round(list_dot_product(a.feat, b.feat) * 1000000) AS BIGINT) AS u FROM t a JOIN t b ON a.batch = b.batch),
    tau AS (SELECT batch, quantile_cont(u, 0.99) AS tau FROM s WHERE i < j GROUP BY batch),
    best AS (SELECT batch, i, j FROM (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY u DESC, j) AS rn FROM s WHERE i <> j) WHERE rn = 1),
    mates AS (SELECT a.batch, a.i, a.j FROM best a JOIN best b ON a.batch = b.batch AND a.j = b.i AND b.j = a.i),
    wide AS (SELECT s.batch, s.i, list(u ORDER BY s.j) AS u, list(greatest(u, 0) ORDER BY s.j) AS g, list(s.j) FILTER (s.i = s.j OR u > tau OR s.j = mates.j) AS rules_out
             FROM s JOIN tau ON tau.batch = s.batch LEFT JOIN mates ON mates.batch = s.batch AND mates.i = s.i GROUP BY s.batch, s.i),
    every AS (SELECT t.batch, t.i, pid, draw, u, g, rules_out FROM t JOIN wide ON wide.batch = t.batch AND wide.i = t.i),
    far AS (
        SELECT batch, CAST(1 AS BIGINT) AS pos, i, pid, [i] AS taken, u AS near FROM every WHERE draw = 1
        UNION ALL
        SELECT batch, pos, i, pid, taken, near FROM (
            SELECT f.batch, f.pos + 1 AS pos, e.i, e.pid, list_append(taken, e.i) AS taken, list_transform(list_zip(near, u), lambda z: greatest(z[1], z[2])) AS near,
                   row_number() OVER (PARTITION BY f.batch ORDER BY near[e.i], e.i) AS rn
            FROM far f JOIN every e ON e.batch = f.batch AND NOT list_contains(taken, e.i) WHERE f.pos < 4) WHERE rn = 1),
    cover AS (
        SELECT DISTINCT batch, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pid, CAST([] AS BIGINT[]) AS barred, list_transform(u, lambda x: CAST(0 AS BIGINT)) AS covered FROM every
        UNION ALL
        SELECT batch, pos, i, pid, barred, covered FROM (
            SELECT c.batch, c.pos + 1 AS pos, e.i, e.pid, list_concat(barred, rules_out) AS barred, list_transform(list_zip(covered, g), lambda z: greatest(z[1], z[2])) AS covered,
                   row_number() OVER (PARTITION BY c.batch ORDER BY list_sum(list_transform(list_zip(g, covered), lambda z: greatest(z[1] - z[2], 0))) DESC, e.i) AS rn
            FROM cover c JOIN every e ON e.batch = c.batch AND NOT list_contains(barred, e.i) WHERE c.pos < 4) WHERE rn = 1),
    picked AS (SELECT batch, 'kcenter' AS selector, pos, pid FROM far UNION ALL SELECT batch, 'facility', pos, pid FROM cover WHERE pos > 0),
    names AS (SELECT DISTINCT batch, selector FROM picked)
    SELECT e.batch, n.selector, row_number() OVER (PARTITION BY e.batch, n.selector ORDER BY p.pos NULLS LAST, e.pid) AS pos, e.pid AS image_idx, p.pos IS NOT NULL AS chosen
    FROM every e JOIN names n ON n.batch = e.batch LEFT JOIN picked p ON p.batch = e.batch AND p.selector = n.selector AND p.pid = e.pid"""


@query(_IN_BATCH)
def select_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities chosen by their mean vectors within each training batch, and then the batch's others in their order."""
    batched = images(spark, sf_dir, "train").withColumn("batch", F.floor(F.col("image_idx") / 320))
    means = selectors.identity_means(batched, 64, "batch")
    picked = selectors.select_within(means, ["batch"], ["kcenter", "facility"], 4, SEED, has_cameras=False)
    return samples.with_rest(means, picked, ["batch"])
