"""Catalogue queries: statistics, integrity, labels, camera pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.operators import identity, runs
from vistrel.plans.registry import query
from vistrel.sources.readers import parse_urls
from vistrel.sources.views import IMAGES, RUNS, images, table
from vistrel.sources.views import runs as run_rows


def _slim(spark: SparkSession, sf_dir: str, subset: str | None = None) -> DataFrame:
    return images(spark, sf_dir, subset, feat=False)


@query(f"WITH {IMAGES} SELECT subset, count(DISTINCT pid) AS n_ids, count(*) AS n_images, count(DISTINCT camid) AS n_cams FROM images GROUP BY subset")
def subset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.subset_stats(_slim(spark, sf_dir), "subset")


@query(f"WITH {IMAGES} SELECT pid, count(DISTINCT camid) AS n_cams FROM images WHERE subset = 'train' GROUP BY pid HAVING count(DISTINCT camid) >= 2")
def eligible_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.eligible_identities(_slim(spark, sf_dir, "train"))


@query(f"WITH {IMAGES} SELECT pid, count(*) AS n_images FROM images WHERE subset = 'train' GROUP BY pid HAVING count(*) >= 2")
def multi_image_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.multi_image_identities(_slim(spark, sf_dir, "train"))


@query(f"WITH {IMAGES} SELECT pid - 3 AS pid, image_idx FROM images WHERE pid - 3 >= 0")
def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.drop_junk(_slim(spark, sf_dir).select((F.col("pid") - 3).alias("pid"), "image_idx"))


@query(
    f"""WITH {IMAGES},
    ids AS (SELECT DISTINCT pid FROM images WHERE subset = 'query' INTERSECT SELECT DISTINCT pid FROM images WHERE subset = 'gallery'),
    drawn AS (SELECT pid FROM ids ORDER BY md5(concat_ws(':', '7', CAST(pid AS VARCHAR))), pid LIMIT 4)
    SELECT image_idx, pid, subset FROM images WHERE subset <> 'train' AND pid IN (SELECT pid FROM drawn)"""
)
def id_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.id_subset(_slim(spark, sf_dir, "query"), _slim(spark, sf_dir, "gallery"), 4, 7).select("image_idx", "pid", "subset")


@query(f"WITH {IMAGES} SELECT count(*) AS n_leaks FROM (SELECT path FROM images WHERE subset = 'train' INTERSECT SELECT path FROM images WHERE subset <> 'train')")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _slim(spark, sf_dir)
    return identity.leaks(every.where("subset = 'train'"), every.where("subset <> 'train'")).agg(F.count("*").alias("n_leaks"))


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    p AS (SELECT a.image_idx, EXISTS (SELECT 1 FROM t b WHERE b.pid = a.pid AND b.camid <> a.camid) AS hit FROM t a)
    SELECT count(*) AS n_images, count(*) FILTER (hit) AS n_pairable, round(count(*) FILTER (hit) / count(*), 6) AS share FROM p"""
)
def pairable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.pairable_share(_slim(spark, sf_dir, "train"))


@query(
    f"""WITH {IMAGES}, s AS (SELECT DISTINCT pid, camid FROM images WHERE subset = 'train')
    SELECT a.camid AS cam_a, b.camid AS cam_b, count(*) AS n_ids FROM s a JOIN s b ON a.pid = b.pid AND a.camid < b.camid GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def camera_pair_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.camera_pair_domains(_slim(spark, sf_dir, "train"), 3)


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    s AS (SELECT DISTINCT pid, camid FROM t),
    dom AS (SELECT a.camid AS cam_a, b.camid AS cam_b FROM s a JOIN s b ON a.pid = b.pid AND a.camid < b.camid GROUP BY 1, 2 HAVING count(*) >= 3),
    sh AS (SELECT d.cam_a, d.cam_b, a.pid FROM dom d JOIN s a ON a.camid = d.cam_a JOIN s b ON b.camid = d.cam_b AND b.pid = a.pid),
    n AS (SELECT pid, camid, image_idx, row_number() OVER (PARTITION BY pid, camid ORDER BY md5(concat_ws(':', '5', CAST(image_idx AS VARCHAR))), image_idx) AS rn FROM t)
    SELECT cam_a, cam_b, sh.pid, 2 * (rn - 1) + CAST(n.camid = cam_b AS BIGINT) AS slot, image_idx
    FROM sh JOIN n ON n.pid = sh.pid AND n.camid IN (cam_a, cam_b) WHERE 2 * (rn - 1) + CAST(n.camid = cam_b AS BIGINT) < 4"""
)
def camera_pair_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.camera_pair_images(_slim(spark, sf_dir, "train"), 3, 4, 5)


@query(f"WITH {IMAGES} SELECT pid, dense_rank() OVER (ORDER BY pid) - 1 AS label FROM (SELECT DISTINCT pid FROM images)")
def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.dense_relabel(_slim(spark, sf_dir))


@query(
    f"""WITH {IMAGES}, t AS (SELECT subset AS domain, max(pid) AS max_pid FROM images GROUP BY subset)
    SELECT domain, max_pid, CAST(coalesce(sum(max_pid + 1) OVER (ORDER BY domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pid_offset FROM t"""
)
def pid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.pid_offsets(_slim(spark, sf_dir).withColumnRenamed("subset", "domain"))


@query(f"WITH {IMAGES}, f AS (SELECT pid, min(image_idx) AS first_idx FROM images GROUP BY pid) SELECT pid, first_idx, row_number() OVER (ORDER BY first_idx) - 1 AS seen_id FROM f")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.first_seen_ids(_slim(spark, sf_dir))


_REFERENCE = [("query", 10, None), ("gallery", 10, 200), ("train", 11, None), ("spare", None, None)]


def _reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REFERENCE, "domain string, n_ids long, n_images long")


_CHECKS = """reference(domain, n_ids, n_images) AS (VALUES ('query', 10, NULL), ('gallery', 10, 200), ('train', 11, NULL), ('spare', NULL, NULL)),
    actual AS (SELECT subset AS domain, count(DISTINCT pid) AS n_ids, count(*) AS n_images FROM images GROUP BY subset),
    checks AS (SELECT a.domain, a.n_ids, a.n_images, (r.n_ids IS NULL OR r.n_ids = a.n_ids) AND (r.n_images IS NULL OR r.n_images = a.n_images) AS ok
               FROM actual a LEFT JOIN reference r ON a.domain = r.domain)"""


@query(f"WITH {IMAGES}, {_CHECKS} SELECT * FROM checks")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = identity.subset_stats(_slim(spark, sf_dir).withColumnRenamed("subset", "domain"), "domain")
    return identity.reference_check(actual, _reference(spark), "domain", ("n_ids", "n_images"))


@query(
    f"""WITH {IMAGES}, {_CHECKS}
    SELECT r.domain, coalesce(c.n, 0) AS n_splits, CASE WHEN c.all_ok IS NULL THEN 'MISSING' WHEN c.all_ok THEN 'OK' ELSE 'MISMATCH' END AS verdict
    FROM reference r LEFT JOIN (SELECT domain, bool_and(ok) AS all_ok, count(*) AS n FROM checks GROUP BY domain) c ON r.domain = c.domain"""
)
def domain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.domain_verdict(reference_check(spark, sf_dir), _reference(spark).select("domain"))


@query(
    f"""WITH {IMAGES}
    SELECT pid, list(path ORDER BY image_idx) AS paths, list(camid ORDER BY image_idx) AS cams FROM images WHERE subset = 'train' GROUP BY pid"""
)
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_groups(_slim(spark, sf_dir, "train"))


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'),
    e AS (SELECT pid FROM t GROUP BY pid HAVING count(DISTINCT camid) >= 2)
    SELECT a.pid, a.image_idx AS a_idx, b.image_idx AS b_idx FROM t a JOIN t b ON a.pid = b.pid AND a.image_idx < b.image_idx WHERE a.pid IN (SELECT pid FROM e)"""
)
def within_identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.within_identity_pairs(_slim(spark, sf_dir, "train"))


@query(
    f"""WITH {RUNS}, u AS (SELECT DISTINCT split, domain FROM runs)
    SELECT a.split, a.domain AS src, b.domain AS dst FROM u a JOIN u b ON a.split = b.split AND a.domain <> b.domain"""
)
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.transfer_pairs(run_rows(spark, sf_dir))


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages),
    l AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS last_part FROM p)
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, path, last_part,
           regexp_extract(last_part, '(-?\d+)', 1) AS number FROM l"""
)
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_urls(table(spark, sf_dir, "pages"))
