"""Source and sink queries: path grammars, manifests, combined subsets, merged tables, and files written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.plans.registry import query
from vistrel.session import fresh_folder
from vistrel.sources import readers, sinks, versions
from vistrel.sources.views import IMAGES, RUNS, images, runs, table


@query(f"WITH {IMAGES} SELECT concat('r/', pid, '/', camid // 2 + 1, '_', pid, '_', camid % 2 + 1, '_', image_idx, '.jpg') AS path, pid, camid FROM images")
def camera_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names <pid>/<pair>_<pid>_<cam>_<idx>.jpg made of the images, and read again."""
    shown = images(spark, sf_dir, feat=False)
    name = F.concat_ws("_", F.floor(F.col("camid") / 2) + 1, F.col("pid"), F.col("camid") % 2 + 1, F.col("image_idx"))
    return readers.parse_camera_path(shown.select(F.concat(F.lit("r/"), F.col("pid"), F.lit("/"), name, F.lit(".jpg")).alias("path")))


@query(
    f"""WITH {IMAGES} SELECT CASE image_idx % 3 WHEN 0 THEN concat('x/', pid, '_', image_idx, '.png') ELSE concat('x/', pid, '/c', image_idx, '.png') END AS path, pid, 2 AS camid
    FROM images WHERE image_idx % 3 < 2"""
)
def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity in the name, in the folder, or a junk name that goes."""
    i, pid = F.col("image_idx"), F.col("pid").cast("string")
    path = F.when(i % 3 == 0, F.concat(F.lit("x/"), pid, F.lit("_"), i, F.lit(".png"))).when(i % 3 == 1, F.concat(F.lit("x/"), pid, F.lit("/c"), i, F.lit(".png"))).otherwise(F.concat(F.lit("x/-1_"), i, F.lit(".png")))
    return readers.parse_prefixed_path(images(spark, sf_dir, feat=False).select(path.alias("path")), 2)


_SHAPES = ("a/b{}.jpg", "/a/b{}.jpg", "a/../b{}.jpg", "../b{}.jpg", "a/..b{}.jpg", "C:/b{}.jpg", "a/b{}/..")
_PATHS = "paths AS (SELECT replace([" + ", ".join(f"'{s}'" for s in _SHAPES) + "][CAST(event_id % 7 AS INTEGER) + 1], '{}', CAST(event_id AS VARCHAR)) AS path FROM events)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select(F.replace(shape, F.lit("{}"), F.col("event_id").cast("string")).alias("path"))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path LIKE '/%' OR path LIKE '_:%' OR list_contains(string_split(path, '/'), '..')")
def unsafe_manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.unsafe_paths(_paths(spark, sf_dir))


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE path NOT IN (SELECT 'a/b' || event_id || '.jpg' FROM events WHERE event_id % 14 = 0)")
def missing_manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "events").where("event_id % 14 = 0").select(F.concat(F.lit("a/b"), F.col("event_id"), F.lit(".jpg")).alias("path"))
    return readers.missing_files(_paths(spark, sf_dir), listing)


@query(f"WITH {IMAGES} SELECT image_idx, dense_rank() OVER (ORDER BY pid) - 1 AS pid, subset FROM images")
def combined_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, query and gallery as one source with identities numbered anew."""
    return readers.combine_all(*(images(spark, sf_dir, s, feat=False).select("image_idx", "pid", "subset") for s in ("train", "query", "gallery")))


@query("SELECT c_custkey AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) ELSE -1 END AS value FROM customer")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their last order where they have one, over a table of all customers."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit(-1).cast("long").alias("value"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_orderkey").alias("value"))
    path = fresh_folder(spark, "upserts")
    versions.create_once(old, path)
    versions.upsert_rows(new.join(old.select("name"), "name", "left_semi"), path, "name")
    return versions.read_table(spark, path)


@query(
    """WITH rows AS (SELECT c_nationkey AS nation, c_custkey AS name FROM customer)
    SELECT CAST(1 AS BIGINT) AS version, count(*) AS n_rows, count(DISTINCT nation) AS n_nations, true AS created, false AS again, true AS refused FROM rows"""
)
def created_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers written as a table's first version; writing them again changes nothing, other rows are refused."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("name"))
    path = fresh_folder(spark, "created")
    made, again = versions.create_once(rows, path), versions.create_once(rows.orderBy("name"), path)
    try:
        versions.create_once(rows.withColumn("name", -F.col("name")), path)
        refused = False
    except ValueError:
        refused = True
    found = versions.current(spark, path)
    read = versions.read_table(spark, path).agg(F.count("*").alias("n_rows"), F.countDistinct("nation").alias("n_nations"))
    return read.select(F.lit(found[0]).cast("long").alias("version"), "n_rows", "n_nations", F.lit(made).alias("created"), F.lit(again).alias("again"), F.lit(refused).alias("refused"))


@query(f"WITH {RUNS}, d AS (SELECT domain, split, min(draw) AS status FROM runs WHERE condition = 'own' AND k = 4 GROUP BY domain, split) SELECT DISTINCT domain || split AS name FROM runs WHERE domain || split NOT IN (SELECT domain || split FROM d WHERE status = 0)")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task per domain and split; the least draw of its own runs stands for its status."""
    rows = runs(spark, sf_dir).withColumn("name", F.concat("domain", F.col("split").cast("string")))
    done = rows.where("condition = 'own' AND k = 4").groupBy("name").agg(F.min("draw").alias("status"))
    return sinks.todo(rows.select("name").distinct(), done)


@query(
    f"""WITH {RUNS} SELECT domain, k, round(avg(mAP), 6) AS mAP, NULL AS rank1 FROM runs GROUP BY domain, k
    UNION ALL SELECT domain, NULL, NULL, round(avg(rank1), 6) FROM runs GROUP BY domain"""
)
def joined_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with different columns under one header."""
    rows = runs(spark, sf_dir)
    return sinks.union_rows(rows.groupBy("domain", "k").agg(F.round(F.avg("mAP"), 6).alias("mAP")), rows.groupBy("domain").agg(F.round(F.avg("rank1"), 6).alias("rank1")))


@query(f"WITH {RUNS} SELECT domain, split, condition AS method, k, seed, rank1, CASE WHEN draw > 4 THEN mAP END AS mAP FROM runs")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows written as CSV with empty fields, and read again."""
    rows = runs(spark, sf_dir).select("domain", "split", F.col("condition").alias("method"), "k", "seed", "rank1", F.when(F.col("draw") > 4, F.col("mAP")).alias("mAP"))
    path = fresh_folder(spark, "runs-csv")
    sinks.to_csv(rows, path)
    return readers.run_csv(spark, path, "domain string, split long, method string, k long, seed long, rank1 double, mAP double")


@query(f"WITH {IMAGES} SELECT image_idx, feat FROM images")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "vectors")
    sinks.to_vectors(images(spark, sf_dir).select("image_idx", "feat"), path)
    return spark.read.parquet(path)


@query(f"WITH {RUNS} SELECT domain, split, round(avg(mAP), 6) AS mAP, count(*) AS n FROM runs GROUP BY domain, split")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries written as JSON and read again; doubles keep every digit, and are shown to six."""
    per = runs(spark, sf_dir).groupBy("domain", "split").agg(F.round(F.avg("mAP"), 6).alias("mAP"), F.count("*").alias("n"))
    path = fresh_folder(spark, "summary-json")
    sinks.to_json(per, path)
    return spark.read.schema("domain string, split long, mAP double, n long").json(path)
