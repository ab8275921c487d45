"""Queries over files that Spark writes from the given tables and reads again: logs, listings, hashes, selected columns; and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.functions.vector import flip_merge
from vistrel.operators import identity, runs, samples
from vistrel.plans.registry import query
from vistrel.session import fresh_folder
from vistrel.sources import readers, sinks
from vistrel.sources.views import IMAGES, RUNS, images, table
from vistrel.sources.views import runs as run_rows


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each kind and last digit of the user, with the training log of its events: two points of three have a metric."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("val_"), "event_type", F.col("user_id") % 10).alias("run"), "event_id", "value")
    point = F.struct(F.col("event_id").alias("step"), (F.col("event_id") / 100).alias("epoch"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("val_mAP"))
    logs = rows.groupBy("run").agg(F.to_json(F.struct(F.array_sort(F.collect_list(point)).alias("log_history"))).alias("value"))  # a run's points
    path = fresh_folder(spark, "training-logs")
    logs.write.partitionBy("run").text(path)
    return path


@query("SELECT 'run=val_' || event_type || user_id % 10 AS run, event_id AS step, value FROM events WHERE event_id % 3 > 0")
def log_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs written as JSON; the points that have the metric."""
    return readers.curve(readers.log_history(spark, f"{_logs(spark, sf_dir)}/*/*", ("val_mAP",)), "val_mAP")


@query("SELECT DISTINCT 'run=val_' || event_type || user_id % 10 AS name FROM events WHERE event_type LIKE 'p%'")
def log_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of the logs of some kinds."""
    return readers.folders(spark, _logs(spark, sf_dir), "run=val_p")


@query(
    """WITH f AS (SELECT c_nationkey AS nation, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS actual FROM customer GROUP BY c_nationkey)
    SELECT nation, actual, nation % 3 <> 0 AS ok FROM f"""
)
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of customers for each nation against a manifest in which every third hash is another one, and a name that no file has."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"), "c_custkey")
    path = fresh_folder(spark, "hashed")
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey").write.partitionBy("nation").text(path)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "value"))), lambda r: F.concat(r["value"], F.lit("\n"))), "")
    known = rows.groupBy("nation").agg(F.sha2(lines, 256).alias("sha256")).withColumn("sha256", F.when(F.col("nation") % 3 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    names = readers.files(spark, path).select(F.regexp_extract("path", r"(nation=[^/]+/[^/]+)$", 1).alias("name"))
    nation = F.regexp_extract("name", r"^nation=(\d+)/", 1).cast("long")
    manifest = names.withColumn("nation", nation).join(known.withColumn("nation", F.col("nation").cast("long")), "nation").select("name", "sha256")
    missing = manifest.limit(1).select(F.lit("nation=none/none").alias("name"), "sha256")
    checked = readers.verify_hashes(spark, path, manifest.unionByName(missing))
    return checked.where("ok OR actual IS NOT NULL").select(nation.alias("nation"), "actual", "ok")


@query(f"WITH {RUNS} SELECT domain, split, seed, round(avg(mAP), 6) AS mAP FROM runs GROUP BY domain, split, seed")
def csv_without_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns beyond the named ones are left out of a CSV."""
    rows = run_rows(spark, sf_dir).groupBy("domain", "split", "seed").agg(F.round(F.avg("mAP"), 6).alias("mAP"), F.max("rank1").alias("extra"), F.count("*").alias("n"))
    path = fresh_folder(spark, "named-csv")
    sinks.to_csv(rows, path, ["domain", "split", "seed", "mAP"])
    return spark.read.option("header", True).schema("domain string, split long, seed long, mAP double").csv(path)


@query(
    f"""WITH {RUNS}, a AS (SELECT domain, count(*) AS n, round(avg(mAP), 6) AS mAP FROM runs GROUP BY domain),
    l AS (SELECT 2 + row_number() OVER (ORDER BY domain) AS line_no, '| ' || domain || ' | ' || n || ' | ' || printf('%.3f', mAP) || ' |' AS line FROM a)
    SELECT 1 AS line_no, '| domain | n | mAP |' AS line UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT CAST(line_no AS INTEGER), line FROM l"""
)
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary with a row for each domain as lines of Markdown."""
    per = run_rows(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("mAP"), 6).alias("mAP")).orderBy("domain")
    lines = sinks.markdown(per, 3).splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@query(f"WITH {IMAGES} SELECT subset, count(*) AS n, count(DISTINCT pid) AS n_ids FROM images WHERE image_idx % 3 = 1 GROUP BY subset")
def loaded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of three splits, checked for images that are both in the pool and in the evaluation."""
    split = identity.load_split(images(spark, sf_dir, feat=False).withColumn("split", F.col("image_idx") % 3), 1)
    return split.groupBy("subset").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("n_ids"))


@query(f"WITH {IMAGES} SELECT pid, CAST(camid AS BIGINT) AS camid, count(*) AS n FROM images GROUP BY pid, camid")
def registered_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by pair, identity and camera, read by the reader that is registered under a domain's name."""
    shown = images(spark, sf_dir, feat=False)
    path = fresh_folder(spark, "camera-files")
    name = F.concat_ws("_", F.floor(F.col("camid") / 2) + 1, F.col("pid"), F.col("camid") % 2 + 1, F.col("image_idx"))
    shown.select(F.concat_ws("/", F.lit(path), F.col("pid").cast("string"), F.concat(name, F.lit(".jpg"))).alias("path")).write.text(f"{path}-names")
    readers.register("names")(lambda spark, root: readers.parse_camera_path(spark.read.text(root).withColumnRenamed("value", "path")))
    return readers.read_domain(spark, "names", f"{path}-names").groupBy("pid", F.col("camid").cast("long").alias("camid")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {IMAGES}, m AS (SELECT image_idx, list_transform(range(1, 65), lambda k: feat[k] + feat[65 - k]) AS v FROM images),
    u AS (SELECT image_idx, v, sqrt(list_dot_product(v, v)) AS n FROM m)
    SELECT image_idx, round(v[1] / n, 6) AS first, round(v[32] / n, 6) AS middle, round(v[64] / n, 6) AS last FROM u"""
)
def flip_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector merged with its reverse, which stands for that of the mirror image."""
    merged = images(spark, sf_dir).select("image_idx", flip_merge(F.col("feat"), F.reverse("feat")).alias("v"))
    at = lambda k, name: F.round(F.get("v", F.lit(k)), 6).alias(name)
    return merged.select("image_idx", at(0, "first"), at(31, "middle"), at(63, "last"))


@query(
    f"""WITH {RUNS}, s AS (SELECT domain, stddev_samp(mAP) AS total, stddev_samp(mAP) FILTER (condition = 'noise') AS noise FROM runs GROUP BY domain)
    SELECT domain, round(sqrt(greatest(total * total - noise * noise, 0)), 6) AS spread FROM s"""
)
def corrected_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a domain's spread without that of its noise runs; none where noise is the greater."""
    s = run_rows(spark, sf_dir).groupBy("domain").agg(F.stddev_samp("mAP").alias("total"), F.stddev_samp(F.when(F.col("condition") == "noise", F.col("mAP"))).alias("noise"))
    return s.select("domain", F.round(runs.noise_corrected(F.col("total"), F.col("noise")), 6).alias("spread"))


@query("SELECT s_suppkey AS i, [CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS BIGINT)] AS ints, [s_suppkey / 4, 0.5] AS reals FROM supplier")
def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated options with blanks, as whole and as real numbers."""
    rows = table(spark, sf_dir, "supplier")
    ints, reals = F.concat_ws(",", F.col("s_suppkey"), F.lit(" "), F.concat(F.lit(" "), F.col("s_nationkey"))), F.concat_ws(" , ", F.col("s_suppkey") / 4, F.lit("0.5"), F.lit(""))
    return rows.select(F.col("s_suppkey").alias("i"), readers.option_list(ints, "long").alias("ints"), readers.option_list(reals, "double").alias("reals"))


@query("SELECT 'task' || s_suppkey % 97 AS name, count(*) AS n FROM supplier GROUP BY s_suppkey % 97 HAVING count(*) > 1")
def repeated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task names that plans have in common; suppliers stand for tasks."""
    return readers.repeated_names(table(spark, sf_dir, "supplier").select(F.concat(F.lit("task"), F.col("s_suppkey") % 97).alias("name")))


@query(f"WITH {IMAGES} SELECT subset, pid, count(*) AS n FROM images GROUP BY subset, pid ORDER BY subset, pid")
def listed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their sizes in the order of their keys."""
    return identity.listed_groups(images(spark, sf_dir, feat=False), "subset", "pid")


@query(f"WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train') SELECT path, row_number() OVER (ORDER BY path) - 1 AS place, image_idx FROM t")
def path_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths in their order with their places, and looked up from the images."""
    train = images(spark, sf_dir, "train", feat=False)
    return identity.path_lookup(train, identity.sorted_distinct(train, "path")).select("path", "place", "image_idx")


@query(
    f"""WITH {IMAGES}, t AS (SELECT * FROM images WHERE subset = 'train'), k(k) AS (VALUES (4), (16), (100000))
    SELECT CAST(k AS BIGINT) AS k, (SELECT count(*) FROM t) >= k AS fits, least(k, (SELECT count(*) FROM t)) AS n_distinct, (SELECT count(*) FROM t) >= k AS valid FROM k"""
)
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a budget fits the pool, and whether the images drawn for it are as many, distinct and of the pool."""
    pool = images(spark, sf_dir, "train", feat=False).drop("pid").withColumn("domain", F.lit("embeddings"))
    drawn = [samples.draw_k(pool, "image_idx", k, 3).select(F.lit(k).cast("long").alias("k"), "image_idx") for k in (4, 16, 100_000)]
    return samples.budget_report(pool, drawn[0].unionByName(drawn[1]).unionByName(drawn[2]), "k")
