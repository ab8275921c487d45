"""Catalogue operators: eligibility, integrity checks, label assignment, camera-pair domains, pairs within identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vistrel.functions.draw import draw_key
from vistrel.session import written


def subset_stats(images: DataFrame, *by: str) -> DataFrame:
    return images.groupBy(*by).agg(F.countDistinct("pid").alias("n_ids"), F.count("*").alias("n_images"), F.countDistinct("camid").alias("n_cams"))


def eligible_identities(images: DataFrame, cameras: int = 2) -> DataFrame:
    """Identities that were seen by so many cameras at least."""
    return images.groupBy("pid").agg(F.countDistinct("camid").alias("n_cams")).where(F.col("n_cams") >= cameras)


def multi_image_identities(images: DataFrame, least: int = 2) -> DataFrame:
    return images.groupBy("pid").agg(F.count("*").alias("n_images")).where(F.col("n_images") >= least)


def drop_junk(images: DataFrame) -> DataFrame:
    """Without the junk identities, whose number is negative."""
    return images.where("pid >= 0")


def id_subset(queries: DataFrame, gallery: DataFrame, max_ids: int, seed: int) -> DataFrame:
    """Query and gallery rows of max_ids drawn identities that both have."""
    shared = queries.select("pid").intersect(gallery.select("pid"))
    drawn = shared.orderBy(draw_key(seed, "pid"), "pid").limit(max_ids)
    return queries.unionByName(gallery).join(drawn, "pid", "left_semi")


def leaks(pool: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Paths of the pool that the evaluation uses too; must be empty."""
    return pool.select("path").join(evaluation.select("path"), "path", "left_semi").distinct()


def partners(images: DataFrame, cross_camera: bool = True) -> DataFrame:
    """Images that have another image of their identity, from another camera where that is asked for.

    An identity is counted once and joined back, so its number of images is never squared.
    """
    per_id = images.groupBy("pid").agg(F.count("*").alias("_n"), F.countDistinct("camid").alias("_cams"))
    return images.join(per_id, "pid").where("_cams > 1" if cross_camera else "_n > 1").drop("_n", "_cams")


def pairable_share(images: DataFrame, cross_camera: bool = True) -> DataFrame:
    kept = partners(images, cross_camera).select("image_idx", F.lit(1).alias("hit"))
    return images.join(kept, "image_idx", "left").agg(F.count("*").alias("n_images"), F.count("hit").alias("n_pairable"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


def camera_pair_domains(images: DataFrame, min_ids: int) -> DataFrame:
    """(cam_a, cam_b, n_ids): pairs of cameras that share enough identities to be a domain of their own."""
    seen = images.select("pid", "camid").distinct()
    other = seen.select("pid", F.col("camid").alias("cam_b"))
    return seen.withColumnRenamed("camid", "cam_a").join(other, "pid").where("cam_a < cam_b").groupBy("cam_a", "cam_b").agg(F.count("*").alias("n_ids")).where(F.col("n_ids") >= min_ids)


def camera_pair_images(images: DataFrame, min_ids: int, per_id: int, seed: int) -> DataFrame:
    """Samples of the camera-pair domains: per identity, images that alternate between the two cameras."""
    domains = camera_pair_domains(images, min_ids).select("cam_a", "cam_b")
    by = W.Window.partitionBy("pid", "camid").orderBy(draw_key(seed, "image_idx"), "image_idx")
    ranked = images.select("pid", "camid", "image_idx", F.row_number().over(by).alias("_rn")).where(F.col("_rn") <= (per_id + 1) // 2)
    a, b = ranked.withColumnRenamed("camid", "cam_a"), ranked.withColumnRenamed("camid", "cam_b")
    shared = a.select("pid", "cam_a").distinct().join(b.select("pid", "cam_b").distinct(), "pid").join(F.broadcast(domains), ["cam_a", "cam_b"])
    slots = lambda df, cam, shift: shared.join(df, ["pid", cam]).select("cam_a", "cam_b", "pid", (2 * (F.col("_rn") - 1) + shift).cast("long").alias("slot"), "image_idx")
    return slots(a, "cam_a", 0).unionByName(slots(b, "cam_b", 1)).where(F.col("slot") < per_id)


def numbered(df: DataFrame, name: str, part: Column, *order: str) -> DataFrame:
    """df with the place from 0 of each row in an order. ``part`` rises with the order: each part numbers its own rows, and only the
    parts' counts are added up in one place."""
    spread = df.withColumn("_part", part)
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_rn", rank).join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name))


def numbered_within(df: DataFrame, name: str, by: str, part: Column, *order: str) -> DataFrame:
    """The same within each value of ``by``: a large group is numbered by parts, too."""
    spread = df.withColumn("_part", part)
    before = W.Window.partitionBy(by).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = spread.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.Window.partitionBy(by, "_part").orderBy(*order))
    return spread.withColumn("_rn", rank).join(offsets, [by, "_part"]).select(*df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name))


def by_thousands(column: str) -> Column:
    """Parts of 4096 neighbouring numbers."""
    return F.floor(F.col(column) / 4096)


def dense_relabel(images: DataFrame) -> DataFrame:
    """Distinct identities with labels 0..n-1 in their order."""
    return numbered(images.select("pid").distinct(), "label", by_thousands("pid"), "pid")


def pid_offsets(domains: DataFrame) -> DataFrame:
    """(domain, max_pid, pid_offset): each domain's identities start after those of the domains before it."""
    top = domains.groupBy("domain").agg(F.max("pid").alias("max_pid"))
    before = W.Window.orderBy("domain").rowsBetween(W.Window.unboundedPreceding, -1)
    return top.withColumn("pid_offset", F.coalesce(F.sum(F.col("max_pid") + 1).over(before), F.lit(0)).cast("long"))


def first_seen_ids(images: DataFrame) -> DataFrame:
    """(pid, first_idx, seen_id): identities numbered in the order in which they first occur."""
    first = images.groupBy("pid").agg(F.min("image_idx").alias("first_idx"))
    return numbered(first, "seen_id", by_thousands("first_idx"), "first_idx")


def reference_check(actual: DataFrame, reference: DataFrame, by: str, measures: tuple[str, ...]) -> DataFrame:
    """Whether each measure equals its reference; a null reference is not checked."""
    ref = reference.select(by, *(F.col(m).alias(f"ref_{m}") for m in measures))
    ok = F.lit(True)
    for m in measures:
        ok = ok & (F.col(f"ref_{m}").isNull() | (F.col(f"ref_{m}") == F.col(m)))
    return actual.join(ref, by, "left").select(by, *measures, ok.alias("ok"))


def domain_verdict(checks: DataFrame, wanted: DataFrame) -> DataFrame:
    """OK, MISMATCH or MISSING for each wanted domain over all its splits."""
    folded = checks.groupBy("domain").agg(F.bool_and("ok").alias("all_ok"), F.count("*").alias("n_splits"))
    verdict = F.when(F.col("all_ok").isNull(), "MISSING").when(F.col("all_ok"), "OK").otherwise("MISMATCH")
    return wanted.join(folded, "domain", "left").select("domain", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), verdict.alias("verdict"))


def identity_groups(images: DataFrame) -> DataFrame:
    """Images of each identity as parallel lists in their order."""
    items = F.array_sort(F.collect_list(F.struct("image_idx", "path", "camid")))
    return images.groupBy("pid").agg(items.alias("items")).select("pid", F.col("items.path").alias("paths"), F.col("items.camid").alias("cams"))


def within_identity_pairs(images: DataFrame) -> DataFrame:
    """Unordered image pairs of the identities that two cameras saw."""
    kept = images.join(eligible_identities(images).select("pid"), "pid", "left_semi").select("pid", "image_idx")
    return kept.withColumnRenamed("image_idx", "a_idx").join(kept.withColumnRenamed("image_idx", "b_idx"), "pid").where("a_idx < b_idx")


def listed_groups(rows: DataFrame, *by: str) -> DataFrame:
    """(by.., n) of each group, in the order of the keys."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)


def sorted_distinct(rows: DataFrame, column: str) -> DataFrame:
    """(column, place) of the distinct values in their order, numbered by ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.select(column).distinct().repartitionByRange(parts, column).withColumn("_range", F.spark_partition_id()), "distinct")
    return numbered(ranged, "place", F.col("_range"), column).select(column, "place")


def path_lookup(images: DataFrame, places: DataFrame) -> DataFrame:
    """images with the place of their path; a path that has none is left out."""
    return images.join(places, "path")


def load_split(images: DataFrame, split: int) -> DataFrame:
    """The cached images of one split (columns split, subset); a pool image that the evaluation uses too is an error."""
    one = images.where(F.col("split") == split).cache()
    if not leaks(one.where("subset = 'train'"), one.where("subset <> 'train'")).isEmpty():
        one.unpersist()
        raise ValueError(f"split {split} has images both in the pool and in the evaluation")
    return one
