"""Logical inputs over the driver's tables: images, run logs, training logs, question scores.

The tables hold no people or cameras, so identity = label, camera = vec_id mod 4, and the subset follows from vec_id mod 5.
Each view exists twice: as a DataFrame and as the common table expression that an oracle starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrel.functions.vector import doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str, subset: str | None = None, feat: bool = True) -> DataFrame:
    """image_idx, pid, camid, path, subset and, where wanted, feat."""
    left = F.col("vec_id") % 5
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_idx"),
        F.col("label").cast("long").alias("pid"),
        (F.col("vec_id") % 4).cast("int").alias("camid"),
        F.concat(F.lit("img"), F.col("vec_id").cast("string")).alias("path"),
        F.when(left == 0, "query").when(left <= 2, "gallery").otherwise("train").alias("subset"),
        *([doubles(F.col("embedding")).alias("feat")] if feat else []),
    )
    return df.where(F.col("subset") == subset) if subset else df


IMAGES = """images AS (
    SELECT vec_id AS image_idx, CAST(label AS BIGINT) AS pid, CAST(vec_id % 4 AS INTEGER) AS camid, 'img' || vec_id AS path,
           CASE WHEN vec_id % 5 = 0 THEN 'query' WHEN vec_id % 5 <= 2 THEN 'gallery' ELSE 'train' END AS subset,
           CAST(embedding AS DOUBLE[]) AS feat
    FROM embeddings)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: domain, split, seed, draw, k, condition, mAP, rank1, n_pairs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("domain"),
        (F.col("user_id") % 10).alias("split"),
        (F.col("event_id") % 3).alias("seed"),
        (F.col("event_id") % 10).alias("draw"),
        F.when(F.col("event_id") % 2 == 0, 4).otherwise(16).cast("long").alias("k"),
        F.get(F.array(*map(F.lit, CONDITIONS)), (F.col("event_id") % 7).cast("int")).alias("condition"),
        F.col("value").alias("mAP"),
        (F.col("value") * 0.5 + F.col("event_id") % 11).alias("rank1"),
        (F.col("event_id") % 17).alias("n_pairs"),
    )


CONDITIONS = ("random", "first", "noise", "true", "shuffle", "zero", "own")
RUNS = f"""runs AS (
    SELECT event_type AS domain, user_id % 10 AS split, event_id % 3 AS seed, event_id % 10 AS draw,
           CAST(CASE WHEN event_id % 2 = 0 THEN 4 ELSE 16 END AS BIGINT) AS k,
           {list(CONDITIONS)}[CAST(event_id % 7 AS INTEGER) + 1] AS condition,
           value AS mAP, value * 0.5 + event_id % 11 AS rank1, event_id % 17 AS n_pairs
    FROM events)"""


def log_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log: run, step (by time), loss."""
    from pyspark.sql import window as W

    by = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(by).cast("long").alias("step"), F.col("value").alias("loss"))


LOG = """log AS (
    SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss
    FROM events)"""


def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: truth (0 or 1) and a score."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(
        F.col("doc_id").alias("q_idx"), "lang", F.col("quality").cast("long").alias("truth"), (F.col("n_chars") - 1500).cast("double").alias("score")
    )


QUESTIONS = """questions AS (
    SELECT l.doc_id AS q_idx, d.lang, CAST(l.quality AS BIGINT) AS truth, CAST(d.n_chars - 1500 AS DOUBLE) AS score
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
