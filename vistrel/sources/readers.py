"""Readers: image catalogues from path names, manifests, run CSVs, training logs, task plans, file listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Readers by domain name; register() adds one.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        READERS[name] = fn
        return fn

    return add


def read_domain(spark: SparkSession, name: str, root: str) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no reader for {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, root)


def files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Paths below root without their contents."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def parse_camera_path(paths: DataFrame) -> DataFrame:
    """path, pid, camid of names <pid>/<pair>_<pid>_<cam>_<idx>.<ext>: camera = (pair - 1) * 2 + cam - 1."""
    part = F.split(base_name(F.col("path")), "_")
    return paths.select(
        "path",
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).cast("long").alias("pid"),
        ((F.try_element_at(part, F.lit(1)).cast("int") - 1) * 2 + F.try_element_at(part, F.lit(3)).cast("int") - 1).alias("camid"),
    )


def parse_prefixed_path(paths: DataFrame, camid: int) -> DataFrame:
    """path, pid, camid of names that start with the identity, else of folders that do; an unreadable path fails, junk (< 0) goes."""
    in_name, in_folder = F.regexp_extract(base_name(F.col("path")), r"^(-?\d+)_", 1), F.regexp_extract("path", r"(?:^|/)(-?\d+)/[^/]+$", 1)
    pid = F.when(in_name != "", in_name).when(in_folder != "", in_folder).otherwise(F.raise_error(F.concat(F.lit("no identity in "), F.col("path"))).cast("string"))
    return paths.select("path", pid.cast("long").alias("pid"), F.lit(camid).alias("camid")).where("pid >= 0")


@register("camera_folders")
def camera_folders(spark: SparkSession, root: str) -> DataFrame:
    return parse_camera_path(files(spark, root, "*.{jpg,jpeg,png,bmp}"))


@register("prefixed_folders")
def prefixed_folders(spark: SparkSession, root: str) -> DataFrame:
    return parse_prefixed_path(files(spark, root, "*.{jpg,jpeg,png,bmp}"), 0)


def combine_subsets(*subsets: DataFrame) -> DataFrame:
    """Train, query and gallery of a source domain as one set."""
    out = subsets[0]
    for s in subsets[1:]:
        out = out.unionByName(s)
    return out


def combine_all(*subsets: DataFrame) -> DataFrame:
    """combine_subsets with identities numbered anew from 0, in the order of their old numbers over all subsets."""
    from vistrel.operators.identity import dense_relabel

    union = combine_subsets(*subsets)
    labels = dense_relabel(union)
    return union.join(labels, "pid").select(*(F.col("label").alias("pid") if c == "pid" else F.col(c) for c in union.columns))


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, subset, pos, path, pid, camid) of a JSON array of {train, query, gallery}, each a list of [path, pid, camid]."""
    raw = spark.read.text(path, wholetext=True)
    item = "array<array<string>>"
    parsed = raw.select(F.posexplode(F.from_json("value", f"array<struct<train:{item},query:{item},gallery:{item}>>")).alias("split", "s"))
    parts = [parsed.select("split", F.lit(c).alias("subset"), F.posexplode(f"s.{c}").alias("pos", "t")) for c in ("train", "query", "gallery")]
    return combine_subsets(*parts).select("split", "subset", "pos", F.get("t", F.lit(0)).alias("path"), F.get("t", F.lit(1)).cast("long").alias("pid"), F.get("t", F.lit(2)).cast("int").alias("camid"))


def unsafe_paths(manifest: DataFrame) -> DataFrame:
    """Rows whose path is absolute or leaves its folder; must be empty."""
    return manifest.where(F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").rlike(r"^[A-Za-z]:"))


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is not in a listing of names; must be empty."""
    return manifest.join(listing.select(F.col("path").alias("_there")), F.col("path") == F.col("_there"), "left_anti")


RUN_SCHEMA = "domain string, split long, method string, k long, seed long, rank1 double, rank5 double, rank10 double, mAP double"


def run_csv(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Evaluation rows with a header; empty and `nan` fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "nan").csv(path)


def optional_csv(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """run_csv, or no rows where there is no such file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return run_csv(spark, path, schema) if there else spark.createDataFrame([], schema)


def log_history(spark: SparkSession, path: str, metrics: tuple[str, ...]) -> DataFrame:
    """(file, run, step, metrics..) of training-log JSON files; a metric that a point lacks is null."""
    fields = ",".join(["step:long", "epoch:double", *(f"{m}:double" for m in metrics)])
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"struct<log_history:array<struct<{fields}>>>").alias("j"))
    points = raw.select("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("run"), F.explode("j.log_history").alias("p"))
    return points.select("file", "run", "p.step", *(F.col(f"p.{m}") for m in metrics))


def curve(log: DataFrame, metric: str) -> DataFrame:
    """(run, step, value) of the points that have the metric."""
    return log.where(F.col(metric).isNotNull()).select("run", "step", F.col(metric).alias("value"))


def task_plan(lines: DataFrame) -> DataFrame:
    """(line_no, group, name, command) of lines (line_no, value) `name | command`; `@wait` starts a group, # a comment.

    Groups without a task get no number. A line without `|` and a name with other characters than letters, digits, `_`, `.` and
    `-` are errors.
    """
    text = F.trim("value")
    kept = lines.select("line_no", text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    barrier = F.sum((F.col("t") == "@wait").cast("long")).over(W.Window.orderBy("line_no"))
    parted = kept.select("line_no", barrier.alias("_after"), "t").where("t <> '@wait'")
    numbered = parted.select("line_no", (F.dense_rank().over(W.Window.orderBy("_after")) - 1).cast("long").alias("group"), "t")
    name, place = F.trim(F.split_part("t", F.lit("|"), F.lit(1))), F.concat(F.lit("line "), F.col("line_no"), F.lit(": "))
    checked = (
        F.when(~F.contains("t", F.lit("|")), F.raise_error(F.concat(place, F.lit("expected '<name> | <command>' or '@wait'"))).cast("string"))
        .when(~name.rlike("^[A-Za-z0-9_.-]+$"), F.raise_error(F.concat(place, F.lit("bad task name "), name)).cast("string"))
        .otherwise(name)
    )
    return numbered.select("line_no", "group", checked.alias("name"), F.trim(F.regexp_replace("t", r"^[^|]*\|", "")).alias("command"))


def repeated_names(plan: DataFrame) -> DataFrame:
    return plan.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def verify_hashes(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(name, sha256, actual, ok) of a manifest (name, sha256) against the files below root; a name is the path from root on. A file is one
    cell of a row, so none may have more than 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr(F.col("path"), f"{root.rstrip('/').split('://')[-1]}/") + len(root.rstrip("/").split("://")[-1]) + 1
    found = found.select(F.col("path").substr(at, F.length("path")).alias("name"), F.sha2("content", 256).alias("actual"))
    return manifest.join(found, "name", "left").select("name", "sha256", "actual", F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)).alias("ok"))


def option_list(text: Column, kind: str) -> Column:
    """Values of a comma-separated option."""
    return F.transform(F.filter(F.split(text, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast(kind))


def domain_option(value: str, default: list[str]) -> list[str]:
    """`none` is no domain, nothing is the default, anything else a comma-separated list."""
    if value == "none":
        return []
    return [v.strip() for v in value.split(",") if v.strip()] or list(default)


def parse_urls(pages: DataFrame) -> DataFrame:
    """page_id, scheme, host, path, last part of the path, and its number."""
    url = F.col("url")
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return pages.select("page_id", F.regexp_extract(url, r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), path.alias("path"), last.alias("last_part"), F.regexp_extract(last, r"(-?\d+)", 1).alias("number"))


def folders(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(name) of the folders below root that start with a prefix and hold files, in their order."""
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files(spark, root).select(name.alias("name")).where(F.col("name").startswith(prefix)).distinct().orderBy("name")
