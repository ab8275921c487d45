from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vistrel.sources import readers, sinks, versions


def test_path_grammars(spark):
    df = spark.createDataFrame([("r/7/2_7_1_03.jpg",), ("r/8/1_8_2_1.png",)], "path string")
    assert [tuple(r) for r in readers.parse_camera_path(df).collect()] == [("r/7/2_7_1_03.jpg", 7, 2), ("r/8/1_8_2_1.png", 8, 1)]
    df = spark.createDataFrame([("12_a.jpg",), ("x/-1_b.jpg",), ("x/44/c.jpg",)], "path string")
    assert [(r["path"], r["pid"]) for r in readers.parse_prefixed_path(df, 0).collect()] == [("12_a.jpg", 12), ("x/44/c.jpg", 44)]
    with pytest.raises(PySparkException):
        readers.parse_prefixed_path(spark.createDataFrame([("x/y.jpg",)], "path string"), 0).collect()


def test_folder_scan(spark, tmp_path):
    (tmp_path / "5").mkdir()
    (tmp_path / "5" / "1_5_2_0.jpg").write_bytes(b"x")
    (tmp_path / "5" / "notes.txt").write_bytes(b"x")
    rows = readers.read_domain(spark, "camera_folders", str(tmp_path)).collect()
    assert [(r["pid"], r["camid"]) for r in rows] == [(5, 1)]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_domain(spark, "nowhere", str(tmp_path))


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text(json.dumps([{"train": [["a.jpg", 1, 0]], "query": [["../b.jpg", 2, 1]], "gallery": []}, {"train": [], "query": [], "gallery": [["/c.jpg", 3, 1]]}]))
    m = readers.split_manifest(spark, str(f))
    assert {tuple(r) for r in m.collect()} == {(0, "train", 0, "a.jpg", 1, 0), (0, "query", 0, "../b.jpg", 2, 1), (1, "gallery", 0, "/c.jpg", 3, 1)}
    assert {r["path"] for r in readers.unsafe_paths(m).collect()} == {"../b.jpg", "/c.jpg"}
    assert readers.missing_files(m, spark.createDataFrame([("a.jpg",)], "path string")).count() == 2


def test_runs_and_logs(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("domain,split,method,k,seed,rank1,rank5,rank10,mAP\nv,0,first,4,0,1.5,,3,nan\n")
    row = readers.run_csv(spark, str(tmp_path / "runs.csv")).first()
    assert row["rank1"] == 1.5 and row["rank5"] is None and row["mAP"] != row["mAP"]
    assert readers.optional_csv(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "val_mAP": 5.0}]}))
    log = readers.log_history(spark, str(tmp_path / "run1"), ("loss", "val_mAP"))
    assert [(r["run"], r["step"], r["value"]) for r in readers.curve(log, "val_mAP").collect()] == [("run1", 2, 5.0)]


def test_hash_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    m = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in readers.verify_hashes(spark, str(tmp_path), m).collect()} == {"a.bin": True, "b.bin": False}


def test_options():
    assert readers.domain_option("none", ["a"]) == []
    assert readers.domain_option("", ["a"]) == ["a"]
    assert readers.domain_option("b, c", ["a"]) == ["b", "c"]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, [3, 4])], "k long, ids array<long>")
    b = spark.createDataFrame([(2, 0.5)], "k long, m double")
    sinks.to_csv(sinks.union_rows(a, b), str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert {tuple(r) for r in back.collect()} == {("1", "3 4", None), ("2", None, "0.5")}
    old = spark.createDataFrame([("A", "1"), ("B", "2")], "name string, value string")
    new = spark.createDataFrame([("B", "3")], "name string, value string")
    assert {tuple(r) for r in sinks.upsert(old, new, "name").collect()} == {("A", "1"), ("B", "3")}
    done = spark.createDataFrame([("A", 0), ("B", 1)], "name string, status int")
    assert [r["name"] for r in sinks.todo(old, done).collect()] == ["B"]
    assert sinks.markdown(b).splitlines()[-1] == "| 2 | 0.50 |"


def test_splits_and_folders(spark, tmp_path):
    from vistrel.operators.identity import load_split

    rows = [(0, "train", "a"), (0, "query", "b"), (1, "train", "a"), (1, "gallery", "a")]
    images = spark.createDataFrame(rows, "split int, subset string, path string")
    assert load_split(images, 0).count() == 2
    with pytest.raises(ValueError, match="split 1"):
        load_split(images, 1)
    for d in ("val_b", "val_a", "other"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.json").write_text("{}")
    assert [r["name"] for r in readers.folders(spark, str(tmp_path), "val_").collect()] == ["val_a", "val_b"]


def test_task_plan_and_repeated_names(spark):
    lines = ["a | x", "a | y", "@wait", "b | z"]
    plan = readers.task_plan(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    assert [(r["group"], r["name"]) for r in plan.orderBy("line_no").collect()] == [(0, "a"), (0, "a"), (1, "b")]
    assert [r["name"] for r in readers.repeated_names(plan).collect()] == ["a"]


def test_task_plan_numbers_groups_with_tasks_and_refuses_bad_lines(spark):
    from pyspark.errors import PySparkException

    def plan(*lines):
        return readers.task_plan(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))

    got = plan("@wait", "a | x", "@wait", "# none", "@wait", "b.2-c | y | z")
    assert [tuple(r) for r in got.orderBy("line_no").collect()] == [(1, 0, "a", "x"), (5, 1, "b.2-c", "y | z")]
    for bad, why in (("no bar here", "expected"), ("bad name! | x", "bad task name"), ("| x", "bad task name")):
        with pytest.raises(PySparkException, match=why):
            plan("a | x", bad).collect()


def test_combined_subsets_number_identities_anew(spark):
    a, b = (spark.createDataFrame(rows, "pid long, image_idx long") for rows in ([(7, 1), (90_000, 2)], [(7, 3), (12, 4)]))
    got = readers.combine_all(a, b)
    assert got.columns == ["pid", "image_idx"] and {tuple(r) for r in got.collect()} == {(0, 1), (2, 2), (0, 3), (1, 4)}


def test_equal_names_in_two_folders(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.bin").write_bytes(d.encode())
    m = spark.createDataFrame([(f"{d}/f.bin", hashlib.sha256(b"x").hexdigest()) for d in ("x", "y")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in readers.verify_hashes(spark, str(tmp_path), m).collect()} == {"x/f.bin": True, "y/f.bin": False}


def test_json_vectors_and_long_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5]), (2, None)], "k long, v array<double>")
    sinks.to_json(df, str(tmp_path / "j"), single=True)
    assert {(r["k"], tuple(r["v"] or ())) for r in spark.read.json(str(tmp_path / "j")).collect()} == {(1, (0.5, 1.5)), (2, ())}
    sinks.to_vectors(df, str(tmp_path / "p"))
    assert {(r["k"], tuple(r["v"] or ())) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, (0.5, 1.5)), (2, ())}
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.markdown(df.select("k"), most=1)


def test_option_lists(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("1, 2,,3",)], "o string").select(readers.option_list(F.col("o"), "int").alias("i"), readers.option_list(F.col("o"), "double").alias("d")).first()
    assert row["i"] == [1, 2, 3] and row["d"] == [1.0, 2.0, 3.0]


def together(*jobs):
    """What jobs return or raise that begin at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    def outcome(job):
        try:
            return job()
        except Exception as e:  # to be looked at by the test
            return e

    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(outcome, jobs))


def test_created_once(spark, tmp_path):
    """Of writers of equal rows one writes and the others find theirs there; other rows are an error, also in the same moment."""
    path = str(tmp_path / "t")
    rows = spark.range(50).selectExpr("id", "cast(id % 7 as double) AS v", "array(id, null) AS a", "if(id = 3, null, 'x') AS s")
    assert sorted(together(*[lambda: versions.create_once(rows, path)] * 4)) == [False, False, False, True]
    assert versions.create_once(rows.repartition(5).orderBy("v"), path) is False
    for other in (rows.where("id > 0"), rows.union(rows.limit(1)), rows.withColumn("v", F.col("v") + 1), rows.withColumnRenamed("v", "w"), rows.withColumn("s", F.lit("x"))):
        with pytest.raises(ValueError, match="other rows"):
            versions.create_once(other, path)
    assert versions.read_table(spark, path).exceptAll(rows).isEmpty()
    mixed = together(*[lambda k=k: versions.create_once(spark.range(k), str(tmp_path / "u")) for k in (3, 4)])
    assert sum(m is True for m in mixed) == 1 and sum(isinstance(m, ValueError) for m in mixed) == 1
    names = {f.name.split("-")[0] for f in (tmp_path / "t").iterdir() if not f.name.startswith(".")}
    assert names == {"version", "rows"} and sum(f.name.startswith("rows-") for f in (tmp_path / "t").iterdir()) == 1  # losers leave nothing


def test_upserts_at_once(spark, tmp_path):
    """Changes that meet are all in the newest version; each version stays readable."""
    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(rows, "name string, value long")
    assert versions.upsert_rows(table(("a", 1), ("b", 2)), path, "name") == 1
    got = together(lambda: versions.upsert_rows(table(("b", 20)), path, "name"), lambda: versions.upsert_rows(table(("c", 30), (None, 5)), path, "name"), lambda: versions.upsert_rows(table(("d", 40)), path, "name"))
    assert sorted(got) == [2, 3, 4]
    assert {tuple(r) for r in versions.read_table(spark, path).collect()} == {("a", 1), ("b", 20), ("c", 30), ("d", 40), (None, 5)}
    assert versions.upsert_rows(table((None, 6)), path, "name") == 5
    assert {tuple(r) for r in versions.read_table(spark, path).where("name is null").collect()} == {(None, 6)}
    assert {tuple(r) for r in versions.read_table(spark, path, 1).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError, match="repeat"):
        versions.upsert_rows(table(("a", 1), ("a", 2)), path, "name")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, str(tmp_path / "none"))
