"""Tables that several writers may create and change at once.

A version is a folder of rows that nobody else writes to, and a manifest: a small file that names the folder and has the rows' schema, count and
content hash. A manifest comes into being whole and only once, under the version's number, so of two writers one is first and the other sees it.
Rows are never changed in place; readers of a version aren't disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that a change is tried anew because another writer was first.
TRIES = 20


class Folder:
    """A folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        """Of what lies in the folder."""
        if not self.fs.exists(self.at(self.path)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(self.path))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(f"{self.path}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Creates a file with its whole content, or returns False where one of that name is."""
        made, wanted = f"{self.path}/.{name}.{uuid.uuid4().hex}", f"{self.path}/{name}"
        self.fs.mkdirs(self.at(self.path))
        stream = self.fs.create(self.at(made), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() != "file":
                return bool(self.fs.rename(self.at(made), self.at(wanted)))  # false where the target is there
            local = lambda p: self.jvm.java.nio.file.Path.of(self.at(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.String, 0))
            try:  # a rename would replace the target on a local disk, a link does not
                self.jvm.java.nio.file.Files.createLink(local(wanted), local(made))
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
        finally:
            self.remove(made)

    def remove(self, path: str) -> None:
        if self.fs.exists(self.at(path)):
            self.fs.delete(self.at(path), True)


def content(df: DataFrame) -> dict:
    """Schema, count and a hash of the rows in any order, repeated ones included."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    one, two = (F.xxhash64(F.lit(seed), *cells) for seed in (1, 2))
    row = df.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(two).alias("xor")).first()
    return {"schema": df.schema.simpleString(), "rows": row["n"], "hash": f"{row['sum']}:{row['xor']}"}


def _manifests(folder: Folder) -> list[str]:
    return sorted(n for n in folder.names() if n.startswith("version-"))


def _name(version: int) -> str:
    return f"version-{version:09d}.json"


def current(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The newest version's number and manifest; None where there is none."""
    folder = Folder(spark, path)
    names = _manifests(folder)
    return (int(names[-1][8:17]), json.loads(folder.read(names[-1]))) if names else None


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the newest by default."""
    if version is None:
        if (found := current(spark, path)) is None:
            raise FileNotFoundError(f"{path} has no version")
        manifest = found[1]
    else:
        manifest = json.loads(Folder(spark, path).read(_name(version)))
    return spark.read.parquet(f"{path.rstrip('/')}/{manifest['folder']}")


def _offer(df: DataFrame, path: str, version: int) -> tuple[bool, dict]:
    """Writes the rows and tries to make them that version; the rows go again if another writer was first."""
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    name = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder.path}/{name}")
    manifest = {"folder": name, **content(spark.read.parquet(f"{folder.path}/{name}"))}
    if folder.create_once(_name(version), json.dumps(manifest)):
        return True, manifest
    folder.remove(f"{folder.path}/{name}")
    return False, manifest


def create_once(df: DataFrame, path: str) -> bool:
    """The table's first version. False if it is there with the same rows, by schema, count and hash; other rows are an error."""
    if current(df.sparkSession, path) is None:
        made, own = _offer(df, path, 1)
        if made:
            return True
    else:
        own = content(df)
    there = json.loads(Folder(df.sparkSession, path).read(_name(1)))
    if any(there[k] != own[k] for k in ("schema", "rows", "hash")):
        raise ValueError(f"{path} has other rows")
    return False


def upsert_rows(new: DataFrame, path: str, *key: str) -> int:
    """A new version in which the rows of ``new`` replace those with the same key; its number. Built anew on what another writer put first."""
    spark = new.sparkSession
    if new.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows repeat a key of {', '.join(key)}")
    for _ in range(TRIES):
        found = current(spark, path)
        version = found[0] + 1 if found else 1
        rows = new
        if found:
            old = read_table(spark, path, found[0])
            same = [old[k].eqNullSafe(new[k]) for k in key]
            rows = old.join(new, same, "left_anti").unionByName(new)
        if _offer(rows, path, version)[0]:
            return version
    raise RuntimeError(f"{path} was changed by others {TRIES} times in a row")
