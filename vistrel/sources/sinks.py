"""Sinks: CSV with its header rules, JSON, Parquet for vectors; tables with several writers are in versions.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with a header; arrays are joined by spaces, nulls are empty, columns beyond ``columns`` are ignored. ``single`` writes one file
    through one task, for a table that a person reads."""
    kinds = dict(df.dtypes)
    shown = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns or df.columns]
    out = df.select(shown)
    (out.coalesce(1) if single else out).write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def union_rows(*parts: DataFrame) -> DataFrame:
    """Rows of tables with different columns under the union of their headers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_json(df: DataFrame, path: str, single: bool = False) -> None:
    """A JSON object a line; null fields are left out."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def to_vectors(df: DataFrame, path: str) -> None:
    """Vectors with their keys as Parquet."""
    df.write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without the keys of the new ones, then the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def todo(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that have not ended with status 0."""
    return tasks.join(done.where("status = 0").select("name"), "name", "left_anti")


def markdown(df: DataFrame, digits: int = 2, most: int = 1000) -> str:
    """A table of at most ``most`` rows as Markdown; a longer one is an error."""
    kinds = dict(df.dtypes)
    rows = df.select(*(F.format_number(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in df.columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows)])
