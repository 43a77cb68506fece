"""Keeping tables of states: upsert, cascading delete, difference, growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The table after ``changes``: the row of greatest ``version`` per key, the change among equals."""
    columns = [c for c in table.columns if c not in keys]
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max(F.struct(version, "__new", *(c for c in columns if c != version))).alias("r"))
    return newest.select(*keys, *(f"r.{c}" for c in columns))


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").select(table.columns))


def delete_cascade(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that begin or end at one of ``gone (id)``."""
    ids = gone.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def as_of(spells: DataFrame, at: str) -> DataFrame:
    """``(id, kind, digest)`` of the vertices present at an instant; of several spells the latest."""
    t = F.lit(at).cast(spells.schema["indexed_at"].dataType)
    there = spells.where(F.col("id").isNotNull() & (F.col("indexed_at").isNull() | (F.col("indexed_at") <= t)) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)))
    digest = F.sha2(F.concat_ws("|", "type", "name", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string")), 256)
    return there.groupBy("id").agg(F.max(F.struct("indexed_at", F.col("type").alias("kind"), digest.alias("digest"))).alias("v")).select("id", "v.kind", "v.digest")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, kind, change)``: what was added, removed or changed between two states."""
    a, b = before.select("id", F.col("kind").alias("k1"), F.col("digest").alias("d1")), after.select("id", F.col("kind").alias("k2"), F.col("digest").alias("d2"))
    change = F.when(F.col("d1").isNull(), "added").when(F.col("d2").isNull(), "removed").when(F.col("d1") != F.col("d2"), "changed")
    return a.join(b, "id", "full").select("id", F.coalesce("k2", "k1").alias("kind"), change.alias("change")).where("change is not null")


def delete_by_prefix(edges: DataFrame, files: DataFrame, column: str = "source_id") -> DataFrame:
    """Edges without those whose id in ``column`` is ``fn:<path>:...`` for a path of ``files (file_path)``, by the exact path."""
    path = F.regexp_extract(column, "^fn:([^:]*):", 1)
    return edges.withColumn("__path", path).join(files.select(F.col("file_path").alias("__path")).distinct(), "__path", "left_anti").drop("__path")


def replace_files(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with all rows of each file of ``rows`` taken out and these put in; rows without a file stay."""
    files = rows.where("file_path is not null").select("file_path").distinct()
    return table.join(files, "file_path", "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def latest_snapshots(snapshots: DataFrame, by: str, at: str, k: int) -> DataFrame:
    """The ``k`` latest rows of ``snapshots`` of each ``by``, latest first, with their ``place``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))
    return snapshots.withColumn("place", place).where(F.col("place") <= k)
