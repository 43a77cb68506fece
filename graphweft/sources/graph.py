"""The code graph as DataFrames: current vertices, distinct edges, latest function states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import label
from .tables import table

_SHOWN = ("kind", "name", "file_path", "line_start", "line_end", "is_exported")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """``(id, kind, name, file_path, line_start, line_end, is_exported)`` of all vertices still there.

    Of several current rows of an id the latest counts; shared classes are always there.
    """
    nodes = table(spark, d, "nodes").where("deleted_at is null and id is not null").withColumnRenamed("type", "kind")
    current = nodes.groupBy("id").agg(F.max(F.struct("indexed_at", *_SHOWN)).alias("v")).select("id", *(f"v.{c}" for c in _SHOWN))
    classes = table(spark, d, "nodes_class").where("id is not null").withColumn("kind", F.lit("class"))
    return current.unionByName(classes.select("id", *_SHOWN))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``(source_id, target_id, type)``: every edge once, its type in one spelling, nothing null."""
    rows = table(spark, d, "edges").select("source_id", "target_id", label(F.col("type")).alias("type"))
    return rows.dropna().distinct()


def functions(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of every function with its metrics; NaN ranks are null."""
    shown = ("name", "file_path", "line_start", "line_end", "is_async", "is_exported", "community", "page_rank", "betweenness")
    rows = table(spark, d, "nodes_function").where("id is not null")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("page_rank", "betweenness") else F.col(c) for c in shown]
    newest = rows.select("id", "indexed_at", *clean).groupBy("id").agg(F.max(F.struct("indexed_at", *shown)).alias("v"))
    return newest.select("id", *(f"v.{c}" for c in shown))


def between_vertices(edges: DataFrame, vertices: DataFrame, loops: bool = False) -> DataFrame:
    """Edges whose both ends are vertices; without self-loops unless ``loops``."""
    ids = vertices.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    kept = kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept if loops else kept.where("source_id <> target_id")
