"""Lookups, neighbourhoods and counts on the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import between_vertices

#: Edge types that the references of a symbol are told apart by.
REFERENCE_KINDS = ("calls", "imports", "extends", "implements")


def hubs(vertices: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` vertices with most edge ends; equal numbers go by id."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("edge_count"))
    found = counted.join(vertices.select("id", "kind", "name", "file_path"), "id")
    return found.orderBy(F.desc("edge_count"), "id").limit(k)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges out of and into every vertex, zero included; targets are counted before they are joined."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    both = vertices.select("id", "kind").join(out, "id", "left").join(into, "id", "left")
    return both.select("id", "kind", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def overview(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of vertices by kind, edges by type, symbols (vertices but files) and edges in all."""
    part = lambda rows, what, by: rows.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    total = lambda rows, what: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("what"), F.lit(what).alias("name"), "n")
    kinds, types = part(vertices, "kind", "kind"), part(edges, "type", "type")
    return kinds.unionByName(types).unionByName(total(vertices.where("kind <> 'file'"), "symbols")).unionByName(total(edges, "edges"))


def symbol_references(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers, importers, extenders and implementors of every symbol that has any."""
    counted = edges.where(F.col("type").isin(*REFERENCE_KINDS)).groupBy(F.col("target_id").alias("id")).pivot("type", list(REFERENCE_KINDS)).count()
    names = ("callers", "importers", "extenders", "implementors")
    zero = [F.coalesce(F.col(t), F.lit(0)).alias(n) for t, n in zip(REFERENCE_KINDS, names)]
    return counted.select("id", *zero).join(vertices.select("id", "kind", "name"), "id")


def file_context(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: symbols, and how many others its symbols depend on and are depended on by.

    Edges within the file and ``contains`` edges do not count.
    """
    at = vertices.where("file_path is not null").select("id", "file_path")
    used = between_vertices(edges.where("type <> 'contains'"), vertices)
    placed = used.join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id")
    placed = placed.join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("to_file")), "target_id").where("from_file <> to_file")
    count = lambda file, other, name: placed.groupBy(F.col(file).alias("file_path")).agg(F.count_distinct(other).alias(name))
    symbols = vertices.where("kind <> 'file' and file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))
    joined = symbols.join(count("from_file", "target_id", "dependencies"), "file_path", "left").join(count("to_file", "source_id", "dependents"), "file_path", "left")
    return joined.select("file_path", "symbols", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dependencies", "dependents")))


def enclosing_scopes(vertices: DataFrame) -> DataFrame:
    """The tightest function or method of the same file around the line of each variable.

    A range join on file and lines; of equal spans the smaller id. Variables outside any come
    out without scope.
    """
    named = vertices.where("kind = 'variable'").select(F.col("id").alias("variable"), "file_path", F.col("line_start").alias("line"))
    scopes = vertices.where("kind in ('function', 'method')").select("file_path", "id", "line_start", "line_end")
    around = named.join(scopes, (named.file_path == scopes.file_path) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left")
    span = F.when(F.col("id").isNotNull(), F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id"))
    return around.groupBy("variable").agg(F.min(span).alias("scope")).select("variable", F.col("scope.id").alias("scope"), F.col("scope.span").alias("span"))
