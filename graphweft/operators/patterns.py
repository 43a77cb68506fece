"""Findings in the structure of a code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that tell a layer, in order of precedence, and the layers' order of dependency.
LAYER_WORDS = {
    "controller": ("controller", "handler", "route", "endpoint", "middleware"),
    "service": ("service", "usecase", "manager", "provider"),
    "repository": ("repository", "repo", "store", "dao", "gateway"),
    "database": ("db", "database", "connection", "pool", "migration", "schema"),
    "utility": ("util", "helper", "common", "shared", "lib"),
}
LAYER_ORDER = {"controller": 0, "service": 1, "repository": 2, "database": 3}


def layers(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(id, community, layer, confidence)`` of nodes ``(id, name, file_path, community)``.

    The longest layer word in name or path decides, measured by the length of the name, the
    first in order of ``LAYER_WORDS`` among equals; else the direction of the edges; else the
    most frequent known layer of the community, the first by name among equals.
    """
    name, path = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("file_path", F.lit("")))
    size = F.greatest(F.length(name), F.lit(1))
    hits = F.array(*(
        F.when(F.contains(name, F.lit(w)) | F.contains(path, F.lit(w)), F.struct(F.lit(len(w)).alias("n"), F.lit(-k).alias("order"), F.lit(layer).alias("layer")))
        for k, (layer, w) in enumerate((layer, w) for layer, ws in LAYER_WORDS.items() for w in ws)
    ))
    best = F.array_max(F.filter(hits, lambda h: h.isNotNull()))
    told = nodes.select("id", "community", best.alias("best"), size.alias("size")).join(degrees.select("id", "n_out", "n_in"), "id", "left")
    out, into = F.coalesce("n_out", F.lit(0)), F.coalesce("n_in", F.lit(0))
    degree = F.when((out > 0) & (into == 0), "controller").when((into > 0) & (out == 0), "database").when((out > 0) & (into > 0), "service")
    weight = F.when(degree == "service", 0.2).when(degree.isNotNull(), 0.3).otherwise(0.0)
    first = told.select(
        "id", "community",
        F.coalesce("best.layer", degree, F.lit("unknown")).alias("layer"),
        F.least(F.lit(1.0), F.coalesce(F.col("best.n") / F.col("size"), weight) + 0.3).alias("confidence"),
    )
    counts = first.where("layer <> 'unknown' and community is not null").groupBy("community", "layer").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "layer")).alias("m")).select("community", F.col("m.layer").alias("main"))
    joined = first.join(main, "community", "left")
    taken = (F.col("layer") == "unknown") & F.col("main").isNotNull()
    return joined.select(
        "id", "community",
        F.when(taken, F.col("main")).otherwise(F.col("layer")).alias("layer"),
        F.round(F.when(taken, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")), 6).alias("confidence"),
    )


def layer_findings(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """``(from_layer, to_layer, finding, n_edges)``: upward dependencies and skipped layers; null for allowed ones."""
    of = lambda end: assigned.select(F.col("id").alias(f"{end}_id"), F.col("layer").alias(f"{end}_layer"))
    joined = edges.join(of("source"), "source_id").join(of("target"), "target_id").groupBy(F.col("source_layer").alias("from_layer"), F.col("target_layer").alias("to_layer")).agg(
        F.count(F.lit(1)).alias("n_edges")
    )
    order = F.create_map(*(F.lit(x) for kv in LAYER_ORDER.items() for x in kv))
    a, b = F.try_element_at(order, F.col("from_layer")), F.try_element_at(order, F.col("to_layer"))
    finding = F.when(a > b, "dependency_direction").when(b - a > 1, "layer_violation")
    return joined.select("from_layer", "to_layer", finding.alias("finding"), "n_edges")


def god_classes(classes: DataFrame, methods: DataFrame, threshold: int = 10, error_from: float = 0.3) -> DataFrame:
    """Classes with at least ``threshold`` methods of their file named ``Class.method``."""
    owned = methods.select("file_path", F.substring_index("name", ".", 1).alias("name")).groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("method_count"))
    found = classes.join(owned, ["file_path", "name"]).where(F.col("method_count") >= threshold)
    severity = F.when(F.coalesce(F.nanvl("betweenness", F.lit(0.0)), F.lit(0.0)) >= error_from, "error").otherwise("warning")
    return found.select("file_path", "name", "method_count", severity.alias("severity"))


def complexity_hotspots(nodes: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """The ``k`` nodes of greatest score 0.4 rank + 0.3 betweenness + 0.3 length, each by its maximum."""
    clean = nodes.select(
        "id", F.coalesce("page_rank", F.lit(0.0)).alias("pr"), F.coalesce("betweenness", F.lit(0.0)).alias("bw"),
        F.coalesce(F.col("line_end") - F.col("line_start") + 1, F.lit(0)).alias("lines"),
    )
    most = clean.agg(F.max("pr").alias("mp"), F.max("bw").alias("mb"), F.max("lines").alias("ml"))
    part = lambda v, m: F.when(F.col(m) > 0, F.col(v) / F.col(m)).otherwise(0.0)
    scored = clean.join(F.broadcast(most)).withColumn("score", F.round(part("pr", "mp") * 0.4 + part("bw", "mb") * 0.3 + part("lines", "ml") * 0.3, 9))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def feature_envy(vertices: DataFrame, edges: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Functions that call another file at least ``ratio`` times as often as their own."""
    at = vertices.where("file_path is not null").select("id", "file_path").distinct()
    callers = vertices.where("kind in ('function', 'method')").select(F.col("id").alias("source_id"), F.col("file_path").alias("own_file")).distinct()
    calls = edges.where("type = 'calls'").join(callers, "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file")), "target_id")
    counted = calls.groupBy("source_id", "own_file", "target_file").agg(F.count(F.lit(1)).alias("n"))
    own = F.coalesce(F.max(F.when(F.col("own_file") == F.col("target_file"), F.col("n"))).over(Window.partitionBy("source_id", "own_file")), F.lit(0))
    judged = counted.withColumn("own_calls", own).where("own_file <> target_file")
    return judged.where((F.col("own_calls") == 0) | (F.col("n") >= F.col("own_calls") * ratio)).select(F.col("source_id").alias("id"), "target_file", F.col("n").alias("external_calls"), "own_calls")


def shotgun_surgery(vertices: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """Symbols that at least ``least`` other files depend on; dependents are made distinct by file before they meet."""
    at = vertices.where("file_path is not null").select("id", "file_path").distinct()
    used = edges.where("type <> 'contains'").join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id")
    pairs = used.select(F.col("target_id").alias("id"), "from_file").distinct()
    judged = pairs.join(at, "id").where("from_file <> file_path").groupBy("id").agg(F.count(F.lit(1)).alias("dependent_files"))
    return judged.where(F.col("dependent_files") >= least)


def predicted_impact(changes: DataFrame, least: int = 3) -> DataFrame:
    """``(file, co_file, n)``: files that at least ``least`` records of ``file`` name in ``changedWith``."""
    pairs = changes.select("file", F.explode("changedWith").alias("co_file")).where("file is not null and co_file is not null and file <> co_file")
    return pairs.groupBy("file", "co_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def entry_points(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, score, is_entry_point)`` by name, export, calls and async; functions of score 0 left out."""
    calls = edges.where("type = 'calls'")
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    joined = functions.select("id", "name", "is_exported", "is_async").join(out, "id", "left").join(into, "id", "left")
    named = F.col("name").rlike("^handle|^on[A-Z]|Controller$|Handler$")
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    starts = (F.coalesce("n_out", F.lit(0)) > 0) & (F.coalesce("n_in", F.lit(0)) <= 1)
    score = F.round(yes(named, 0.3) + yes(F.col("is_exported"), 0.1) + yes(starts, 0.2) + yes(F.col("is_async"), 0.1), 2)
    return joined.select("id", score.alias("score"), (score > 0.5).alias("is_entry_point")).where("score > 0")
