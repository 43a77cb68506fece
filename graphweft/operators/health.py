"""Health of a code base: coupling, dead code, score."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .skew import heavy_keys, salted_join

#: Fixed values of the health analysis.
NOT_PRODUCTION = r"(^|/)(?:test|dist|build|coverage|node_modules)/|\.test\.|\.spec\."
EDGE_WEIGHTS = {"calls": 1.0, "extends": 1.0, "imports": 0.5}
OTHER_WEIGHT, LEAST_THRESHOLD, PERCENTILE = 0.7, 4.0, 0.9
#: Share of all files on each side of the percentile among which it is looked for.
NEAR = 0.01
ENTRY_NAMES = ("main", "cli", "handler", "run", "start", "app", "server")
PENALTIES = {"constraints": (20, 0.4), "circular": (25, 0.2), "dead_code": (2, 0.2), "coupling": (15, 0.2)}


def production(vertices: DataFrame) -> DataFrame:
    """Vertices outside folders and files of tests, builds and dependencies; those without a file stay."""
    return vertices.where(~F.coalesce(F.col("file_path").rlike(NOT_PRODUCTION), F.lit(False)))


def file_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(from_file, to_file, type, n)``: edges between different files, ``contains`` left out.

    Sources are joined first and edges counted per file, target and type, so that a target that
    very many refer to comes down to a row for each file; what then is still heavy is salted.
    """
    at = vertices.where("file_path is not null").select("id", "file_path").distinct()
    used = edges.where("type <> 'contains'")
    placed = used.join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id")
    grouped = placed.groupBy("from_file", "target_id", "type").agg(F.count(F.lit(1)).alias("n"))
    targets = at.select(F.col("id").alias("target_id"), F.col("file_path").alias("to_file"))
    both = salted_join(grouped, targets, "target_id", ["from_file", "type"], heavy_keys(used, ["target_id"]))
    return both.where("from_file <> to_file").groupBy("from_file", "to_file", "type").agg(F.sum("n").alias("n"))


def coupling_hotspots(links: DataFrame) -> DataFrame:
    """Files whose weighted fan-in or fan-out reaches the 90th percentile of all (at least 4).

    ``links`` are ``file_edges``. The percentile is the value at index ``floor(0.9 n)`` of the
    ascending maxima; it is found exactly, by ranking the distinct values around the approximate one.
    """
    weight = F.lit(OTHER_WEIGHT)
    for t, w in EDGE_WEIGHTS.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    w = F.col("n") * weight
    into = links.groupBy(F.col("to_file").alias("file_path")).agg(F.round(F.sum(w), 6).alias("fan_in"), F.count_distinct("from_file").alias("incoming"))
    out = links.groupBy(F.col("from_file").alias("file_path")).agg(F.round(F.sum(w), 6).alias("fan_out"), F.count_distinct("to_file").alias("outgoing"))
    both = into.join(out, "file_path", "full").select(
        "file_path",
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fan_in", "fan_out")),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("incoming", "outgoing")),
    )
    both = both.withColumn("v", F.greatest("fan_in", "fan_out"))
    # The value at the place is near the approximate percentile: rows below are counted, and only distinct values around it are ranked.
    near = [max(0.0, PERCENTILE - NEAR), min(1.0, PERCENTILE + NEAR)]
    around = both.agg(F.percentile_approx("v", near, int(2 / NEAR)).alias("p"), F.count(F.lit(1)).alias("whole")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "whole")
    placed = both.join(F.broadcast(around))  # one row
    below = placed.agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    values = placed.where("v between low and high").groupBy("v", "whole").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(below))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("v")) + F.col("below"))
    at = upto.where(F.col("upto") > F.floor(F.col("whole") * PERCENTILE)).agg(F.greatest(F.min("v"), F.lit(LEAST_THRESHOLD)))
    limit = at.scalar()
    hot = both.withColumn("limit", limit).where((F.col("fan_in") >= F.col("limit")) | (F.col("fan_out") >= F.col("limit")))
    kind = F.when((F.col("fan_in") >= F.col("limit")) & (F.col("fan_out") >= F.col("limit")), "both").when(F.col("fan_in") >= F.col("limit"), "fan-in").otherwise("fan-out")
    return hot.select("file_path", "fan_in", "fan_out", "incoming", "outgoing", kind.alias("kind"))


def dead_code(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, round)``: functions and classes that nothing living refers to.

    Round 0 has those without any incoming edge but ``contains``; each further round those
    whose every referrer was dead before. Entry names, exported symbols and components (upper
    case in ``.tsx``) never are. One grouped join a round over what is left, cut by checkpoint.
    """
    component = F.coalesce(F.col("file_path").rlike(r"\.tsx$") & F.col("name").rlike("^[A-Z]"), F.lit(False))
    able = vertices.where(
        F.col("kind").isin("function", "class") & ~F.coalesce(F.col("name").isin(*ENTRY_NAMES), F.lit(False)) & ~F.coalesce("is_exported", F.lit(False)) & ~component
    ).select("id").distinct()
    into = edges.where("type <> 'contains'").select("source_id", F.col("target_id").alias("id")).distinct()
    calls = checkpointed(into.join(able, "id", "left_semi"))
    dead = checkpointed(able.join(calls, "id", "left_anti").withColumn("round", F.lit(0)))
    for k in itertools.count(1):
        known = dead.select(F.col("id").alias("source_id"), F.lit(1).alias("gone"))
        tried = calls.join(dead.select("id"), "id", "left_anti").join(known, "source_id", "left")
        more = checkpointed(tried.groupBy("id").agg(F.count("gone").alias("g"), F.count(F.lit(1)).alias("n")).where("g = n").select("id", F.lit(k).alias("round")))
        if more.isEmpty():
            break
        dead = dead.unionByName(more)
    return dead


def health_score(counts: DataFrame) -> DataFrame:
    """Category scores and the weighted whole from one row of issue counts named as ``PENALTIES``."""
    scores = {c: F.greatest(F.lit(0), F.lit(100) - F.col(c) * p) for c, (p, _) in PENALTIES.items()}
    whole = sum((s * PENALTIES[c][1] for c, s in scores.items()), F.lit(0.0))
    return counts.select(*PENALTIES, *(s.alias(f"{c}_score") for c, s in scores.items()), F.floor(whole + 0.5).cast("long").alias("score"))
