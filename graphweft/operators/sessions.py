"""Sessions, attention and activity from observations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of attention: interactions after which a file is forgotten, recent files, ranks of risk.
FORGET_AFTER, RECENT_FILES = 50, 20
HIGH_RANK, MEDIUM_RANK = 0.01, 0.005


def once(observations: DataFrame) -> DataFrame:
    """One row per observation ``id``; copies agree in what is kept here."""
    return observations.where("id is not null and session_id is not null").dropDuplicates(["session_id", "id"])


def tool_counts(observations: DataFrame) -> DataFrame:
    """``(session_id, tool_name, n)``."""
    return once(observations).groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))


def edit_hotspots(observations: DataFrame, least: int = 3) -> DataFrame:
    """``(file_path, n_edits, n_sessions)`` of files edited at least ``least`` times."""
    edits = once(observations).where("event = 'file:edit' and file_path is not null")
    return edits.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_edits"), F.count_distinct("session_id").alias("n_sessions")).where(F.col("n_edits") >= least)


def sessions_by_gap(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """``(user, started, ended, n_events)``: events of a user up to ``gap`` apart belong together.

    Spark's session windows merge within a partition first, so a user with many events is
    shuffled as few windows.
    """
    stamped = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("user_id"), F.col(ts).cast("timestamp").alias("ts"))
    merged = stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_events"))
    return merged.select("user_id", "started", "ended", "n_events")


def attention(observations: DataFrame) -> DataFrame:
    """``(session_id, file_path, accesses, last_tick, edited)``: files a session still attends to at its end.

    A tick is the place of an observation in its session by instant, then id. A file is edited
    once any access edits or creates it; one not accessed in the last ``FORGET_AFTER`` ticks is
    forgotten. Only the last ticks of a session are ranked; Spark cuts to them before its shuffle.
    """
    rows = once(observations)
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("instant"), F.desc("id")))
    recent = rows.select("session_id", "instant", "id", "file_path").withColumn("back", back).where(F.col("back") <= FORGET_AFTER + 1)
    last = recent.where("file_path is not null").groupBy("session_id", "file_path").agg(F.min("back").alias("back"))
    size = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("ticks"))
    files = rows.where("file_path is not null").groupBy("session_id", "file_path").agg(
        F.count(F.lit(1)).alias("accesses"), F.bool_or(F.coalesce(F.col("event").isin("file:edit", "file:create"), F.lit(False))).alias("edited")
    )
    found = files.join(last, ["session_id", "file_path"]).join(size, "session_id")
    return found.select("session_id", "file_path", "accesses", (F.col("ticks") - F.col("back") + 1).alias("last_tick"), "edited")


def touched(observations: DataFrame) -> DataFrame:
    """``(session_id, file_path, was_read, was_edited)`` of files that a session read or edited."""
    rows = once(observations).where("file_path is not null and event in ('file:read', 'file:edit', 'file:create')")
    return rows.groupBy("session_id", "file_path").agg(F.bool_or(F.col("event") == "file:read").alias("was_read"), F.bool_or(F.col("event") != "file:read").alias("was_edited"))


def blind_spots(observations: DataFrame, links: DataFrame) -> DataFrame:
    """``(session_id, n_blind)``: files that edited ones depend on and that the session never read."""
    seen = touched(observations)
    near = links.select(F.col("from_file").alias("file_path"), "to_file").distinct()
    needed = seen.where("was_edited").join(near, "file_path").select("session_id", "to_file").distinct()
    read = seen.where("was_read").select("session_id", F.col("file_path").alias("to_file"))
    return needed.join(read, ["session_id", "to_file"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_blind"))


def community_activity(observations: DataFrame, functions: DataFrame) -> DataFrame:
    """``(community, n, read_coverage, edit_intensity)`` of the functions in files read or edited."""
    seen = touched(observations).groupBy("file_path").agg(F.bool_or("was_read").alias("r"), F.bool_or("was_edited").alias("e"))
    joined = functions.where("community is not null").select("community", "file_path").join(seen, "file_path", "left")
    share = lambda c: F.round(F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1)), 6)
    return joined.groupBy("community").agg(F.count(F.lit(1)).alias("n"), share(F.col("r")).alias("read_coverage"), share(F.col("e")).alias("edit_intensity"))


def pulse(observations: DataFrame, functions: DataFrame) -> DataFrame:
    """``(session_id, pulse, risk)``: greatest rank among functions of the files a session edited."""
    ranks = functions.where("file_path is not null").groupBy("file_path").agg(F.max("page_rank").alias("rank"))
    value = F.coalesce(F.max("rank"), F.lit(0.0))
    edited = touched(observations).where("was_edited").join(ranks, "file_path", "left")
    risk = F.when(value > HIGH_RANK, "HIGH").when(value > MEDIUM_RANK, "MEDIUM").otherwise("LOW")
    return edited.groupBy("session_id").agg(value.alias("pulse"), risk.alias("risk"))


def investigation_scope(observations: DataFrame) -> DataFrame:
    """``(session_id, dir, n)``: deepest directories that hold half (at least two) of the files read last.

    The last files are the ``RECENT_FILES`` different ones read latest; ties go by path.
    """
    reads = once(observations).where("file_path is not null and event = 'file:read'").groupBy("session_id", "file_path").agg(F.max(F.struct("instant", "id")).alias("last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last"), "file_path"))
    recent = reads.withColumn("place", place).where(F.col("place") <= RECENT_FILES)
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    counted = recent.where(F.size(parts) > 1).select("session_id", F.explode(dirs).alias("dir")).groupBy("session_id", "dir").agg(F.count(F.lit(1)).alias("n"))
    sizes = recent.groupBy("session_id").agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 2)).alias("least"))
    wide = counted.join(sizes, "session_id").where(F.col("n") >= F.col("least")).select("session_id", "dir", "n")
    deeper = wide.select("session_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k - 1), "/"))).alias("dir")).distinct()
    return wide.join(deeper, ["session_id", "dir"], "left_anti")
