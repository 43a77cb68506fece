"""Runs of alike consecutive events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _runs(rows: DataFrame) -> DataFrame:
    """Runs within a piece of a sequence."""
    order = Window.partitionBy("piece", "seq").orderBy("at", "id")
    flagged = (
        rows.withColumn("before", F.lag(F.struct("id", "like")).over(order))
        .withColumn("copy", F.coalesce(F.col("before.id") == F.col("id"), F.lit(False)))
        .withColumn("new", F.col("before").isNull() | (~F.col("copy") & ~F.col("before.like").eqNullSafe(F.col("like"))))
        .withColumn("run", F.sum(F.col("new").cast("long")).over(order))
    )
    return flagged.groupBy("piece", "seq", "run").agg(
        F.min(F.struct("at", "id")).alias("first"),
        F.max(F.struct("at", "id")).alias("last"),
        F.sum((~F.col("copy")).cast("long")).alias("n"),
        F.first("like").alias("like"),
    )


def collapse_runs(
    events: DataFrame, sequence: str, at: str, ident: str, like: Sequence[str], *, pieces: int | None = None
) -> DataFrame:
    """One row per longest run of consecutive alike events of a sequence.

    Columns: ``sequence``, ``first_id``, ``last_id``, the ``like`` columns, ``n_events``,
    ``started_at``, ``ended_at`` and ``duration`` (difference of the two, in the unit of ``at``).

    Events are ordered by ``at``, then ``ident``; each is compared with its predecessor by a
    lag window, changes of the ``like`` columns are flagged, the flags' running sum numbers
    the runs, and runs are aggregated. Two null values are alike. An event is one ``ident``:
    copies (which agree in ``at``) count once. A single event is a run of one. Events without
    sequence, ``at`` or ``ident`` have no place in an order and are left out; an empty table
    gives no rows. Other columns, whatever their names, are not looked at.

    All events are ranged by sequence, ``at`` and ``ident`` into ``pieces`` (by default as many
    as a shuffle has tasks) of about equal size, by quantiles that Spark samples in one more
    pass over the input: a sequence of any length, a burst at one instant or an outlier in time
    makes no piece larger. Each piece then goes to a task of its own in a second shuffle, which
    tells Spark that the windows need no other. Fewer sequences than pieces lie in more than one
    piece; only their first and last runs there are brought together afterwards.
    """
    rows = events.where(F.col(sequence).isNotNull() & F.col(at).isNotNull() & F.col(ident).isNotNull()).select(
        F.col(sequence).alias("seq"),
        F.col(at).cast("long").alias("at"),
        F.col(ident).alias("id"),
        F.struct(*(F.col(c).alias(f"k{k}") for k, c in enumerate(like))).alias("like"),
    )
    count = pieces or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, "seq", "at", "id").withColumn("piece", F.spark_partition_id()).repartitionById(count, "piece")
    # Sequences in more than one piece, fewer than pieces. The hash is there to need all columns, so that Spark sees the same shuffle and uses it again.
    ends = ranged.groupBy("piece").agg(F.array(F.min("seq"), F.max("seq")).alias("ends"), F.bit_xor(F.xxhash64("like")).alias("all")).where(F.col("all").isNotNull())
    cut = ends.select("piece", F.explode(F.array_distinct("ends")).alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("seq")
    inner = _runs(ranged.join(F.broadcast(cut), "seq", "left_anti"))
    parted = _runs(ranged.join(F.broadcast(cut), "seq", "left_semi"))
    outer = (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("piece", "seq")))
    across = Window.partitionBy("seq").orderBy("piece", "run")
    goes_on = (F.col("before.piece") < F.col("piece")) & F.col("before.like").eqNullSafe(F.col("like"))
    marked = parted.withColumn("outer", outer)
    joined = (
        marked.where("outer")
        .withColumn("before", F.lag(F.struct("piece", "like")).over(across))
        .withColumn("joined", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("long")).over(across))
        .groupBy("seq", "joined")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.first("like").alias("like"))
    )
    columns = ["seq", "first", "last", "n", "like"]
    whole = inner.select(columns).unionByName(marked.where("not outer").select(columns)).unionByName(joined.select(columns))
    return whole.select(
        F.col("seq").alias(sequence),
        F.col("first.id").alias("first_id"),
        F.col("last.id").alias("last_id"),
        *(F.col(f"like.k{k}").alias(c) for k, c in enumerate(like)),
        F.col("n").alias("n_events"),
        F.col("first.at").alias("started_at"),
        F.col("last.at").alias("ended_at"),
        (F.col("last.at") - F.col("first.at")).alias("duration"),
    )
