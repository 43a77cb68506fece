"""Heavy keys, and aggregation that they cannot delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that the sketch of heavy keys tracks for each task; its counts err by at most 3.5 parts in all items tracked.
TRACKED = 16


def tasks_of(spark: SparkSession) -> int:
    """Tasks that a shuffle is divided into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that hold more rows than a task has on average.

    One pass with a mergeable sketch of frequent items, whose size depends on the number of
    tasks alone; no shuffle of keys. Of ``tasks`` tasks no more than about so many keys can
    hold the average, so the result may be used in a filter or a broadcast. Null keys count
    as keys. A key near the average may be missed or be taken in; nothing depends on that
    but how work is divided.
    """
    tasks = tasks_of(df.sparkSession)
    found = df.select(key_hash(keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {2 * tasks}, {max(1024, TRACKED * tasks)})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [t["item"] for t in found.top or [] if t["count"] * tasks > found.n]


def is_heavy(keys: Sequence[str], heavy: Sequence[int]) -> Column:
    """Whether a row's key is one of ``heavy``, by hash: a light key of equal hash also says so, which harms nothing."""
    return key_hash(keys).isin(list(heavy)) if heavy else F.lit(False)


def distinct_counts(df: DataFrame, keys: Sequence[str], item: str, *, salts: int | None = None) -> DataFrame:
    """Rows ``(*keys, n_items, n_rows)``: how many different ``item`` each key has, and rows.

    Two-stage salted aggregation. Rows of heavy keys get a salt (as many salts as tasks, if not
    told otherwise) from a hash of the item, not a random number, so that an item meets its
    copies and a task that is run again salts alike; all other rows have salt 0. Partial
    results per key and salt are computed after one shuffle and then merged by the key alone.
    The input is read twice, once for the sketch of heavy keys.

    Null keys form a group; null items are not counted as items but as rows. Repeated rows
    count once in ``n_items``. An empty input gives no rows. Other columns of ``df`` are not
    looked at.
    """
    slim = df.select(*keys, F.col(item).alias("__item"))
    heavy = heavy_keys(slim, keys)
    spread = F.pmod(F.xxhash64("__item"), F.lit(salts or tasks_of(df.sparkSession)))
    salted = slim.withColumn("__salt", F.when(is_heavy(keys, heavy), spread).otherwise(F.lit(0).cast("long")))
    once = salted.repartition(*keys, "__salt").groupBy(*keys, "__salt", "__item").agg(F.count(F.lit(1)).alias("__n"))
    partial = once.groupBy(*keys, "__salt").agg(F.count("__item").alias("__items"), F.sum("__n").alias("__rows"))
    return partial.groupBy(*keys).agg(F.sum("__items").alias("n_items"), F.sum("__rows").alias("n_rows"))


def salted_join(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], heavy: Sequence[int]) -> DataFrame:
    """Inner join on ``key`` of a skewed ``left`` with a ``right`` of few rows a key.

    Rows of the ``heavy`` keys of ``left`` (hashes of ``heavy_keys``) are spread over as many
    salts as there are tasks by a hash of the columns ``by``; the right rows of just these
    keys are repeated for each salt. Null keys join nothing.
    """
    if not heavy:
        return left.join(right, key)
    none, salts = F.lit(0).cast("long"), tasks_of(left.sparkSession)
    hot = is_heavy([key], heavy)
    salt = F.when(hot, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(none)
    every = F.when(hot, F.sequence(none, F.lit(salts - 1).cast("long"))).otherwise(F.array(none))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", F.explode(every)), [key, "__salt"]).drop("__salt")
