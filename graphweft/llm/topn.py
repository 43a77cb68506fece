"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bounds that are broadcast at most (some tens of MB).
BROADCAST_BOUNDS = 500_000


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    return rows.sort_values(["grp", "score", "item"], ascending=[True, False, True], kind="stable").groupby("grp", sort=False).head(n)


def local_bounds(rows: DataFrame, n: int, most: int = 200_000) -> DataFrame:
    """``(grp, score, item)``: of each partition and group with at least ``n`` rows there, the ``n``-th best.

    At least ``n`` rows of the group are as good, so it bounds the group's ``n`` best from
    below. A partition keeps the ``n`` best rows of its groups while it reads its batches; when
    these are more than ``most`` rows, it gives the bounds it has and starts anew, for any part
    of a partition bounds as validly, if less tightly.
    """
    schema = rows.schema

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        held = 0

        def done() -> pd.DataFrame:
            best = _best(pd.concat(kept), n)
            return best[best.groupby("grp", sort=False).cumcount().to_numpy() == n - 1]

        for batch in batches:
            kept.append(_best(batch, n))
            held += len(kept[-1])
            if held > most:
                kept = [_best(pd.concat(kept), n)]
                held = len(kept[0])
                if held > most // 2:
                    yield done()
                    kept, held = [], 0
        if kept:
            yield done()

    return rows.mapInPandas(bounds, schema)


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, *, broadcast_rows: int = BROADCAST_BOUNDS) -> DataFrame:
    """``(group, pos, item, score)``: the ``n`` highest scores of each group, places from 1.

    Equal scores go by ascending item; a repeated row takes a place for each time it occurs.
    Rows without group, item or score, or with a NaN score, do not count. Groups of fewer than
    ``n`` rows come out whole; an empty table gives no rows.

    Every partition finds its own ``n``-th best row of each group; the best of these valid
    lower bounds per group are written and counted, and rows below them are dropped where they
    lie, by a broadcast of at most ``broadcast_rows`` bounds: all of them, or else those of the
    groups with most bounds, which are those with rows in most partitions. What survives is
    shuffled and ranked; groups without a bound have fewer than ``n`` rows in any partition or
    are less spread, and rows of one partition beyond its ``n`` best are dropped by Spark
    before the shuffle. The input is computed twice, for the bounds and for the survivors.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(score).cast("double").alias("score"), F.col(item).alias("item")).where(
        "grp is not null and item is not null and score is not null and not isnan(score)"
    )
    found = local_bounds(rows, n).groupBy("grp").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "item")).alias("least"), F.count(F.lit(1)).alias("spread")
    )
    bounds = written(found)
    if bounds.count() > broadcast_rows:
        bounds = bounds.orderBy(F.desc("spread"), "grp").limit(broadcast_rows)
    reached = F.struct((-F.col("score")).alias("minus"), "item") <= F.col("least")
    survivors = rows.join(F.broadcast(bounds.select("grp", "least")), "grp", "left").where(F.col("least").isNull() | reached)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    ranked = survivors.withColumn("pos", place).where(F.col("pos") <= n)
    return ranked.select(F.col("grp").alias(group), "pos", F.col("item").alias(item), F.col("score").alias(score))


def latest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``version`` (null: before all others).

    Several such rows: the greatest by all columns in order. Rows without key are left out.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__row"))
    return newest.select(key, *(F.col(f"__row.{c}").alias(c) for c in (version, *rest)))
