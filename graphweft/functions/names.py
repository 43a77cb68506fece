"""Column functions that bring written names to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that count as outer blanks of a label.
BLANKS = " \t\r\n "
#: First segment of every project path.
PROJECT_ROOT = "packages"


def label(col: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.trim(col, F.lit(BLANKS)))


def canonical_path(col: Column, root: str = PROJECT_ROOT) -> Column:
    """One form for every way to write a project path.

    Backslashes become slashes, ``.``, ``..`` and empty segments are resolved and everything
    before the first ``root`` segment is cut. Null and blank paths give null; a path without
    ``root`` keeps its resolved segments. Paths already in that form take a cheap branch.
    """
    path = F.trim(F.translate(col, "\\", "/"), F.lit(BLANKS))
    plain = path.rlike(rf"^{root}(/(?!\.{{1,2}}(/|$))[^/]+)+$")
    segments = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s.isin("", "."), kept)
        .when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(s))),
    )
    start = F.greatest(F.array_position(segments, root).cast("int"), F.lit(1))
    resolved = F.array_join(F.slice(segments, start, F.greatest(F.size(segments), F.lit(1))), "/")
    return F.when(plain, path).otherwise(F.nullif(resolved, F.lit("")))


def instant_ms(col: Column) -> Column:
    """Milliseconds since 1970 of a number that is either that or, below 1e11, full seconds."""
    return F.when(F.abs(col) < F.lit(100_000_000_000), col * 1000).otherwise(col)


def current_names(df: DataFrame, written: str, aliases: DataFrame, out: str, max_broadcast: int = 100_000) -> DataFrame:
    """Add ``out``: the current name of ``df[written]`` by ``aliases(alias, tool_name)``.

    Case and outer blanks are ignored. A name without alias stays as written, without outer
    blanks; null stays null. Several names for one alias: the smallest. The alias table is
    broadcast only if it has at most ``max_broadcast`` rows, else Spark chooses the join.
    """
    names = (
        aliases.select(label(F.col("alias")).alias("__alias"), F.col("tool_name").alias("__current"))
        .where("__alias is not null")
        .groupBy("__alias")
        .agg(F.min("__current").alias("__current"))
    )
    if aliases.limit(max_broadcast + 1).count() <= max_broadcast:
        names = F.broadcast(names)
    joined = df.withColumn("__alias", label(F.col(written))).join(names, "__alias", "left")
    current = F.coalesce("__current", F.trim(F.col(written), F.lit(BLANKS)))
    return joined.withColumn(out, current).drop("__alias", "__current")
