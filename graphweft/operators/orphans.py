"""References to records that do not exist, or did not at the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import heavy_keys, is_heavy, tasks_of

#: Ids with these prefixes stand for things that are never records (fixed values of the data model).
PSEUDO_PREFIXES = ("param:", "field:", "error:")
#: Spells of heavy keys are broadcast up to so many rows (some tens of MB); beyond, they are shuffled like the others.
BROADCAST_ROWS = 500_000


def reference_ends(edges: DataFrame, sides: dict[str, str], ident: str, at: str, pseudo: Sequence[str] = PSEUDO_PREFIXES) -> DataFrame:
    """One row ``(ref_id, at, side, key, period)`` per reference, ``period`` the month of ``at``; null and pseudo keys are no references."""
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("key")) for side, c in sides.items()))
    rows = edges.select(F.col(ident).alias("ref_id"), F.col(at).alias("at"), F.inline(ends))
    keep = F.col("key").isNotNull()
    for p in pseudo:
        keep = keep & ~F.col("key").startswith(p)
    return rows.where(keep).withColumn("period", F.date_trunc("month", "at"))


def spells(*tables: DataFrame) -> DataFrame:
    """``(key, since, until)``: the different spells of each id, a row each, from tables ``(id, since, until)``.

    ``since`` null means since ever, ``until`` null still there. Rows with a null id are no records.
    """
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.where("id is not null").select(F.col("id").alias("key"), "since", "until").distinct()


def _begun(at: Column) -> Column:
    return F.col("since").isNull() | (F.col("since") <= at)


def _lasts(at: Column) -> Column:
    return F.col("until").isNull() | (F.col("until") > at)


def _judged(groups: DataFrame, records: DataFrame, broadcast: bool) -> DataFrame:
    """Groups not wholly covered by one spell, as ``(key, side, period, n, ended, kind)``.

    An anti-join drops the groups that one spell covers. What is left is ``missing`` if the id
    has no record, ``deleted`` or ``later`` if that holds for all its times, nothing if the id
    has records but the group no times, and ``mixed`` otherwise. ``ended`` is the first end of
    a spell of the id.
    """
    known = F.broadcast(records) if broadcast else records
    covered = (F.col("g.key") == F.col("s.key")) & _begun(F.col("g.first")) & _lasts(F.col("g.last"))
    suspects = groups.alias("g").join(known.alias("s"), covered, "left_anti")
    there = _begun(F.col("last")) & _lasts(F.col("first"))
    seen = suspects.join(known.withColumn("known", F.lit(True)), "key", "left").groupBy("key", "side", "period").agg(
        F.first("n").alias("n"),
        F.first("first").alias("first"),
        F.first("last").alias("last"),
        F.max("known").alias("known"),
        F.max(F.coalesce("known", F.lit(False)) & there).alias("touched"),
        F.min("until").alias("ended"),
    )
    kind = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("first").isNull(), F.lit(None).cast("string"))
        .when(F.col("touched"), "mixed")
        .when(F.col("ended") <= F.col("first"), "deleted")
        .when(F.col("ended").isNull() | (F.col("ended") > F.col("last")), "later")
        .otherwise("mixed")
    )
    return seen.withColumn("kind", kind).where("kind is not null").select("key", "side", "period", "n", "ended", "kind")


def orphan_groups(refs: DataFrame, records: DataFrame) -> tuple[DataFrame, list[int]]:
    """Groups of references that are or may be orphans, ``(key, side, period, n, ended, kind)``, and the hashes of heavy keys.

    References are aggregated per key, side and period with their number and their first and
    last time. Skew-aware split: keys that hold more references than an average task (fewer
    than tasks) are aggregated before their shuffle and checked against a broadcast of just
    their spells, if these are few enough; all other keys are shuffled once, by the key alone,
    which serves their aggregation as well as the anti-join. Both are united.
    """
    heavy = heavy_keys(refs, ["key"])
    hot = is_heavy(["key"], heavy)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "side", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))

    light = _judged(grouped(refs.where(~hot).repartition("key")), records.where(~hot), False)
    if not heavy:
        return written(light), heavy
    few = records.where(hot).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return written(light.unionByName(_judged(grouped(refs.where(hot)), records.where(hot), few))), heavy


def _edges_of(refs: DataFrame, groups: DataFrame, records: DataFrame, heavy: list[int]) -> DataFrame:
    """The orphans ``(ref_id, side, key, at, period, kind)`` among the references of ``groups``.

    Few groups are broadcast, so that references stay where they are read. If there are more
    than ``BROADCAST_ROWS``, references are shuffled, those of heavy keys salted by their id
    and the groups of these keys repeated for each salt, so that no task gets all of a key.
    The references found are written; only those of mixed groups are then held against the
    spells of their ids.
    """
    few = groups.count() <= BROADCAST_ROWS
    salts, none = tasks_of(refs.sparkSession), F.lit(0).cast("long")
    hot = F.lit(False) if few else is_heavy(["key"], heavy)
    salt = F.when(hot, F.pmod(F.xxhash64("ref_id"), F.lit(salts))).otherwise(none)
    every = F.when(hot, F.sequence(none, F.lit(salts - 1).cast("long"))).otherwise(F.array(none))
    g = groups.select("key", "side", "period", "ended", "kind", F.explode(every).alias("salt"))
    g = (F.broadcast(g) if few else g).alias("g")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) if c == "period" else F.col(f"r.{c}") == F.col(f"g.{c}") for c in ("key", "side", "period", "salt")]
    rows = refs.withColumn("salt", salt).alias("r").join(g, same).select("r.ref_id", "r.side", "r.key", "r.at", "r.period", "g.ended", "g.kind")
    rows = written(rows)
    columns = ["ref_id", "side", "key", "at", "period", "kind"]
    s = records.join(groups.where("kind = 'mixed'").select("key").distinct(), "key", "left_semi")
    if heavy and s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a heavy key may be mixed
        s = F.broadcast(s)
    s = s.alias("s")
    there = (F.col("m.key") == F.col("s.key")) & _begun(F.col("m.at")) & _lasts(F.col("m.at"))
    absent = rows.where("kind = 'mixed'").alias("m").join(s, there, "left_anti").withColumn("kind", F.when(F.col("ended") <= F.col("at"), "deleted").otherwise("later"))
    return rows.where("kind <> 'mixed'").select(columns).unionByName(absent.select(columns))


def orphan_references(refs: DataFrame, records: DataFrame) -> DataFrame:
    """The orphans ``(ref_id, side, key, at, kind)`` among ``refs`` of ``reference_ends``, by ``orphan_groups``.

    ``missing`` if no record has the id, else ``deleted`` if a spell of it ended at or before
    that time, else ``later``. A reference without a time is an orphan only if its id has no
    record at all. A reference repeated under another ``ref_id`` is an orphan of its own.
    Empty records make all references ``missing``; empty references give no rows.
    """
    groups, heavy = orphan_groups(refs, records)
    return _edges_of(refs, groups, records, heavy).select("ref_id", "side", "key", "at", "kind")


def orphan_counts(refs: DataFrame, records: DataFrame) -> DataFrame:
    """``(side, period, kind, n_refs, n_keys)``: orphans per referring column and month, by ``orphan_groups``.

    Groups that are orphans whole are counted as they are; only mixed ones go back to their
    references. Times are truncated to months in UTC; a reference without a time has a null
    period.
    """
    groups, heavy = orphan_groups(refs, records)
    whole = groups.where("kind <> 'mixed'").select("key", "side", "period", "kind", "n")
    mixed = _edges_of(refs, groups.where("kind = 'mixed'"), records, heavy)
    rows = mixed.groupBy("key", "side", "period", "kind").agg(F.count(F.lit(1)).alias("n"))
    both = whole.unionByName(rows)
    return both.groupBy("side", "period", "kind").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
