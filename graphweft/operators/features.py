"""Per-entity feature tables from events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feature_long(events: DataFrame, entity: str, types: Sequence[str], ident: str, instant: str) -> DataFrame:
    """Compact long table ``(entity, *types, n_events, last_id, first_at, last_at)``.

    An event is one ``ident``: copies of it within an entity and type count once, at their
    latest instant. The first shuffle is by entity, type and event, so neither a large entity
    nor a frequent type gathers in a task; the second moves counts only. The latest event is
    that of the greatest instant, then ident. Events without entity, type or ident are not
    counted; those without an instant are, before all others.
    """
    present = F.col(entity).isNotNull() & F.col(ident).isNotNull()
    for t in types:
        present = present & F.col(t).isNotNull()
    keys = [F.col(entity).alias("entity"), *(F.col(t).alias(f"type{k}") for k, t in enumerate(types))]
    rows = events.where(present).select(*keys, F.col(ident).alias("ident"), F.col(instant).alias("instant"))
    by = ["entity", *(f"type{k}" for k in range(len(types)))]
    once = rows.groupBy(*by, "ident").agg(F.max("instant").alias("instant"))
    counted = once.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.struct("instant", "ident")).alias("last"),
        F.min("instant").alias("first_at"),
    )
    return counted.select(
        F.col("entity").alias(entity),
        *(F.col(f"type{k}").alias(t) for k, t in enumerate(types)),
        "n_events",
        F.col("last.ident").alias("last_id"),
        "first_at",
        F.col("last.instant").alias("last_at"),
    )


#: Rows that are scattered into columns at a time.
SLICE = 1024


def _column(name: Sequence[str], measure: str) -> str:
    return f"{'|'.join(name)}_{measure}"


def feature_wide(
    long: DataFrame, entity: str, types: Sequence[str], listed: Sequence[Sequence[str]], now: int, *, last_ids: bool = False
) -> DataFrame:
    """One row per entity from ``feature_long``: count and recency of each listed type, and totals.

    ``listed`` names the types by their parts and so fixes the columns ``<a>|<b>_n`` (0 where
    absent) and ``<a>|<b>_age`` (``now`` less the latest instant, null where absent), whatever
    the data hold. With ``last_ids`` recency is told by ``<a>|<b>_last`` instead, the latest
    event, and ``unlisted`` is an array of what the entity has of types that are not listed. ``n_events``, ``n_types``,
    ``first_at`` and ``last_at`` are over all types, listed or not.

    Only the long table is shuffled, by entity, which has at most one row per type there. The
    pivot by the explicit list scatters these rows into columns batch by batch, since hundreds
    of columns are too many for one generated projection.
    """
    spark, k = long.sparkSession, len(listed)
    parts = [f"t{n}" for n in range(len(types))]
    places = spark.createDataFrame([(*t, n) for n, t in enumerate(listed)] or [(*types, -1)], ", ".join(f"{p} string" for p in parts) + ", place int")
    slim = long.select(
        F.col(entity).alias("entity"), *(F.col(t).cast("string").alias(p) for t, p in zip(types, parts)), "n_events", F.col("last_id").alias("id"), "first_at", "last_at"
    ).join(F.broadcast(places), parts, "left")
    listed_ones = F.when(F.col("place") >= 0, F.struct("place", F.col("n_events").alias("n"), F.col("last_at").cast("long").alias("last"), *(["id"] if last_ids else [])))
    others = F.when(F.coalesce(F.col("place") < 0, F.lit(True)), F.struct(*parts, F.col("n_events").alias("n"), F.col("id").alias("last")))
    packed = slim.groupBy("entity").agg(
        F.sum("n_events").alias("n_events"),
        F.count(F.lit(1)).alias("n_types"),
        F.min("first_at").cast("long").alias("first_at"),
        F.max("last_at").cast("long").alias("last_at"),
        *([F.collect_list(others).alias("unlisted")] if last_ids else []),
        F.collect_list(listed_ones).alias("own"),
    )
    fixed = packed.drop("own").schema.fields
    own_at = len(fixed)
    measures = ("n", "last") if last_ids else ("n", "age")
    kinds = {"n": T.LongType(), "age": T.LongType(), "last": slim.schema["id"].dataType}
    wide_fields = [T.StructField(_column(t, m), kinds[m]) for t in listed for m in measures]
    schema = T.StructType([T.StructField(entity, fixed[0].dataType), *fixed[1:], *wide_fields])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                own, rows = batch.column(own_at), batch.num_rows
                values = own.flatten()
                row = np.repeat(np.arange(rows), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                place, n = (values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1))
                count = np.zeros((k, rows), np.int64)
                count[place, row] = n
                if last_ids:
                    at = np.zeros((k, rows), np.int64)
                    at[place, row] = np.arange(len(row))
                    columns = [[pa.array(count[j]), values.field(3).take(pa.array(at[j], mask=count[j] == 0))] for j in range(k)]
                else:
                    last = values.field(2)
                    seen = last.is_valid().to_numpy(zero_copy_only=False)
                    age, none = np.zeros((k, rows), np.int64), np.ones((k, rows), bool)
                    age[place, row] = now - last.fill_null(0).to_numpy(zero_copy_only=False)
                    none[place[seen], row[seen]] = False
                    columns = [[pa.array(count[j]), pa.array(age[j], mask=none[j])] for j in range(k)]
                wide = [c for some in columns for c in some]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(own_at)), *wide], [f.name for f in schema.fields])

    return packed.mapInArrow(scatter, schema)


def feature_rows(wide: DataFrame, entity: str, types: Sequence[str], listed: Sequence[Sequence[str]]) -> DataFrame:
    """``(entity, *types, n_events, last_id)``: what ``feature_wide`` with ``last_ids`` holds, a row for each type that an entity has.

    Listed types are read from the columns, the others from ``unlisted``, so nothing is lost.
    """
    last = T.StructField("last_id", wide.schema["unlisted"].dataType.elementType["last"].dataType)
    strings = [T.StructField(t, T.StringType()) for t in types]
    schema = T.StructType([wide.schema[entity], *strings, T.StructField("n_events", T.LongType()), last])
    first, rest = wide.columns.index("unlisted") + 1, wide.columns.index("unlisted")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            who, found = batch.column(0), []
            for j, name in enumerate(listed):
                n, ids = batch.column(first + 2 * j), batch.column(first + 1 + 2 * j)
                rows = np.flatnonzero(n.to_numpy(zero_copy_only=False))
                if len(rows):
                    at = pa.array(rows)
                    found.append([who.take(at), *(pa.array([part] * len(rows), pa.string()) for part in name), n.take(at), ids.take(at)])
            others = batch.column(rest)
            more = others.flatten()
            if len(more):
                row = np.repeat(np.arange(batch.num_rows), others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                found.append([who.take(pa.array(row)), *(more.field(f) for f in range(len(types) + 2))])
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names)

    return wide.mapInArrow(gather, schema)
