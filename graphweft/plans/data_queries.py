"""Queries of the data-quality and feature operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import current_names, instant_ms, label
from ..operators.features import feature_long, feature_rows, feature_wide
from ..operators.orphans import orphan_counts, orphan_references, reference_ends, spells
from ..operators.skew import distinct_counts
from ..sources.tables import table

#: Events of the observation log (fixed values of the data model); with the tools they name the feature columns.
EVENTS = (
    "cache:hit", "cache:miss", "dna:violation", "file:create", "file:edit", "file:read",
    "file:rename", "permission:ask", "subagent", "tool:use", "tool_failure",
)
#: Features are as of this instant (2025-11-01, the end of the data's period) unless told otherwise.
FEATURES_AS_OF_MS = 1_761_955_200_000
#: Share of all distinct edges from which a target and type is reported, in percent.
HEAVY_PERCENT = 1


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, nodes, classes = (table(spark, d, t) for t in ("edges", "nodes", "nodes_class"))
    refs = reference_ends(edges, {"source": "source_id", "target": "target_id"}, "edge_id", "indexed_at")
    ever = F.lit(None).cast(nodes.schema["indexed_at"].dataType)
    return refs, spells(
        nodes.select("id", F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")),
        classes.select("id", ever.alias("since"), ever.alias("until")),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every end of an edge that names no vertex present when the edge was found."""
    orphans = orphan_references(*_references(spark, d))
    return orphans.select(F.col("ref_id").alias("edge_id"), "side", "kind")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring column, month and kind."""
    return orphan_counts(*_references(spark, d))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "session_observations").select(
        "id", "session_id", instant_ms(F.col("timestamp")).alias("instant"), F.col("tool_name").alias("written"), label(F.col("event")).alias("event")
    )
    return current_names(rows, "written", table(spark, d, "tool_aliases"), "tool_name")


def _listed(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """The explicit type list: every current tool of ``tool_aliases`` (a table that does not grow) with every event of ``EVENTS``."""
    names = table(spark, d, "tool_aliases").select("tool_name").where("tool_name is not null").distinct().orderBy("tool_name").collect()
    return [(r.tool_name, e) for r in names for e in EVENTS]


def _features(spark: SparkSession, d: str, listed: list[tuple[str, str]], last_ids: bool) -> DataFrame:
    long = feature_long(_observations(spark, d), "session_id", ["tool_name", "event"], "id", "instant")
    return feature_wide(long, "session_id", ["tool_name", "event"], listed, FEATURES_AS_OF_MS, last_ids=last_ids)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Number and latest observation of every session, tool and event that occur together, from the pivoted table."""
    listed = _listed(spark, d)
    return feature_rows(_features(spark, d, listed, True), "session_id", ["tool_name", "event"], listed)


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per session: count and age of each tool and event, and totals.

    Ages are milliseconds before ``FEATURES_AS_OF_MS``.
    """
    return _features(spark, d, _listed(spark, d), False)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges and rows of every target and type."""
    edges = table(spark, d, "edges").select("source_id", "target_id", label(F.col("type")).alias("type"))
    whole = edges.where("source_id is not null and target_id is not null and type is not null")
    return distinct_counts(whole, ["target_id", "type"], "source_id").select(
        "target_id", "type", F.col("n_items").alias("n_edges"), "n_rows"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets and types that hold at least ``HEAVY_PERCENT`` of the distinct edges."""
    counts = p5_counts(spark, d)
    whole = counts.agg(F.sum("n_edges")).scalar()
    return counts.where(F.col("n_edges") * 100 >= whole * HEAVY_PERCENT).select("target_id", "type")


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_features, p5_found, p5_counts)}

_ENDS = """
ends as (
  select edge_id, side, key, seen from (
    select edge_id, 'source' as side, source_id as key, indexed_at as seen from edges
    union all select edge_id, 'target', target_id, indexed_at from edges)
  where key is not null and not starts_with(key, 'param:') and not starts_with(key, 'field:') and not starts_with(key, 'error:')),
records as (
  select id, indexed_at as since, deleted_at as until from nodes where id is not null
  union all select id, null, null from nodes_class where id is not null),
judged as (
  select e.edge_id, e.side, e.key, e.seen,
    count(r.id) as n,
    count(*) filter (r.id is not null and (r.since is null or r.since <= e.seen) and (r.until is null or r.until > e.seen)) as there,
    count(*) filter (r.until <= e.seen) as gone
  from ends e left join records r on r.id = e.key group by all),
orphans as (
  select edge_id, side, key, seen, case when n = 0 then 'missing' when gone > 0 then 'deleted' else 'later' end as kind
  from judged where n = 0 or (there = 0 and seen is not null))
"""

_OBS = """
names as (select lower(trim(alias)) as alias, min(tool_name) as tool_name from tool_aliases group by 1),
obs as (
  select o.id, o.session_id, case when abs(o.timestamp) < 100000000000 then o.timestamp * 1000 else o.timestamp end as instant,
    coalesce(n.tool_name, trim(o.tool_name)) as tool_name, lower(trim(o.event)) as event
  from session_observations o left join names n on n.alias = lower(trim(o.tool_name))),
once as (
  select session_id, tool_name, event, id, max(instant) as instant from obs
  where session_id is not null and tool_name is not null and event is not null and id is not null group by all),
long as (
  select session_id, tool_name, event, count(*) as n_events, arg_max(id, (instant, id)) as last_id, min(instant) as first_at, max(instant) as last_at
  from once group by all)
"""

_P5 = """
counts as (
  select target_id, lower(trim(type)) as type, count(distinct source_id) as n_edges, count(*) as n_rows from edges
  where source_id is not null and target_id is not null and type is not null group by all)
"""

_EVENTS = ", ".join(f"'{e}'" for e in EVENTS)

SQL = {
    "p2_found": f"with {_ENDS} select edge_id, side, kind from orphans",
    "p2_counts": f"with {_ENDS} select side, date_trunc('month', seen)::timestamp as period, kind, count(*) as n_refs, count(distinct key) as n_keys from orphans group by all",
    "p3_found": f"with {_OBS} select session_id, tool_name, event, n_events, last_id from long",
    "p3_features": f"""
with {_OBS},
types as (select distinct tool_name || '|' || e as type from tool_aliases, (select unnest([{_EVENTS}]) as e) where tool_name is not null),
cells as (
  select session_id, tool_name || '|' || event as type, n_events as n, {FEATURES_AS_OF_MS} - last_at as age from long where tool_name || '|' || event in (from types)
  union all select null, type, null, null from types),
totals as (
  select session_id, sum(n_events)::bigint as n_events, count(*) as n_types, min(first_at) as first_at, max(last_at) as last_at from long group by 1)
select t.*, w.* exclude (session_id) from totals t
join (select * from (pivot cells on type using coalesce(sum(n), 0)::bigint as n, max(age) as age group by session_id)) w on w.session_id is not distinct from t.session_id""",
    "p5_found": f"with {_P5} select target_id, type from counts where n_edges * 100 >= (select sum(n_edges) from counts)",
    "p5_counts": f"with {_P5} select target_id, type, n_edges, n_rows from counts",
}
