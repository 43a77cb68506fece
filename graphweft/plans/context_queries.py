"""Queries on communities and on what a reader of the graph is told, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, context, health
from ..session import written
from ..sources.graph import between_vertices, edges, functions, vertices
from ..sources.tables import table
from .activity_queries import _OBS, _observations
from .graph_queries import _COUPLING, _CYCLES, BASE, STRUCTURAL, _dead, coupling_hotspots, dead_code, file_cycles, god_classes

#: What is a name, and what a file, in running text.
NAMES, FILES = r"[A-Za-z_][A-Za-z0-9_]*", r"[A-Za-z0-9_.-]*[A-Za-z0-9_-]\.[A-Za-z]+"
#: Kinds of documents that state rules for a scope.
RULES = ("constraints", "decisions")


def _structure(spark: SparkSession, d: str) -> DataFrame:
    kept = between_vertices(edges(spark, d).where(F.col("type").isin(*STRUCTURAL)), vertices(spark, d))
    return kept.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities found in the structural graph."""
    return community.communities(_structure(spark, d))


def community_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well the communities that the functions carry fit the structural graph."""
    return community.community_quality(_structure(spark, d), functions(spark, d).where("community >= 0").select(F.col("id").alias("node"), "community"))


def community_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return community.fingerprints(functions(spark, d).where("community >= 0").select(F.col("id").alias("node"), "community"))


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Shortest structural paths between all nodes that pass each node."""
    links = written(_structure(spark, d))  # asked for several times
    return community.betweenness(links, links.select(F.col("src").alias("node"))).select("node", F.round("betweenness", 6).alias("betweenness"))


def definitions(spark: SparkSession, d: str) -> DataFrame:
    return context.definitions(functions(spark, d), edges(spark, d))


def node_metrics(spark: SparkSession, d: str) -> DataFrame:
    return context.node_metrics(vertices(spark, d), edges(spark, d), functions(spark, d), table(spark, d, "nodes_class"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    dead = dead_code(spark, d).select("id").join(vertices(spark, d).select("id", "file_path"), "id").distinct()
    return context.issue_list(dead, coupling_hotspots(spark, d), file_cycles(spark, d), god_classes(spark, d))


def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


def issues_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Issues of each file by severity."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return _issues(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_issues"), of("error"), of("warning"), of("info"))


def edit_contexts(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("file:read", "file:edit", "file:create")
    rows = _observations(spark, d).where(F.col("event").isin(*kinds)).where("file_path is not null and session_id is not null and id is not null")
    reads = F.col("event") == "file:read"
    touches = rows.groupBy("session_id", "file_path").agg(F.bool_or(reads).alias("was_read"), F.bool_or(~reads).alias("was_edited"))
    return context.edit_contexts(touches, health.file_edges(vertices(spark, d), edges(spark, d)))


def scoped_rules(spark: SparkSession, d: str) -> DataFrame:
    return context.scoped_counts(vertices(spark, d), table(spark, d, "documents"), RULES)


def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    return context.mentions(table(spark, d, "documents"), "doc_id", "text", NAMES, vertices(spark, d).select(F.col("name").alias("term")))


def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    files = vertices(spark, d).select(F.substring_index("file_path", "/", -1).alias("term"))
    return context.mentions(table(spark, d, "documents"), "doc_id", "text", FILES, files)


def learned_rules(spark: SparkSession, d: str) -> DataFrame:
    """Files edited in session after session, as rules with their confidence."""
    edits = _observations(spark, d).where("event = 'file:edit'")
    return context.learned_rules(edits.select(F.col("file_path").alias("rule"), F.col("id").alias("ident"), "session_id", "instant"))


def index_depths(spark: SparkSession, d: str) -> DataFrame:
    return context.index_depths(table(spark, d, "nodes").where("deleted_at is null"))


def affected_symbols(spark: SparkSession, d: str) -> DataFrame:
    return context.affected_symbols(table(spark, d, "session_observations"))


def async_calls(spark: SparkSession, d: str) -> DataFrame:
    return context.async_calls(functions(spark, d), edges(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        communities, community_quality, community_fingerprints, betweenness, definitions, node_metrics, issue_list, issues_by_file, edit_contexts,
        scoped_rules, name_mentions, file_mentions, learned_rules, index_depths, affected_symbols, async_calls,
    )
}

_W = f"with {BASE}"
_ISSUES = f"""with recursive {BASE}, {_CYCLES}, {_COUPLING}, {_dead()},
owned as (select file_path, split_part(name, '.', 1) as name, count(*) as method_count from vertex where kind = 'method' group by all),
cls as (select file_path, name, betweenness from nodes_class union all select distinct file_path, split_part(name, '.', 1), null from vertex where kind = 'method'),
issue as (
  select distinct 'info' as severity, 'dead_code' as category, file_path, id as subject from dead join vertex using (id)
  union all select 'warning', 'coupling', file_path, kind from hot
  union all select 'error', 'circular', file_path, cycle from cyc where cycle in (select cycle from cyc group by 1 having count(*) > 1)
  union all select case when coalesce(case when isnan(betweenness) then 0 else betweenness end, 0) >= 0.3 then 'error' else 'warning' end, 'god_class', file_path, name
    from cls join owned using (file_path, name) where method_count >= 3)"""


def _mentions(pattern: str, terms: str) -> str:
    return f"""{_W}, t as ({terms}), w as (select doc_id, unnest(regexp_extract_all(text, '{pattern}')) as term from documents)
select term, count(distinct doc_id) as n_documents, count(*) as n_mentions from w where term in (select term from t where term is not null) group by 1"""


SQL = {
    "community_quality": f"""{_W}, m as (select id, community from fn where community >= 0),
pair as (select distinct least(source_id, target_id) as a, greatest(source_id, target_id) as b from structural),
placed as (select x.community as ca, y.community as cb from pair join m x on x.id = a join m y on y.id = b),
way as (select ca, cb from placed union all select cb, ca from placed),
s as (select ca as community, count(*) filter (ca = cb) as twice, count(*) filter (ca <> cb) as links_out from way group by 1), t as (select count(*) as m2 from way)
select community, count(*) as n_nodes, coalesce(any_value(twice), 0) // 2 as links_inside, coalesce(any_value(links_out), 0) as links_out,
  round(coalesce(any_value(twice / m2 - ((twice + links_out) / m2) * ((twice + links_out) / m2)), 0.0), 9) as modularity
from m left join s using (community) cross join t group by 1""",
    "community_fingerprints": f"{_W} select community, count(*) as n_nodes, sum(('0x' || left(md5(id), 8))::bigint)::bigint as fingerprint from fn where community >= 0 group by 1",
    "definitions": f"""{_W}, f as (select id, name, coalesce(page_rank, 0) as rank from fn where name is not null),
chosen as (select *, row_number() over (partition by name order by rank desc, id) as k, count(*) over (partition by name) as n_definitions from f),
call as (select target_id as id, source_id, row_number() over (partition by target_id order by source_id) as place from edge where type = 'calls'),
c as (select id, count(*) as n_callers, string_agg(source_id, ' ' order by source_id) filter (place <= 5) as callers from call group by 1)
select name, id, n_definitions, coalesce(n_callers, 0) as n_callers, coalesce(callers, '') as callers from chosen left join c using (id) where k = 1""",
    "node_metrics": f"""{_W}, ends as (select source_id as id, target_id as other from edge union all select target_id, source_id from edge),
l as (select id, count(*) as n_links from ends where id in (select id from vertex) and other in (select id from vertex) group by 1),
m as (select id, community, page_rank, betweenness from fn union all select id, community, page_rank, betweenness from nodes_class where id is not null)
select v.id, v.kind, v.name, v.file_path, coalesce(community, -1) as community, coalesce(case when not isnan(page_rank) then page_rank end, 0) as page_rank,
  coalesce(case when not isnan(betweenness) then betweenness end, 0) as betweenness, coalesce(n_links, 0) as n_links from vertex v left join m using (id) left join l using (id)""",
    "issue_list": f"{_ISSUES} select * from issue",
    "issues_by_file": f"{_ISSUES} select file_path, count(*) as n_issues, count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warning') as n_warning, count(*) filter (severity = 'info') as n_info from issue group by 1",
    "edit_contexts": f"""with {_OBS}, {BASE}, p as (select distinct from_file, to_file from link),
x as (select e.session_id, e.file_path, count(from_file) as n, count(r.file_path) as k
  from touch e left join p on to_file = e.file_path left join (select session_id, file_path from touch where was_read) r on r.session_id = e.session_id and r.file_path = from_file
  where e.was_edited group by all)
select session_id, file_path, n as n_dependents, n - k as n_unread, n >= 10 as high_impact from x""",
    "scoped_rules": f"""{_W}, f as (select distinct file_path from vertex where file_path is not null),
s as (select scope, source from documents where source in ('constraints', 'decisions') and scope is not null)
select file_path, count(*) filter (source = 'constraints') as n_constraints, count(*) filter (source = 'decisions') as n_decisions
from f left join s on scope = 'global' or scope = file_path or starts_with(file_path, scope || '/') group by 1""",
    "name_mentions": _mentions(NAMES, "select name as term from vertex"),
    "file_mentions": _mentions(FILES, "select split_part(file_path, '/', -1) as term from vertex"),
    "learned_rules": f"""with {_OBS}, e as (select file_path, id, session_id, max(instant) as instant from obs where event = 'file:edit' and file_path is not null group by all),
g as (select file_path as rule, count(*) as occurrences, count(distinct session_id) as n_sessions, max(instant) as last from e group by 1),
w as (select *, case when n_sessions >= 3 then least(0.8 + (n_sessions - 3) * 0.05, 0.99) else 0.3 + (n_sessions - 1) * 0.2 end as base, (select max(instant) from obs where event = 'file:edit') as fin from g)
select rule, occurrences, n_sessions, round(case when fin - last >= 2592000000 then greatest(base - 0.05, 0.05) else base end, 6)::double as confidence,
  case when n_sessions >= 3 then 'approved' else 'suggested' end as status from w""",
    "index_depths": """with p as (select file_path, metadata, case when json_valid(metadata) then (metadata::json->>'$.stage')::int end as stage from nodes where deleted_at is null and file_path is not null)
select file_path, min(stage) as least_stage, max(stage) as greatest_stage, count(*) filter (stage is null) as n_without, count(*) filter (not json_valid(metadata) and metadata <> '') as n_broken from p group by 1""",
    "affected_symbols": """with o as (select distinct id, session_id, symbols_affected as s from session_observations where id is not null),
x as (select distinct id, session_id, unnest(case when json_valid(s) then json_extract_string(s, '$[*]') end) as symbol from o)
select symbol, count(*) as n_observations, count(distinct session_id) as n_sessions from x where symbol is not null group by 1""",
    "async_calls": f"""{_W} select e.source_id as id, count(*) as n_calls, count(*) filter (t.is_async) as n_async
from edge e left join fn t on t.id = e.target_id where e.type = 'calls' and e.source_id in (select id from fn) group by 1""",
}
