"""Queries for what is asked of the graph: resolution, neighbours, flows, types, work lists, snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.names import canonical_path, label
from ..operators import context, health, lookup, search, sessions, store, traverse
from ..sources.graph import edges, functions, vertices
from ..sources.tables import table
from .activity_queries import _OBS, AFTER, BEFORE, _as_of, _observations
from .graph_queries import _COUPLING, _CYCLES, _LAST, BASE, _dead, _handlers, _path, _reach

#: A file is worked on again below this stage; a function is an entry above this score; flows end after so many edges.
STAGE, ENTRY_SCORE, FLOW_DEPTH = 5, 0.9, 10
#: Rows loaded after this instant are the later state of a table that is kept.
LOADED = "2025-09-01 00:00:00"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for: every file and symbol that observations name, and the id of every entry function."""
    rows = table(spark, d, "session_observations").select("file_path", "symbols_affected")
    files = rows.select(canonical_path(F.col("file_path")).alias("asked")).distinct()
    json = F.when(F.try_parse_json("symbols_affected").isNotNull(), F.col("symbols_affected"))
    symbols = rows.select(F.explode(F.from_json(json, "array<string>")).alias("asked")).distinct()
    entries = table(spark, d, "nodes_function").where("is_entry_point").select(F.col("id").alias("asked"))
    names = table(spark, d, "nodes_function").where("is_entry_point").select(F.upper("name").alias("asked"))
    return files.unionByName(symbols).unionByName(entries).unionByName(names).where("asked is not null").distinct()


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    return lookup.resolved(_asked(spark, d), vertices(spark, d))


def direct_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lookup.neighbours(resolved_ids(spark, d), edges(spark, d), vertices(spark, d))


def file_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lookup.file_neighbours(vertices(spark, d), edges(spark, d))


def asked_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The vertices whose ids are asked for, by one semi-join."""
    return vertices(spark, d).join(_asked(spark, d).withColumnRenamed("asked", "id"), "id", "left_semi")


def trace_data(spark: SparkSession, d: str) -> DataFrame:
    """Data from handlers forward and to them backward."""
    e, seeds = edges(spark, d), _handlers(spark, d)
    forward = traverse.data_steps(seeds, e, 5).withColumn("direction", F.lit("forward"))
    return forward.unionByName(traverse.data_steps(seeds, e, 5, False).withColumn("direction", F.lit("backward")))


def trace_flow_sync(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the flows from handlers that no call of an asynchronous function carries on."""
    waits = functions(spark, d).where("is_async").select(F.col("id").alias("target_id"), F.lit("calls").alias("type"))
    return traverse.flow_steps(_handlers(spark, d), edges(spark, d).join(waits, ["target_id", "type"], "left_anti"), 5)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes_function").where("id is not null")
    newest = rows.groupBy("id").agg(F.max(F.struct("indexed_at", "is_entry_point", "entry_point_score")).alias("v"))
    return newest.where(F.coalesce("v.is_entry_point", F.lit(False)) | (F.col("v.entry_point_score") > ENTRY_SCORE)).select(F.col("id").alias("node"))


def call_flows(spark: SparkSession, d: str) -> DataFrame:
    """The flow of each entry over calls."""
    return traverse.execution_flows(_entries(spark, d), edges(spark, d), functions(spark, d), FLOW_DEPTH, ("calls",))


def execution_flows(spark: SparkSession, d: str) -> DataFrame:
    """The flow of each entry over calls and data."""
    return traverse.execution_flows(_entries(spark, d), edges(spark, d), functions(spark, d), FLOW_DEPTH)


def flow_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The flows of the entries that handlers are, by entry."""
    return execution_flows(spark, d).join(_handlers(spark, d).withColumnRenamed("node", "entry"), "entry", "left_semi")


def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of files by their imports."""
    links = edges(spark, d).where("type = 'imports'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return traverse.topological_levels(links)


def propagated_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes_function").where("id is not null").groupBy("id").agg(F.max(F.struct("indexed_at", "file_path", "line_start", "line_end", "signature")).alias("v"))
    return lookup.propagated_types(vertices(spark, d), edges(spark, d), rows.select("id", "v.file_path", "v.line_start", "v.line_end", "v.signature"))


def refined_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls from or to a function that returns something, of those whose types are known."""
    typed = table(spark, d, "nodes_function").where("signature like '%: Promise<%'").select("id")
    return lookup.refined_calls(edges(spark, d), typed)


def production_vertices(spark: SparkSession, d: str) -> DataFrame:
    kept = health.production(vertices(spark, d))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def health_production(spark: SparkSession, d: str) -> DataFrame:
    """Health of what is no test, build or dependency: counts and scores of cycles, dead code and coupling.

    There are no rules to hold the code against, so their part of the score is full.
    """
    kept = health.production(vertices(spark, d))
    ids = kept.select("id").distinct()
    inner = edges(spark, d).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    links = health.file_edges(kept, inner)
    files = links.where("type in ('imports', 'extends')").select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(health.dead_code(kept, inner), "dead_code").join(one(health.coupling_hotspots(links), "coupling"))
    counts = counts.join(traverse.components_of_cycles(files).agg(F.count_distinct("cycle").alias("circular")))
    return health.health_score(counts.withColumn("constraints", F.lit(0)))


def ripples(spark: SparkSession, d: str) -> DataFrame:
    touches = sessions.touched(_observations(spark, d)).where("was_edited")
    return lookup.ripples(touches, vertices(spark, d), edges(spark, d))


def activity_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One row of what all sessions read, edited and may have reached."""
    seen = sessions.touched(_observations(spark, d))
    per_file = seen.groupBy("file_path").agg(F.bool_or("was_read").alias("r"), F.bool_or("was_edited").alias("e"))
    files = vertices(spark, d).where("kind = 'file'").select("file_path").distinct()
    known = files.join(per_file, "file_path", "left").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("r").alias("n_read"), F.count_if("e").alias("n_edited"))
    told = sessions.once(_observations(spark, d)).agg(F.count_distinct("session_id").alias("n_sessions"))
    reached = ripples(spark, d).agg(F.sum("total_affected").alias("total_affected"), F.sum("critical_paths").alias("critical_paths"))
    pulse = sessions.pulse(_observations(spark, d), functions(spark, d)).agg(F.max("pulse").alias("pulse"))
    blind = sessions.blind_spots(_observations(spark, d), health.file_edges(vertices(spark, d), edges(spark, d))).agg(F.sum("n_blind").alias("n_blind"))
    whole = known.join(told).join(reached).join(pulse).join(blind)  # one row each
    return whole.withColumn("awareness", F.round(F.col("n_read") / F.col("n_files"), 6))


def session_rows(spark: SparkSession, d: str) -> DataFrame:
    """Start, end and size of every session."""
    rows = sessions.once(_observations(spark, d))
    return rows.groupBy("session_id").agg(F.min("instant").alias("started_at"), F.max("instant").alias("ended_at"), F.count(F.lit(1)).alias("n_observations"))


def top_files(spark: SparkSession, d: str) -> DataFrame:
    """The five files that each session attends to most at its end, of equal accesses the last, then by name."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("accesses"), F.desc("last_tick"), "file_path"))
    return sessions.attention(_observations(spark, d)).withColumn("place", place).where(F.col("place") <= 5).select("session_id", "place", "file_path", "accesses")


def work_list(spark: SparkSession, d: str) -> DataFrame:
    """Files none of whose rows has reached the stage."""
    depths = context.index_depths(table(spark, d, "nodes").where("deleted_at is null"))
    return depths.where(F.coalesce("greatest_stage", F.lit(0)) < STAGE).select("file_path", F.coalesce("greatest_stage", F.lit(0)).alias("stage"))


def changed_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices that are new or have another hash than at the earlier instant."""
    nodes = table(spark, d, "nodes")
    found = store.difference(store.as_of(nodes, BEFORE), store.as_of(nodes, AFTER))
    return found.where("change in ('added', 'changed')").select("id")


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "edges").select("source_id", "target_id", label(F.col("type")).alias("type"), "loaded_at").dropna()
    late = F.col("loaded_at") > F.lit(LOADED).cast(rows.schema["loaded_at"].dataType)
    keys = ["source_id", "target_id", "type"]
    first = lambda df: df.groupBy(*keys).agg(F.min("loaded_at").alias("loaded_at"))
    return first(rows.where(~late)), first(rows.where(late))


def inserted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by type after those loaded later are put in where they are missing, with how many came so."""
    old, new = _loaded(spark, d)
    late = F.col("loaded_at") > F.lit(LOADED).cast(old.schema["loaded_at"].dataType)
    both = store.insert_absent(old, new, ["source_id", "target_id", "type"])
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(late).alias("n_inserted"))


def edges_after_prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    """Edges by type without those out of the functions of the files changed last."""
    rows = table(spark, d, "change_records").where("file is not null")
    last = rows.agg(F.max(F.to_date("changed_at"))).scalar()
    files = rows.where(F.to_date("changed_at") == last).select(canonical_path(F.col("file")).alias("file_path"))
    return store.delete_by_prefix(edges(spark, d), files).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def replaced_files(spark: SparkSession, d: str) -> DataFrame:
    """Vertices by file after all rows of each file indexed later take the place of its earlier ones."""
    rows = table(spark, d, "nodes").where("id is not null and indexed_at is not null").select("id", "file_path", "indexed_at").distinct()
    late = F.col("indexed_at") > F.lit(LOADED).cast(rows.schema["indexed_at"].dataType)
    kept = store.replace_files(rows.where(~late), rows.where(late))
    return kept.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def growth_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The three latest months of each edge type, as snapshots of how many edges were found."""
    rows = table(spark, d, "edges").where("indexed_at is not null and type is not null")
    months = rows.groupBy(label(F.col("type")).alias("type"), F.date_trunc("month", "indexed_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return store.latest_snapshots(months, "type", "month", 3)


def node_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of the vertices' names and paths: documents and occurrences of each term."""
    found = search.postings(vertices(spark, d).select("id", F.concat_ws(" ", "name", "file_path").alias("text")), "id", F.col("text"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_occurrences"))


def _asking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), texts.words(F.col("text")).alias("terms")).where("size(terms) > 0")


def node_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best vertices for the words of every hundredth text, by the better score of name and path."""
    found = vertices(spark, d).select("id", "name", "file_path")
    return search.best_field(_asking(spark, d), found, "id", [F.col("name"), F.col("file_path")])


def node_search_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the names of entry functions that are no word of a name: the first ten vertices by id whose name holds one, scored by their place."""
    parts = table(spark, d, "nodes_function").where("is_entry_point").select(F.substring("name", 2, 6).alias("asked")).distinct()
    return search.by_part(parts, vertices(spark, d).select("id", "name"))


QUERIES = {
    f.__name__: f
    for f in (
        resolved_ids, direct_neighbours, file_neighbours, asked_vertices, trace_data, trace_flow_sync, call_flows, execution_flows, flow_lookup, topological_levels,
        propagated_types, refined_calls, production_vertices, health_production, ripples, activity_snapshot, session_rows, top_files, work_list,
        changed_vertices, inserted_edges, edges_after_prefix_delete, replaced_files, growth_snapshots, node_postings, node_search, node_search_by_part,
    )
}

_W, _RW = f"with {BASE}", f"with recursive {BASE}"
_ASKED = f"""asked as (
  select distinct q from (
    select {_path('file_path')} as q from session_observations
    union all select unnest(case when json_valid(symbols_affected) then json_extract_string(symbols_affected, '$[*]') end) from session_observations
    union all select id from nodes_function where is_entry_point union all select upper(name) from nodes_function where is_entry_point) where q is not null)"""
_RESOLVED = f"""{_ASKED},
s1 as (select q, id, 'id' as how from asked join (select distinct id from vertex) v on v.id = q),
s2 as (select q, id, 'file' as how from asked join (select distinct id from vertex) v on v.id = 'file:' || q where q not in (select q from s1)),
s3 as (select distinct q, id, 'path' as how from asked join vertex on file_path = q where q not in (select q from s1 union all select q from s2)),
rest as (select q from asked where q not in (select q from s1 union all select q from s2 union all select q from s3)),
s4 as (select q, id, 'name' as how from (select q, id, row_number() over (partition by q order by id) as k from (select distinct q, id from rest join vertex on q <> '' and contains(lower(name), lower(q)))) where k <= 20),
found as (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4 union all select q, q, 'none' from rest where q not in (select q from s4))"""
_SEEDS = "select id as node from fn where starts_with(name, 'handle') or ends_with(name, 'Handler')"


def _data(direction: str, here: str, there: str, extra: str) -> str:
    visited = _reach(_SEEDS, f"select {here} as src, {there} as dst from edge where type = 'flows_to'", 4).removesuffix(" select node, depth from r4")
    return f"select * from (with {visited} select e.source_id as source, e.target_id as target, e.type, r4.depth + 1 as depth, '{direction}' as direction from edge e join r4 on r4.node = e.{here} where e.type in ('flows_to', '{extra}'))"


def _flows(types: str) -> str:
    return f"""ent as (select id from (select id, is_entry_point, entry_point_score, row_number() over (partition by id order by indexed_at desc nulls last, is_entry_point desc nulls last, entry_point_score desc nulls last) as k
  from nodes_function where id is not null) where k = 1 and (coalesce(is_entry_point, false) or entry_point_score > {ENTRY_SCORE})),
hop as (select distinct source_id, target_id from edge where type in ({types})),
walk as (select id as entry, id as node, 0 as depth from ent union select w.entry, h.target_id, w.depth + 1 from walk w join hop h on h.source_id = w.node where w.depth < {FLOW_DEPTH}),
seen as (select entry, node, min(depth) as depth from walk group by all),
flow as (
  select entry, count(*) as n_nodes, max(depth) as depth, bool_or(node in (select id from fn where is_async)) as has_async, bool_or(node in (select source_id from edge where starts_with(target_id, 'error:'))) as has_error_path
  from seen group by 1)"""


_PRODUCTION = _RW.replace("vertex as (", "every_vertex as (", 1).replace("structural as (", """vertex as (select * from every_vertex where not coalesce(regexp_matches(file_path, '(^|/)(?:test|dist|build|coverage|node_modules)/|\\.test\\.|\\.spec\\.'), false)),
edge_of as (select * from edge where source_id in (select id from vertex) and target_id in (select id from vertex)),
structural as (""", 1)


def _inner(sql: str) -> str:
    """The text with its edges restricted to those between the vertices left."""
    return sql.replace("from edge ", "from edge_of ").replace("from edge)", "from edge_of)")


_RIPPLES = """ed as (select distinct session_id, id from touch join vertex using (file_path) where was_edited),
hit as (select d.session_id, e.source_id, e.type from edge e join ed d on d.id = e.target_id where e.type <> 'contains' and (d.session_id, e.source_id) not in (select (session_id, id) from ed)),
rip as (select session_id, count(distinct source_id) as total_affected, count(source_id) filter (type in ('calls', 'imports')) as critical_paths from (select distinct session_id from ed) left join hit using (session_id) group by 1)"""
_LOADED_SQL = f"""k as (select source_id, target_id, lower(trim(type)) as type, min(loaded_at) filter (loaded_at <= timestamp '{LOADED}') as old, min(loaded_at) as first
  from edges where source_id is not null and target_id is not null and type is not null and loaded_at is not null group by all)"""


def _field(name: str, column: str) -> str:
    return f"""{name}_w as (select id as doc, [x for x in regexp_split_to_array(lower({column}), '[^a-z0-9]+') if x <> ''] as ws from vertex where {column} is not null),
{name}_all as (select count(*) as n, avg(len(ws)) as mean from {name}_w),
{name}_tf as (select doc, len, term, count(*) as tf from (select doc, len(ws) as len, unnest(ws) as term from {name}_w) where term in (select term from ask) group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by 1),
{name} as (select query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))), 6) as score
  from {name}_tf join {name}_df using (term) join ask using (term), {name}_all group by all)"""


SQL = {
    "resolved_ids": f"{_W}, {_RESOLVED} select q as asked, id, how from found",
    "direct_neighbours": f"""{_W}, {_RESOLVED},
near as (select distinct q, 'dependency' as direction, target_id as id from found join edge on source_id = found.id union all select distinct q, 'dependent', source_id from found join edge on target_id = found.id)
select q as asked, direction, v.id, kind, name, file_path from near join vertex v using (id)""",
    "file_neighbours": f"""{_W}, w as (select source_id as id, 'out' as direction, type, target_id as other from edge union all select target_id, 'in', type, source_id from edge)
select a.file_path, w.id, direction, type, other, b.name as other_name from w join vertex a on a.id = w.id join vertex b on b.id = other where a.file_path is not null""",
    "asked_vertices": f"{_W}, {_ASKED} select * from vertex where id in (select q from asked)",
    "trace_data": f"{_W} {_data('forward', 'source_id', 'target_id', 'reads')} union all {_data('backward', 'target_id', 'source_id', 'writes')}",
    "call_flows": f"{_RW}, {_flows(repr('calls'))} select * from flow",
    "execution_flows": f"""{_RW}, {_flows("'calls', 'flows_to'")} select * from flow""",
    "flow_lookup": f"""{_RW}, {_flows("'calls', 'flows_to'")} select * from flow where entry in ({_SEEDS})""",
    "propagated_types": f"""{_W}, sg as (select id, signature from (select id, signature, row_number() over (partition by id order by indexed_at desc nulls last) as k from nodes_function where id is not null) where k = 1),
ret as (select id, regexp_replace(regexp_extract(signature, '\\)\\s*:\\s*(.+)$', 1), '^Promise<(.*)>$', '\\1') as type from sg),
cal as (select source_id as id, min({{'callee': target_id, 'type': ret.type}}) as best from edge join ret on ret.id = target_id where edge.type = 'calls' and ret.type <> '' and ret.type <> 'void' group by 1)
select v.id as variable, min(best).type as type, 0.8::double as confidence, min(best).callee as callee from vertex v join fn f on f.file_path = v.file_path and v.line_start between f.line_start and f.line_end join cal on cal.id = f.id
where v.kind = 'variable' group by 1""",
    "refined_calls": f"{_W}, t as (select id from nodes_function where signature like '%: Promise<%') select source_id, target_id from edge where type = 'calls' and (source_id in (from t) or target_id in (from t))",
    "production_vertices": f"{_PRODUCTION} select kind, count(*) as n from vertex group by 1",
    "health_production": f"""{_inner(_PRODUCTION).replace('from edge_of where source_id in (select id from vertex) and target_id', 'from edge where source_id in (select id from vertex) and target_id', 1)}, {_CYCLES}, {_COUPLING}, {_inner(_dead())},
c as (select 0 as constraints, (select count(distinct cycle) from cyc where cycle in (select cycle from cyc group by 1 having count(*) > 1)) as circular, (select count(*) from dead) as dead_code, (select count(*) from hot) as coupling),
p as (select *, greatest(0, 100 - constraints * 20) as constraints_score, greatest(0, 100 - circular * 25) as circular_score, greatest(0, 100 - dead_code * 2) as dead_code_score, greatest(0, 100 - coupling * 15) as coupling_score from c)
select *, floor(constraints_score * 0.4 + circular_score * 0.2 + dead_code_score * 0.2 + coupling_score * 0.2 + 0.5)::bigint as score from p""",
    "ripples": f"with {_OBS}, {BASE}, {_RIPPLES} select * from rip",
    "activity_snapshot": f"""with {_OBS}, {BASE}, {_RIPPLES},
pf as (select file_path, bool_or(was_read) as r, bool_or(was_edited) as e from touch group by 1),
fl as (select count(*) as n_files, count(*) filter (r) as n_read, count(*) filter (e) as n_edited from (select distinct file_path from vertex where kind = 'file') left join pf using (file_path)),
need as (select distinct t.session_id, l.to_file from touch t join link l on l.from_file = t.file_path where was_edited)
select fl.*, (select count(distinct session_id) from obs) as n_sessions, (select sum(total_affected) from rip)::bigint as total_affected, (select sum(critical_paths) from rip)::bigint as critical_paths,
  (select max(coalesce(m, 0)) from (select session_id, max(rank) as m from touch left join (select file_path, max(page_rank) as rank from fn group by 1) using (file_path) where was_edited group by 1)) as pulse,
  (select count(*) from need n where not exists (select 1 from touch t where t.session_id = n.session_id and t.file_path = n.to_file and was_read)) as n_blind, round(n_read / n_files, 6) as awareness from fl""",
    "session_rows": f"with {_OBS}, o as (select distinct session_id, id, instant from obs) select session_id, min(instant) as started_at, max(instant) as ended_at, count(*) as n_observations from o group by 1",
    "top_files": f"""with {_OBS}, t as (select *, row_number() over (partition by session_id order by instant, id) as tick, count(*) over (partition by session_id) as ticks from obs),
a as (select session_id, file_path, count(*) as accesses, max(tick) as last_tick from t where file_path is not null group by session_id, file_path, ticks having ticks - max(tick) <= 50)
select session_id, place, file_path, accesses from (select *, row_number() over (partition by session_id order by accesses desc, last_tick desc, file_path) as place from a) where place <= 5""",
    "work_list": f"""with p as (select file_path, case when json_valid(metadata) then (metadata::json->>'$.stage')::int end as stage from nodes where deleted_at is null and file_path is not null)
select file_path, coalesce(max(stage), 0) as stage from p group by 1 having coalesce(max(stage), 0) < {STAGE}""",
    "changed_vertices": f"with {_as_of('a', BEFORE)}, {_as_of('b', AFTER)} select b.id from b left join a on a.id = b.id where a.id is null or a.digest <> b.digest",
    "inserted_edges": f"with {_LOADED_SQL} select type, count(*) as n_edges, count(*) filter (old is null) as n_inserted from k group by 1",
    "edges_after_prefix_delete": f"{_W} select type, count(*) as n_edges from edge where not (starts_with(source_id, 'fn:') and split_part(source_id[4:], ':', 1) in ({_LAST})) group by 1",
    "replaced_files": f"""with r as (select distinct id, file_path, indexed_at, indexed_at > timestamp '{LOADED}' as late from nodes where id is not null and indexed_at is not null)
select file_path, count(*) as n_rows, count(distinct id) as n_ids from r where late or file_path is null or file_path not in (select file_path from r where late and file_path is not null) group by 1""",
    "growth_snapshots": """with m as (select lower(trim(type)) as type, date_trunc('month', indexed_at)::timestamp as month, count(*) as n from edges where indexed_at is not null and type is not null group by all)
select * from (select *, row_number() over (partition by type order by month desc) as place from m) where place <= 3""",
    "node_postings": f"""{_W}, w as (select id, [x for x in regexp_split_to_array(lower(concat_ws(' ', name, file_path)), '[^a-z0-9]+') if x <> ''] as ws from vertex),
t as (select id, unnest(ws) as term from w) select term, count(distinct id) as n_docs, count(*) as n_occurrences from t group by 1""",
    "node_search": f"""{_W}, ask as (select distinct doc_id as query, unnest([x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> '']) as term from documents where doc_id % 100 = 0 and text is not null),
{_field('bn', 'name')}, {_field('bp', 'file_path')},
b as (select query, doc, max(score) as score from (select * from bn union all select * from bp) group by all)
select * from (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from b) where rank <= 10""",
    "node_search_by_part": f"""{_W}, asked as (select distinct substring(name, 2, 6) as q from nodes_function where is_entry_point and name is not null), wd as (select distinct unnest([x for x in regexp_split_to_array(lower(name), '[^a-z0-9]+') if x <> '']) as w from vertex where name is not null),
rest as (select q from asked where not list_has_any([x for x in regexp_split_to_array(lower(q), '[^a-z0-9]+') if x <> ''], (select list(w) from wd)))
select query, doc, round(1.0::double / rank, 6) as score, rank from (
  select q as query, id as doc, row_number() over (partition by q order by id) as rank from (select distinct q, id from rest join vertex on q <> '' and contains(lower(name), lower(q)))) where rank <= 10""",
}
_WAITS = "(type <> 'calls' or target_id not in (select id from fn where is_async))"
_SYNC = _reach(_SEEDS, f"select source_id as src, target_id as dst from edge where type in ('calls', 'flows_to') and {_WAITS}", 4).removesuffix(" select node, depth from r4")
SQL["trace_flow_sync"] = f"""{_W}, {_SYNC}
select e.source_id as source, e.target_id as target, e.type, r4.depth + 1 as depth from edge e join r4 on r4.node = e.source_id where e.type in ('calls', 'flows_to', 'reads', 'writes', 'returns') and {_WAITS}"""
