"""Queries on the code graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_path
from ..operators import graph, health, patterns, traverse
from ..sources.graph import between_vertices, edges, functions, vertices
from ..sources.tables import table

#: Edge types that make up the structural graph of ranks and layers.
STRUCTURAL = ("calls", "flows_to", "implements")


def hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(vertices(spark, d), edges(spark, d))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(vertices(spark, d), edges(spark, d))


def overview(spark: SparkSession, d: str) -> DataFrame:
    return graph.overview(vertices(spark, d), edges(spark, d))


def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbol_references(vertices(spark, d), edges(spark, d))


def file_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_context(vertices(spark, d), edges(spark, d))


def enclosing_scopes(spark: SparkSession, d: str) -> DataFrame:
    return graph.enclosing_scopes(vertices(spark, d))


def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = between_vertices(edges(spark, d).where(F.col("type").isin(*STRUCTURAL)), vertices(spark, d))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return health.file_edges(vertices(spark, d), edges(spark, d))


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


def coupling_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return health.coupling_hotspots(_links(spark, d))


def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return health.dead_code(vertices(spark, d), edges(spark, d))


def file_cycles(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d).where("type in ('imports', 'extends')")
    return traverse.components_of_cycles(links.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"))).withColumnRenamed("node", "file_path")


def health_score(spark: SparkSession, d: str) -> DataFrame:
    """Counts and scores; there are no rules to hold the code against, so ``constraints`` is 0 and its 40 % of the score full."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(dead_code(spark, d), "dead_code").join(one(coupling_hotspots(spark, d), "coupling")).join(
        file_cycles(spark, d).agg(F.count_distinct("cycle").alias("circular"))
    )
    return health.health_score(counts.withColumn("constraints", F.lit(0)))


def _layered(spark: SparkSession, d: str) -> DataFrame:
    kept = between_vertices(edges(spark, d).where(F.col("type").isin(*STRUCTURAL)), vertices(spark, d))
    nodes = functions(spark, d)
    return patterns.layers(nodes.select("id", "name", "file_path", "community"), graph.degrees(vertices(spark, d), kept))


def layer_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _layered(spark, d).select("id", "layer", "confidence")


def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    return _layered(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("community").alias("n_communities"))


def layer_findings(spark: SparkSession, d: str) -> DataFrame:
    return patterns.layer_findings(_layered(spark, d), edges(spark, d))


def god_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of at least three methods here (the operator's own threshold is ten): the tables hold few methods a class."""
    methods = vertices(spark, d).where("kind = 'method'")
    owners = methods.select("file_path", F.substring_index("name", ".", 1).alias("name"), F.lit(None).cast("double").alias("betweenness")).distinct()
    classes = table(spark, d, "nodes_class").select("file_path", "name", "betweenness")
    return patterns.god_classes(classes.unionByName(owners), methods, threshold=3)


def complexity_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return patterns.complexity_hotspots(functions(spark, d))


def feature_envy(spark: SparkSession, d: str) -> DataFrame:
    return patterns.feature_envy(vertices(spark, d), edges(spark, d))


def shotgun_surgery(spark: SparkSession, d: str) -> DataFrame:
    return patterns.shotgun_surgery(vertices(spark, d), edges(spark, d))


def predicted_impact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "change_records").select(canonical_path(F.col("file")).alias("file"), F.transform("changedWith", lambda f: canonical_path(f)).alias("changedWith"))
    return patterns.predicted_impact(rows)


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return patterns.entry_points(functions(spark, d), edges(spark, d))


def _hub_seeds(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(vertices(spark, d), edges(spark, d), 5).select(F.col("id").alias("seed"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    found = traverse.blast_radius(_hub_seeds(spark, d), edges(spark, d))
    return found.select("seed", "node", "depth", F.round("confidence", 6).alias("confidence"))


def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return traverse.impact_summary(traverse.blast_radius(_hub_seeds(spark, d), edges(spark, d)))


def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """Per file: what changes of the files of the last day of records may affect, by best confidence."""
    rows = table(spark, d, "change_records").select("file", "changed_at").where("file is not null")
    last = rows.agg(F.max(F.to_date("changed_at"))).scalar()
    files = rows.where(F.to_date("changed_at") == last).select(canonical_path(F.col("file")).alias("file_path")).distinct()
    shown = vertices(spark, d)
    seeds = shown.where("kind <> 'file'").join(files, "file_path").select(F.col("id").alias("seed")).distinct()
    found = traverse.blast_radius(seeds, edges(spark, d)).where("depth > 0")
    best = found.groupBy(F.col("node").alias("id")).agg(F.max("confidence").alias("c"))
    return best.join(shown.select("id", "file_path"), "id").groupBy("file_path").agg(F.round(F.max("c"), 6).alias("max_confidence"), F.count(F.lit(1)).alias("n_nodes"))


def _handlers(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).where(F.col("name").rlike("^handle|Handler$")).select(F.col("id").alias("node"))


def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that flows from handlers pass; all steps, those of values read, written and returned too, are in ``trace_flow_steps``."""
    starts = _handlers(spark, d)
    links = edges(spark, d).where("type in ('calls', 'flows_to')").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return traverse.reach(starts, links, 5)


def trace_flow_steps(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow_steps(_handlers(spark, d), edges(spark, d), 5)


def taint(spark: SparkSession, d: str) -> DataFrame:
    """How far values flow from the readers of variables along ``flows_to``, ten rounds as the sweep it stands for has.

    The tables carry no labels of flows, so all that is read counts as a source.
    """
    links = edges(spark, d).where("type = 'flows_to'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    seeds = edges(spark, d).where("type = 'reads'").select(F.col("source_id").alias("node"))
    return traverse.reach(seeds, links, 10)


def cascade_invalidation(spark: SparkSession, d: str) -> DataFrame:
    """Files to be worked on again after a change of the files edited last, by reverse imports up to ten levels."""
    rows = table(spark, d, "change_records").where("file is not null")
    last = rows.agg(F.max(F.to_date("changed_at"))).scalar()
    seeds = rows.where(F.to_date("changed_at") == last).select(F.concat(F.lit("file:"), canonical_path(F.col("file"))).alias("node"))
    links = edges(spark, d).where("type = 'imports'").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return traverse.reach(seeds, links, 10)


def implementors(spark: SparkSession, d: str) -> DataFrame:
    return traverse.implementors(edges(spark, d))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    shown = vertices(spark, d).where("kind in ('function', 'class', 'method', 'interface')")
    links = between_vertices(edges(spark, d).where(F.col("type").isin(*STRUCTURAL)), shown)
    ranks = traverse.pagerank(shown, links.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    return ranks.select("id", F.round("rank", 9).alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        hubs, degrees, overview, symbol_references, file_context, enclosing_scopes, structural_edges, file_edges, coupling_hotspots,
        dead_code, file_cycles, health_score, layer_assignments, layer_summary, layer_findings, god_classes, complexity_hotspots,
        feature_envy, shotgun_surgery, predicted_impact, entry_points, blast_radius, impact_summary, change_impact, trace_flow, trace_flow_steps, taint,
        cascade_invalidation, implementors, pagerank,
    )
}

BASE = """
edge as (select distinct source_id, target_id, lower(trim(type)) as type from edges where source_id is not null and target_id is not null and type is not null),
vertex as (
  select id, type as kind, name, file_path, line_start, line_end, is_exported from (
    select *, row_number() over (partition by id order by indexed_at desc nulls last, type desc nulls last, name desc nulls last, file_path desc nulls last,
      line_start desc nulls last, line_end desc nulls last, is_exported desc nulls last) as k from nodes where id is not null and deleted_at is null) where k = 1
  union all select id, 'class', name, file_path, line_start, line_end, is_exported from nodes_class where id is not null),
fn as (
  select * from (select id, name, file_path, line_start, line_end, is_async, is_exported, community, case when not isnan(page_rank) then page_rank end as page_rank,
      case when not isnan(betweenness) then betweenness end as betweenness,
      row_number() over (partition by id order by indexed_at desc nulls last) as k from nodes_function where id is not null) where k = 1),
structural as (
  select * from edge where type in ('calls', 'flows_to', 'implements') and source_id <> target_id
    and source_id in (select id from vertex) and target_id in (select id from vertex)),
link as (
  select a.file_path as from_file, b.file_path as to_file, e.type, count(*) as n from edge e join vertex a on a.id = e.source_id join vertex b on b.id = e.target_id
  where e.type <> 'contains' and a.file_path <> b.file_path group by all)
"""


def _path(c: str) -> str:
    clean = f"trim(replace({c}, chr(92), '/'))"
    flat = f"regexp_replace(regexp_replace({clean}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    for _ in range(3):
        flat = f"regexp_replace({flat}, '/[^/]+/\\.\\./', '/')"
    return f"nullif(regexp_replace({flat}, '^.*?(packages/.*)$', '\\1'), '')"


_COUPLING = """
w as (select *, n * case type when 'calls' then 1.0 when 'extends' then 1.0 when 'imports' then 0.5 else 0.7 end as w from link),
fan as (
  select coalesce(i.f, o.f) as file_path, coalesce(fan_in, 0.0)::double as fan_in, coalesce(fan_out, 0.0)::double as fan_out, coalesce(incoming, 0) as incoming, coalesce(outgoing, 0) as outgoing
  from (select to_file as f, round(sum(w), 6) as fan_in, count(distinct from_file) as incoming from w group by 1) i
  full join (select from_file as f, round(sum(w), 6) as fan_out, count(distinct to_file) as outgoing from w group by 1) o on i.f = o.f),
ranked as (select greatest(fan_in, fan_out) as v, row_number() over (order by greatest(fan_in, fan_out)) as k, count(*) over () as n from fan),
lim as (select greatest(4.0, min(v)) as l from ranked where k >= least(floor(n * 0.9) + 1, n)),
hot as (
  select fan.*, case when fan_in >= l and fan_out >= l then 'both' when fan_in >= l then 'fan-in' else 'fan-out' end as kind from fan, lim where fan_in >= l or fan_out >= l)
"""


def _dead(rounds: int = 8) -> str:
    able = """able as (select distinct id from vertex where kind in ('function', 'class') and coalesce(name, '') not in ('main', 'cli', 'handler', 'run', 'start', 'app', 'server')
  and not coalesce(is_exported, false) and not coalesce(regexp_matches(file_path, '\\.tsx$') and regexp_matches(name, '^[A-Z]'), false)),
ref as (select distinct source_id, target_id as id from edge where type <> 'contains' and target_id in (select id from able)),
dead0 as (select id, 0 as round from able where id not in (select id from ref))"""
    for k in range(1, rounds + 1):
        able += f""",
dead{k} as (select * from dead{k - 1} union all select r.id, {k} from ref r left join dead{k - 1} x on x.id = r.source_id
  where r.id not in (select id from dead{k - 1}) group by r.id having count(*) = count(x.id))"""
    return able + f", dead as (select * from dead{rounds})"


_WORDS = ", ".join(
    f"({k}, '{layer}', '{w}')" for k, (layer, w) in enumerate((layer, w) for layer, ws in patterns.LAYER_WORDS.items() for w in ws)
)
_LAYERS = f"""
word(ord, layer, w) as (values {_WORDS}),
hit as (
  select f.id, w.layer, length(w.w) / greatest(length(coalesce(f.name, '')), 1) as score, row_number() over (partition by f.id order by length(w.w) desc, w.ord) as place
  from fn f join word w on contains(lower(coalesce(f.name, '')), w.w) or contains(lower(coalesce(f.file_path, '')), w.w)),
deg as (
  select f.id, (select count(*) from structural s where s.source_id = f.id and f.id in (select id from vertex)) as n_out,
    (select count(*) from structural s where s.target_id = f.id and f.id in (select id from vertex)) as n_in from fn f),
told as (
  select f.id, f.community, coalesce(h.layer, case when n_out > 0 and n_in = 0 then 'controller' when n_in > 0 and n_out = 0 then 'database' when n_out > 0 then 'service' else 'unknown' end) as layer,
    least(1.0, coalesce(h.score, case when n_out > 0 and n_in > 0 then 0.2 when n_out > 0 or n_in > 0 then 0.3 else 0.0 end) + 0.3) as confidence
  from fn f left join hit h on h.id = f.id and h.place = 1 join deg d on d.id = f.id),
main as (
  select community, layer, row_number() over (partition by community order by count(*) desc, layer) as place from told where layer <> 'unknown' and community is not null group by community, layer),
layered as (
  select t.id, t.community, case when t.layer = 'unknown' and m.layer is not null then m.layer else t.layer end as layer,
    round(case when t.layer = 'unknown' and m.layer is not null then least(1.0, confidence + 0.1) else confidence end, 6)::double as confidence
  from told t left join main m on m.community = t.community and m.place = 1)
"""

_WEIGHT = "case type when 'calls' then 0.9::double when 'imports' then 0.7 when 'imports_symbol' then 0.7 when 'references' then 0.4 when 'contains' then 0.3 else 0.5 end"


def _blast(seeds: str, depth: int = 3) -> str:
    sql = f"""back as (select source_id, target_id, max({_WEIGHT}) as w from edge group by all),
lev0 as (select distinct seed, seed as node, 0 as depth, 1.0::double as confidence from ({seeds})), all0 as (select * from lev0)"""
    for k in range(1, depth + 1):
        sql += f""",
lev{k} as (select seed, node, {k} as depth, c as confidence from (
    select l.seed, b.source_id as node, max(l.confidence * b.w) as c from lev{k - 1} l join back b on b.target_id = l.node group by all) r
  where not exists (select 1 from all{k - 1} a where a.seed = r.seed and a.node = r.node and a.confidence >= r.c)),
all{k} as (select * from all{k - 1} union all select * from lev{k})"""
    return sql + f", blast as (select * from all{depth})"


_HUBS = "hub as (select id, kind, name, file_path, count(*) as edge_count from (select source_id as id from edge union all select target_id from edge) join vertex using (id) group by all)"
_SEEDS = "select id as seed from hub order by edge_count desc, id limit 5"


def _reach(seeds: str, links: str, depth: int) -> str:
    sql = f"hop as (select distinct src, dst from ({links})), r0 as (select distinct node, 0 as depth from ({seeds}))"
    for k in range(1, depth + 1):
        sql += f""",
r{k} as (select * from r{k - 1} union all select distinct dst, {k} from r{k - 1} join hop on src = node where depth = {k - 1} and dst not in (select node from r{k - 1}))"""
    return sql + f" select node, depth from r{depth}"


def _pagerank(rounds: int = 10) -> str:
    sql = """v as (select distinct id from vertex where kind in ('function', 'class', 'method', 'interface')),
l as (select source_id, target_id from edge where type in ('calls', 'flows_to', 'implements') and source_id <> target_id and source_id in (select id from v) and target_id in (select id from v)),
o as (select source_id as id, count(*) as n from l group by 1),
n as (select count(*)::double as n from v),
r0 as materialized (select v.id, 1.0 / n.n as rank, o.n as leads from v cross join n left join o using (id))"""
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        sql += f""",
r{k} as materialized (select v.id, (0.15 + 0.85 * (select coalesce(sum(rank), 0) from {p} where leads is null)) / n.n + 0.85 * coalesce(g.got, 0) as rank, o.n as leads
  from v cross join n left join o using (id) left join (select l.target_id as id, sum(p.rank / p.leads) as got from l join {p} p on p.id = l.source_id group by 1) g using (id))"""
    return sql + f" select id, round(rank, 9) as rank from r{rounds}"


_LAST = f"select {_path('file')} as f from change_records where file is not null and changed_at::date = (select max(changed_at)::date from change_records where file is not null)"
_W = f"with {BASE}"
SQL = {
    "hubs": f"{_W}, {_HUBS} select * from hub order by edge_count desc, id limit 20",
    "degrees": f"{_W} select v.id, v.kind, coalesce(o.n, 0) as n_out, coalesce(i.n, 0) as n_in from vertex v left join (select source_id as id, count(*) as n from edge group by 1) o using (id) left join (select target_id as id, count(*) as n from edge group by 1) i using (id)",
    "overview": f"{_W} select 'kind' as what, kind as name, count(*) as n from vertex group by all union all select 'type', type, count(*) from edge group by all union all select 'total', 'symbols', count(*) from vertex where kind <> 'file' union all select 'total', 'edges', count(*) from edge",
    "symbol_references": f"{_W} select v.id, v.kind, v.name, count(*) filter (e.type = 'calls') as callers, count(*) filter (e.type = 'imports') as importers, count(*) filter (e.type = 'extends') as extenders, count(*) filter (e.type = 'implements') as implementors from edge e join vertex v on v.id = e.target_id where e.type in ('calls', 'imports', 'extends', 'implements') group by all",
    "file_context": f"""{_W}, used as (select e.source_id, e.target_id, a.file_path as f, b.file_path as t from edge e join vertex a on a.id = e.source_id join vertex b on b.id = e.target_id where e.type <> 'contains' and a.file_path <> b.file_path)
select s.file_path, symbols, coalesce(dependencies, 0) as dependencies, coalesce(dependents, 0) as dependents from (select file_path, count(*) as symbols from vertex where kind <> 'file' and file_path is not null group by 1) s
left join (select f as file_path, count(distinct target_id) as dependencies from used group by 1) using (file_path) left join (select t as file_path, count(distinct source_id) as dependents from used group by 1) using (file_path)""",
    "enclosing_scopes": f"""{_W}, around as (select v.id as variable, s.id as scope, s.line_end - s.line_start as span, row_number() over (partition by v.id order by s.line_end - s.line_start, s.id) as place
from vertex v left join vertex s on s.kind in ('function', 'method') and s.file_path = v.file_path and v.line_start between s.line_start and s.line_end where v.kind = 'variable') select variable, scope, span from around where place = 1""",
    "structural_edges": f"{_W} select type, count(*) as n_edges from structural group by 1",
    "file_edges": f"{_W} select * from link",
    "coupling_hotspots": f"{_W}, {_COUPLING} select * from hot",
    "dead_code": f"{_W}, {_dead()} select id, round from dead",
    "layer_assignments": f"{_W}, {_LAYERS} select id, layer, confidence from layered",
    "layer_summary": f"{_W}, {_LAYERS} select layer, count(*) as n_nodes, count(distinct community) as n_communities from layered group by 1",
    "layer_findings": f"""{_W}, {_LAYERS}, o(layer, k) as (values ('controller', 0), ('service', 1), ('repository', 2), ('database', 3))
select a.layer as from_layer, b.layer as to_layer, case when x.k > y.k then 'dependency_direction' when y.k - x.k > 1 then 'layer_violation' end as finding, count(*) as n_edges
from edge e join layered a on a.id = e.source_id join layered b on b.id = e.target_id left join o x on x.layer = a.layer left join o y on y.layer = b.layer group by all""",
    "god_classes": f"""{_W}, owned as (select file_path, split_part(name, '.', 1) as name, count(*) as method_count from vertex where kind = 'method' group by all),
cls as (select file_path, name, betweenness from nodes_class union all select distinct file_path, split_part(name, '.', 1), null from vertex where kind = 'method')
select file_path, name, method_count, case when coalesce(case when isnan(betweenness) then 0 else betweenness end, 0) >= 0.3 then 'error' else 'warning' end as severity from cls join owned using (file_path, name) where method_count >= 3""",
    "complexity_hotspots": f"""{_W}, m as (select id, coalesce(page_rank, 0) as pr, coalesce(betweenness, 0) as bw, coalesce(line_end - line_start + 1, 0) as ln from fn),
t as (select max(pr) as mp, max(bw) as mb, max(ln) as ml from m)
select id, round(0.4::double * pr / mp + 0.3::double * bw / mb + 0.3::double * ln / ml, 9) as score from m, t where round(0.4::double * pr / mp + 0.3::double * bw / mb + 0.3::double * ln / ml, 9) >= 0.3 order by score desc, id limit 10""",
    "feature_envy": f"""{_W}, c as (select a.id, a.file_path as own, b.file_path as target_file, count(*) as n from edge e join vertex a on a.id = e.source_id join vertex b on b.id = e.target_id
where e.type = 'calls' and a.kind in ('function', 'method') and b.file_path is not null group by all),
j as (select *, coalesce(max(case when own = target_file then n end) over (partition by id, own), 0) as own_calls from c)
select id, target_file, n as external_calls, own_calls from j where own <> target_file and (own_calls = 0 or n >= 2 * own_calls)""",
    "shotgun_surgery": f"{_W} select v.id, count(distinct a.file_path) as dependent_files from edge e join vertex a on a.id = e.source_id join vertex v on v.id = e.target_id where e.type <> 'contains' and a.file_path <> v.file_path group by v.id having count(distinct a.file_path) >= 5",
    "predicted_impact": f"with p as (select {_path('file')} as file, unnest(changedWith) as c from change_records), q as (select file, {_path('c')} as co_file from p) select file, co_file, count(*) as n from q where file is not null and co_file is not null and file <> co_file group by all having count(*) >= 3",
    "entry_points": f"""{_W}, s as (select f.id, round(case when regexp_matches(name, '^handle|^on[A-Z]|Controller$|Handler$') then 0.3 else 0 end + case when is_exported then 0.1 else 0 end
+ case when coalesce(o.n, 0) > 0 and coalesce(i.n, 0) <= 1 then 0.2 else 0 end + case when is_async then 0.1 else 0 end, 2)::double as score
from fn f left join (select source_id as id, count(*) as n from edge where type = 'calls' group by 1) o using (id) left join (select target_id as id, count(*) as n from edge where type = 'calls' group by 1) i using (id))
select id, score, score > 0.5 as is_entry_point from s where score > 0""",
    "blast_radius": f"{_W}, {_HUBS}, {_blast(_SEEDS)} select seed, node, depth, round(confidence, 6) as confidence from blast",
    "impact_summary": f"{_W}, {_HUBS}, {_blast(_SEEDS)} select seed, count(*) as total_affected, count(*) filter (confidence > 0.7) as critical_paths, case when max(confidence) > 0.7 then 'HIGH' when max(confidence) > 0.4 then 'MEDIUM' else 'LOW' end as risk from blast where depth > 0 group by 1",
    "change_impact": f"{_W}, {_blast(f'select distinct id as seed from vertex where kind <> $$file$$ and file_path in ({_LAST})')}, best as (select node as id, max(confidence) as c from blast where depth > 0 group by 1) select v.file_path, round(max(c), 6) as max_confidence, count(*) as n_nodes from best join vertex v using (id) group by 1",
    "taint": f"{_W}, {_reach('select source_id as node from edge where type = $$reads$$', 'select source_id as src, target_id as dst from edge where type = $$flows_to$$', 10)}",
    "cascade_invalidation": f"{_W}, {_reach(f'select $$file:$$ || f as node from ({_LAST})', 'select target_id as src, source_id as dst from edge where type = $$imports$$', 10)}",
    "pagerank": f"{_W}, {_pagerank()}",
}
SQL["trace_flow"] = f"{_W}, " + _reach(
    "select id as node from fn where starts_with(name, 'handle') or ends_with(name, 'Handler')", "select source_id as src, target_id as dst from edge where type in ('calls', 'flows_to')", 5
)
_VISITED = _reach("select id as node from fn where starts_with(name, 'handle') or ends_with(name, 'Handler')", "select source_id as src, target_id as dst from edge where type in ('calls', 'flows_to')", 4)
SQL["trace_flow_steps"] = f"""{_W}, {_VISITED.removesuffix(' select node, depth from r4')}
select e.source_id as source, e.target_id as target, e.type, r4.depth + 1 as depth from edge e join r4 on r4.node = e.source_id where e.type in ('calls', 'flows_to', 'reads', 'writes', 'returns')"""
_CYCLES = """
cl as (select distinct from_file as src, to_file as dst from link where type in ('imports', 'extends')),
closure as (select src, dst from cl union select c.src, l.dst from closure c join cl l on l.src = c.dst),
cyc as (select a.src as file_path, max(a.dst) as cycle from closure a join closure b on b.src = a.dst and b.dst = a.src group by 1)
"""
_RW = f"with recursive {BASE}"
SQL["file_cycles"] = f"{_RW}, {_CYCLES} select file_path, cycle from cyc where file_path in (select file_path from cyc) and cycle in (select cycle from cyc group by 1 having count(*) > 1)"
SQL["health_score"] = f"""{_RW}, {_CYCLES}, {_COUPLING}, {_dead()},
c as (select 0 as constraints, (select count(distinct cycle) from cyc where cycle in (select cycle from cyc group by 1 having count(*) > 1)) as circular, (select count(*) from dead) as dead_code, (select count(*) from hot) as coupling),
p as (select *, greatest(0, 100 - constraints * 20) as constraints_score, greatest(0, 100 - circular * 25) as circular_score, greatest(0, 100 - dead_code * 2) as dead_code_score, greatest(0, 100 - coupling * 15) as coupling_score from c)
select *, floor(constraints_score * 0.4 + circular_score * 0.2 + dead_code_score * 0.2 + coupling_score * 0.2 + 0.5)::bigint as score from p"""
SQL["implementors"] = f"""{_RW}, di as (select distinct target_id, source_id from edge where type = 'implements' and source_id <> target_id),
cl as (select target_id, source_id from di union select c.target_id, d.source_id from cl c join di d on d.target_id = c.source_id)
select target_id, source_id as implementor, (target_id, source_id) not in (select (target_id, source_id) from di) as indirect from cl where target_id <> source_id"""
