"""Queries on sessions, search, stored states and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.names import canonical_path, current_names, instant_ms, label
from ..operators import health, search, sessions, store
from ..sources.graph import edges, functions, vertices
from ..sources.tables import table
from ..streaming import observations as streams
from .graph_queries import BASE, _path
from .sql import query_graph

#: What the text queries ask for.
ASKED = {"cache": ["cache", "cleared"], "confidence": ["edge", "guess", "confidence"], "rules": ["rule", "forbids", "import"], "scan": ["scan", "second", "pass"]}
#: The two instants whose states are compared.
BEFORE, AFTER = "2025-06-01 00:00:00", "2025-09-01 00:00:00"


def _observations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "session_observations").select(
        "id", "session_id", instant_ms(F.col("timestamp")).alias("instant"), F.col("tool_name").alias("written"),
        label(F.col("event")).alias("event"), canonical_path(F.col("file_path")).alias("file_path"),
    )
    return current_names(rows, "written", table(spark, d, "tool_aliases"), "tool_name")


def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tool_counts(_observations(spark, d))


def edit_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return sessions.edit_hotspots(_observations(spark, d))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions_by_gap(table(spark, d, "events"), "user_id", "ts")


def attention(spark: SparkSession, d: str) -> DataFrame:
    return sessions.attention(_observations(spark, d))


def blind_spots(spark: SparkSession, d: str) -> DataFrame:
    return sessions.blind_spots(_observations(spark, d), health.file_edges(vertices(spark, d), edges(spark, d)))


def community_activity(spark: SparkSession, d: str) -> DataFrame:
    return sessions.community_activity(_observations(spark, d), functions(spark, d))


def pulse(spark: SparkSession, d: str) -> DataFrame:
    return sessions.pulse(_observations(spark, d), functions(spark, d))


def investigation_scope(spark: SparkSession, d: str) -> DataFrame:
    return sessions.investigation_scope(_observations(spark, d))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED.items()), "query string, terms array<string>")


def bm25_text(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_asked(spark), table(spark, d, "documents"), "doc_id", F.col("text"))


def _asked_documents(docs: DataFrame, text: Column) -> DataFrame:
    asks = F.col("doc_id") % 100 == 0  # also around the words, else every text is split before it is left out
    return docs.where(asks).select(F.col("doc_id").alias("query"), F.when(asks, texts.letter_words(text)).alias("terms")).where("terms is not null")


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best texts for the words, of any script, of every hundredth text."""
    docs, text = table(spark, d, "documents"), F.col("text")
    return search.bm25(_asked_documents(docs, text), docs, "doc_id", text, split_words=texts.letter_words)


def hybrid_documents(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings of ``hybrid_rank`` for the words, of any script, of every hundredth text."""
    docs, text = table(spark, d, "documents"), F.col("text")
    parts = [text, F.concat_ws(" ", "source", "file_path")]
    return search.fuse(*search.bm25_fields(_asked_documents(docs, text), docs, "doc_id", parts, [[0], [1, 0]], 20, texts.letter_words))


def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = F.concat_ws(" ", "source", "file_path")
    by_text = search.bm25(_asked(spark), docs, "doc_id", F.col("text"), 20)
    return search.fuse(by_text, search.bm25(_asked(spark), docs, "doc_id", F.concat_ws(" ", names, F.col("text")), 20))


def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return search.cosine_top(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding")


def name_search(spark: SparkSession, d: str) -> DataFrame:
    found = vertices(spark, d).where(F.col("name").ilike("%cache%"))
    return found.orderBy("id").limit(50).select("id", "kind", "name")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.content_hash(F.col("text")).alias("hash"))


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return vertices(spark, d).where("kind = 'file'").groupBy(texts.language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", texts.slug(F.col("text")).alias("slug"))


def categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source", texts.category(F.col("text")).alias("category"))
    return rows.agg(F.count(F.lit(1)).alias("n_texts"))


def state_difference(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    return store.difference(store.as_of(nodes, BEFORE), store.as_of(nodes, AFTER))


def edges_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges left by type when the vertices that are gone take their edges with them."""
    gone = table(spark, d, "nodes").where("deleted_at is not null").join(vertices(spark, d).select("id"), "id", "left_anti")
    return store.delete_cascade(edges(spark, d), gone).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def upserted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with its last finding after the rows loaded later than ``AFTER`` are put over the others."""
    rows = table(spark, d, "edges").select("source_id", "target_id", label(F.col("type")).alias("type"), "edge_id", "indexed_at", "loaded_at")
    rows = rows.where("source_id is not null and target_id is not null and type is not null")
    late = F.col("loaded_at") > F.lit(AFTER).cast(rows.schema["loaded_at"].dataType)
    return store.upsert(rows.where(~late), rows.where(late), ["source_id", "target_id", "type"], "indexed_at").select("source_id", "target_id", "type", "indexed_at")


def graph_growth(spark: SparkSession, d: str) -> DataFrame:
    """Edges found per month and type, with how many of them arrived more than a day later."""
    rows = table(spark, d, "edges")
    late = F.col("loaded_at") > F.col("indexed_at") + F.expr("interval 1 day")
    return rows.groupBy(F.date_trunc("month", "indexed_at").alias("month"), label(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"))


_STATEMENT = """
select coalesce(kind, 'all') as kind, coalesce(type, 'all') as type, n, rank() over (order by n desc, coalesce(kind, 'all'), coalesce(type, 'all')) as place
from (select v.kind, e.type, count(*) as n from code_edge e join code_vertex v on v.id = e.target_id group by grouping sets ((v.kind, e.type), (v.kind), ()))
order by place"""


def sql_over_graph(spark: SparkSession, d: str) -> DataFrame:
    """A statement with grouping sets and a window through the read-only SQL surface."""
    return query_graph(spark, d, _STATEMENT)


def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_updates(streams.hourly_counts(streams.observation_stream(spark, f"{d}/session_observations.parquet"), "400 days"), ["hour", "event"])


def stream_attention(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_updates(streams.attention_weights(streams.observation_stream(spark, f"{d}/session_observations.parquet")), ["session_id", "file_path"])


QUERIES = {
    f.__name__: f
    for f in (
        tool_counts, edit_hotspots, user_sessions, attention, blind_spots, community_activity, pulse, investigation_scope, bm25_text, hybrid_rank,
        bm25_documents, hybrid_documents,
        cosine_top, name_search, content_hashes, file_languages, slugs, categories, state_difference, edges_after_delete, upserted_edges,
        graph_growth, sql_over_graph, stream_hourly, stream_attention,
    )
}

_OBS = f"""
names as (select lower(trim(alias)) as alias, min(tool_name) as tool_name from tool_aliases group by 1),
obs as (
  select distinct o.id, o.session_id, case when abs(o.timestamp) < 100000000000 then o.timestamp * 1000 else o.timestamp end as instant,
    coalesce(n.tool_name, trim(o.tool_name)) as tool_name, lower(trim(o.event)) as event, {_path('o.file_path')} as file_path
  from session_observations o left join names n on n.alias = lower(trim(o.tool_name)) where o.id is not null and o.session_id is not null),
touch as (
  select session_id, file_path, bool_or(event = 'file:read') as was_read, bool_or(event <> 'file:read') as was_edited from obs
  where file_path is not null and event in ('file:read', 'file:edit', 'file:create') group by all)
"""


def _bm25(text: str, name: str, k: int) -> str:
    asked = ", ".join(f"('{q}', '{t}')" for q, ts in ASKED.items() for t in ts)
    return f"""{name}_ask(query, term) as (values {asked}),
{name}_w as (select doc_id as doc, [x for x in regexp_split_to_array(lower({text}), '[^a-z0-9]+') if x <> ''] as ws from documents where {text} is not null),
{name}_all as (select count(*) as n, avg(len(ws)) as mean from {name}_w),
{name}_tf as (select doc, len, term, count(*) as tf from (select doc, len(ws) as len, unnest(ws) as term from {name}_w) where term in (select term from {name}_ask) group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by 1),
{name}_s as (
  select query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))), 6) as score
  from {name}_tf join {name}_df using (term) join {name}_ask using (term), {name}_all group by all),
{name} as (select * from (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from {name}_s) where rank <= {k})"""


def _as_of(name: str, at: str) -> str:
    return f"""{name} as (select id, type as kind, sha256(concat_ws('|', type, name, file_path, line_start::varchar, line_end::varchar)) as digest from (
  select *, row_number() over (partition by id order by indexed_at desc nulls last, type desc nulls last, sha256(concat_ws('|', type, name, file_path, line_start::varchar, line_end::varchar)) desc) as k
  from nodes where id is not null and (indexed_at is null or indexed_at <= timestamp '{at}') and (deleted_at is null or deleted_at > timestamp '{at}')) where k = 1)"""


_LANGS = ", ".join(f"('{e}', '{n}')" for e, n in texts.LANGUAGES.items())
_CASES = " ".join("when regexp_matches(lower(text), '{}') then '{}'".format(p.replace("'", "''"), n) for n, p in texts.CATEGORIES)
SQL = {
    "tool_counts": f"with {_OBS}, o as (select distinct session_id, id, tool_name from obs) select session_id, tool_name, count(*) as n from o group by all",
    "edit_hotspots": f"with {_OBS} select file_path, count(distinct id) as n_edits, count(distinct session_id) as n_sessions from obs where event = 'file:edit' and file_path is not null group by 1 having count(distinct id) >= 3",
    "user_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as b from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as started, max(ts) as ended, count(*) as n_events from s group by user_id, k""",
    "attention": f"""with {_OBS}, t as (select *, row_number() over (partition by session_id order by instant, id) as tick, count(*) over (partition by session_id) as ticks from obs)
select session_id, file_path, count(*) as accesses, max(tick) as last_tick, bool_or(coalesce(event in ('file:edit', 'file:create'), false)) as edited from t where file_path is not null group by session_id, file_path, ticks having ticks - max(tick) <= 50""",
    "blind_spots": f"with {_OBS}, {BASE}, need as (select distinct t.session_id, l.to_file from touch t join link l on l.from_file = t.file_path where was_edited) select session_id, count(*) as n_blind from need n where not exists (select 1 from touch t where t.session_id = n.session_id and t.file_path = n.to_file and was_read) group by 1",
    "community_activity": f"with {_OBS}, {BASE}, s as (select file_path, bool_or(was_read) as r, bool_or(was_edited) as e from touch group by 1) select community, count(*) as n, round(count(*) filter (r) / count(*), 6) as read_coverage, round(count(*) filter (e) / count(*), 6) as edit_intensity from fn left join s using (file_path) where community is not null group by 1",
    "pulse": f"with {_OBS}, {BASE}, r as (select file_path, max(page_rank) as rank from fn group by 1) select session_id, coalesce(max(rank), 0) as pulse, case when max(rank) > 0.01 then 'HIGH' when max(rank) > 0.005 then 'MEDIUM' else 'LOW' end as risk from touch left join r using (file_path) where was_edited group by 1",
    "investigation_scope": f"""with {_OBS}, l as (select session_id, file_path, max((instant, id)) as last from obs where file_path is not null and event = 'file:read' group by all),
r as (select * from (select *, row_number() over (partition by session_id order by last desc, file_path) as k from l) where k <= 20),
p as (select session_id, string_split(file_path, '/') as parts from r), x as (select session_id, parts, unnest(range(1, len(parts))) as k from p),
c as (select session_id, array_to_string(parts[1:k], '/') as dir, count(*) as n from x group by all),
w as (select c.* from c join (select session_id, greatest(2, count(*) // 2) as least from r group by 1) using (session_id) where n >= least)
select * from w where not exists (select 1 from w v where v.session_id = w.session_id and starts_with(v.dir, w.dir || '/'))""",
    "bm25_text": f"with {_bm25('text', 'b', 10)} select query, doc, score, rank from b",
    "hybrid_rank": f"""with {_bm25('text', 'b', 20)}, {_bm25("concat_ws(' ', source, file_path, text)", 'c', 20)},
u as (select query, doc, round(sum(1.0::double / (60 + rank)), 9) as score from (select query, doc, rank from b union all select query, doc, rank from c) group by all)
select * from (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from u) where rank <= 10""",
    "cosine_top": """with s as (select q.vec_id as query_id, r.vec_id as id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) as score from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0)
select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10""",
    "name_search": f"with {BASE} select id, kind, name from vertex where name ilike '%cache%' order by id limit 50",
    "content_hashes": "select doc_id, left(sha256(text), 32) as hash from documents",
    "file_languages": f"with {BASE}, l(e, language) as (values {_LANGS}) select language, count(*) as n_files from vertex left join l on e = lower(regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)) where kind = 'file' group by 1",
    "slugs": r"select doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 50), '-$', '') as slug from documents",
    "categories": f"select source, case when text is null then null {_CASES} when starts_with(lower(text), 'use ') and not contains(lower(text), ' in ') then 'preferences' else 'style' end as category, count(*) as n_texts from documents group by all",
    "state_difference": f"""with {_as_of('a', BEFORE)}, {_as_of('b', AFTER)}
select * from (select coalesce(b.id, a.id) as id, coalesce(b.kind, a.kind) as kind, case when a.digest is null then 'added' when b.digest is null then 'removed' when a.digest <> b.digest then 'changed' end as change from a full join b on a.id = b.id) where change is not null""",
    "edges_after_delete": f"with {BASE}, gone as (select id from nodes where deleted_at is not null and id is not null and id not in (select id from vertex)) select type, count(*) as n_edges from edge where source_id not in (select id from gone) and target_id not in (select id from gone) group by 1",
    "upserted_edges": "select source_id, target_id, lower(trim(type)) as type, max(indexed_at) as indexed_at from edges where source_id is not null and target_id is not null and type is not null group by all",
    "graph_growth": "select date_trunc('month', indexed_at)::timestamp as month, lower(trim(type)) as type, count(*) as n, count(*) filter (loaded_at > indexed_at + interval 1 day) as n_late from edges group by all",
    "sql_over_graph": f"with {BASE}, code_edge as (from edge), code_vertex as (from vertex) {_STATEMENT}".replace("with \n", "with "),
    "stream_hourly": f"with {_OBS} select date_trunc('hour', epoch_ms(instant))::timestamp as hour, event, count(distinct id) as n from obs group by all",
}
