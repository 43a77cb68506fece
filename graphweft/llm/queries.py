"""Queries of the training-data operators, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_path, current_names, instant_ms
from ..sources.tables import table
from .cooccur import cooccurrence
from .encode import encode
from .mixing import mix
from .runs import collapse_runs
from .sentences import sentences
from .topn import latest_rows, top_n

#: A pair of files is reported from so many common commits, at so many times chance.
MIN_TOGETHER, MIN_LIFT = 5, 4
#: Places reported of each community.
PLACES = 5


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run of observations with the same tool and file, runs of one too."""
    rows = table(spark, d, "session_observations").select(
        "id", "session_id", instant_ms(F.col("timestamp")).alias("instant"), F.col("tool_name").alias("written"), canonical_path(F.col("file_path")).alias("file_path")
    )
    named = current_names(rows, "written", table(spark, d, "tool_aliases"), "tool_name")
    return collapse_runs(named, "session_id", "instant", "id", ["tool_name", "file_path"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last observation of every run of two or more."""
    return p1_runs(spark, d).where("n_events > 1").select("session_id", "first_id", "last_id")


def _commit_files(spark: SparkSession, d: str) -> DataFrame:
    """``(repo, commit, file)``: every file that a commit's rows name; a row without commit id is a commit of its own."""
    rows = table(spark, d, "change_records").select(
        "repo",
        F.coalesce(F.concat(F.lit("c:"), "commit_id"), F.concat(F.lit("r:"), F.col("record_id").cast("string"))).alias("commit"),
        F.explode(F.concat(F.array("file"), F.coalesce("changedWith", F.array().cast("array<string>")))).alias("file"),
    )
    return rows.select("repo", "commit", canonical_path(F.col("file")).alias("file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that change together in at least five commits and four times as often as chance."""
    pairs = cooccurrence(_commit_files(spark, d), "repo", "commit", "file", min_together=MIN_TOGETHER, min_lift=MIN_LIFT)
    return pairs.select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b")).distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two files with a common commit: number of common commits and lift."""
    pairs = cooccurrence(_commit_files(spark, d), "repo", "commit", "file")
    return pairs.select(
        "repo", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The five functions of highest rank of every community."""
    functions = table(spark, d, "nodes_function").select("id", "indexed_at", "community", "page_rank")
    state = latest_rows(functions, "id", "indexed_at").where("community >= 0")
    return top_n(state, "community", "page_rank", "id", PLACES).select("community", "pos", "id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a collection in which each source has its share of the tokens, with their repeats."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of that collection by source."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every text; in tool output each line is one."""
    documents = table(spark, d, "documents").select("doc_id", "text", (F.col("source") == "tool_output").alias("per_line"))
    return sentences(documents, "doc_id", "text", per_line="per_line")


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p4_found, p4_pairs, p6_found, p7_ids, p8_mix, p8_shares, p9_found)}

def _path(c: str) -> str:
    clean = f"trim(replace({c}, chr(92), '/'))"
    flat = f"regexp_replace(regexp_replace({clean}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    for _ in range(3):
        flat = f"regexp_replace({flat}, '/[^/]+/\\.\\./', '/')"
    return f"nullif(regexp_replace({flat}, '^.*?(packages/.*)$', '\\1'), '')"


_OBS = f"""
names as (select lower(trim(alias)) as alias, min(tool_name) as tool_name from tool_aliases group by 1),
obs as (
  select distinct o.id, o.session_id, case when abs(o.timestamp) < 100000000000 then o.timestamp * 1000 else o.timestamp end as instant,
    coalesce(n.tool_name, trim(o.tool_name)) as tool_name, {_path('o.file_path')} as file_path
  from session_observations o left join names n on n.alias = lower(trim(o.tool_name))
  where o.session_id is not null and o.id is not null and o.timestamp is not null),
flagged as (
  select *, case when lag(id) over w is not null and lag(tool_name) over w is not distinct from tool_name
    and lag(file_path) over w is not distinct from file_path then 0 else 1 end as is_new
  from obs window w as (partition by session_id order by instant, id)),
numbered as (select *, sum(is_new) over (partition by session_id order by instant, id rows unbounded preceding) as run from flagged),
runs as (
  select session_id, arg_min(id, (instant, id)) as first_id, arg_max(id, (instant, id)) as last_id, any_value(tool_name) as tool_name,
    any_value(file_path) as file_path, count(*) as n_events, min(instant) as started_at, max(instant) as ended_at, max(instant) - min(instant) as duration
  from numbered group by session_id, run)
"""

_PAIRS = f"""
named as (
  select repo, coalesce('c:' || commit_id, 'r:' || record_id) as commit, unnest(list_concat([file], coalesce(changedWith, []))) as f from change_records),
held as (select distinct repo, commit, {_path('f')} as f from named where repo is not null),
sizes as (select repo, count(distinct commit) as n from held group by 1),
counts as (select repo, f, count(*) as k from held where f is not null group by all),
together as (
  select x.repo, x.f as file_a, y.f as file_b, count(*) as n_ab from held x join held y on x.repo = y.repo and x.commit = y.commit and x.f < y.f group by all),
pairs as (
  select t.repo, file_a, file_b, n_ab, a.k as n_a, b.k as n_b, s.n, round(n_ab * s.n / (a.k * b.k), 6) as lift
  from together t join counts a on a.repo = t.repo and a.f = file_a join counts b on b.repo = t.repo and b.f = file_b join sizes s on s.repo = t.repo)
"""

SQL = {
    "p1_found": f"with {_OBS} select session_id, first_id, last_id from runs where n_events > 1",
    "p1_runs": f"with {_OBS} select * from runs",
    "p4_found": f"with {_PAIRS} select distinct file_a, file_b from pairs where n_ab >= 5 and n_ab * n >= 4 * n_a * n_b",
    "p4_pairs": f"with {_PAIRS} select * from pairs",
    "p6_found": """
with state as (
  select id, community, page_rank, row_number() over (partition by id order by indexed_at desc nulls last, community desc nulls last, page_rank desc nulls last) as k
  from nodes_function where id is not null),
ranked as (
  select community, row_number() over (partition by community order by page_rank desc, id) as pos, id
  from state where k = 1 and community >= 0 and page_rank is not null and not isnan(page_rank))
select community, pos::int as pos, id from ranked where pos <= 5""",
}
