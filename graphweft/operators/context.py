"""What a reader of the graph is told: definitions, issues, contexts of edits, rules that apply, names that texts mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A file with so many dependents is of high impact; so many callers are named.
MANY_DEPENDENTS, CALLERS_NAMED = 10, 5
#: Fixed values of the confidence of a rule that is seen again.
SESSIONS_TO_APPROVE, DAYS_TO_FADE, FADE, LEAST, MOST = 3, 30, 0.05, 0.05, 0.99


def definitions(functions: DataFrame, edges: DataFrame, callers: int = CALLERS_NAMED) -> DataFrame:
    """Per function name: its definition of highest rank (equal ranks: least id), how many there are, and its callers.

    ``callers`` lists the first of them by id, separated by blanks. Their ranking is cut to the
    first few before the shuffle, so a much-called function gathers in no task.
    """
    named = functions.where("name is not null").select("id", "name", F.coalesce("page_rank", F.lit(0.0)).alias("rank"))
    chosen = named.groupBy("name").agg(F.min(F.struct((-F.col("rank")).alias("r"), "id")).alias("d"), F.count(F.lit(1)).alias("n_definitions"))
    calls = edges.where("type = 'calls'").select(F.col("target_id").alias("id"), F.col("source_id").alias("caller"))
    counts = calls.groupBy("id").agg(F.count(F.lit(1)).alias("n_callers"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("caller"))
    first = calls.withColumn("place", place).where(F.col("place") <= callers).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("caller")), " ").alias("callers"))
    found = chosen.select("name", F.col("d.id").alias("id"), "n_definitions").join(counts, "id", "left").join(first, "id", "left")
    return found.select("name", "id", "n_definitions", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("callers", F.lit("")).alias("callers"))


def node_metrics(vertices: DataFrame, edges: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """The graph's vertices with their metrics: community (-1 without), ranks (0 without), links to vertices that exist."""
    ids = vertices.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    shown = ["id", "community", "page_rank", "betweenness"]
    metrics = functions.select(shown).unionByName(classes.where("id is not null").select(shown))
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)).alias(c)
    return vertices.join(metrics, "id", "left").join(ends, "id", "left").select(
        "id", "kind", "name", "file_path", F.coalesce("community", F.lit(-1)).alias("community"), zero("page_rank"), zero("betweenness"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def issue_list(dead: DataFrame, coupling: DataFrame, cycles: DataFrame, classes: DataFrame) -> DataFrame:
    """Findings of four kinds in one form ``(severity, category, file_path, subject)``, one row per file they concern.

    ``dead (file_path, id)``, ``coupling (file_path, kind)``, ``cycles (file_path, cycle)``,
    ``classes (file_path, name, severity)``.
    """
    form = lambda df, severity, category, subject: df.select(severity.alias("severity"), F.lit(category).alias("category"), "file_path", F.col(subject).alias("subject"))
    return (
        form(dead, F.lit("info"), "dead_code", "id")
        .unionByName(form(coupling, F.lit("warning"), "coupling", "kind"))
        .unionByName(form(cycles, F.lit("error"), "circular", "cycle"))
        .unionByName(form(classes, F.col("severity"), "god_class", "name"))
    )


def edit_contexts(touches: DataFrame, links: DataFrame) -> DataFrame:
    """Per session and file edited in it: how many files depend on the file and how many of them the session never read.

    ``touches (session_id, file_path, was_read, was_edited)`` has one row per session and file;
    ``links`` are ``file_edges``. Dependents are counted once per file. Those read are found from
    what the session read, along the few files each file depends on, so a file with
    very many dependents is never multiplied by its edits.
    """
    pairs = links.select("from_file", "to_file").distinct()
    counts = pairs.groupBy(F.col("to_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n_dependents"))
    edited = touches.where("was_edited").select("session_id", "file_path")
    read = touches.where("was_read").select("session_id", F.col("file_path").alias("from_file"))
    known = read.join(pairs, "from_file").groupBy("session_id", F.col("to_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n_read"))
    n, k = F.coalesce("n_dependents", F.lit(0)), F.coalesce("n_read", F.lit(0))
    return edited.join(counts, "file_path", "left").join(known, ["session_id", "file_path"], "left").select(
        "session_id", "file_path", n.alias("n_dependents"), (n - k).alias("n_unread"), (n >= MANY_DEPENDENTS).alias("high_impact")
    )


def scoped_counts(files: DataFrame, documents: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Per file: the documents of each of ``sources`` that apply to it, of scope ``global`` or a folder (or file) it lies in.

    Documents are counted per scope first; a file meets them through its own few path prefixes,
    in an equal join instead of comparing every scope with every file.
    """
    per_scope = documents.where(F.col("source").isin(*sources) & F.col("scope").isNotNull()).groupBy("scope").agg(*(F.count_if(F.col("source") == s).alias(s) for s in sources))
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    reached = files.where("file_path is not null").select("file_path").distinct().select("file_path", F.explode(F.array_distinct(F.concat(prefixes, F.array(F.lit("global"))))).alias("scope"))
    return reached.join(per_scope, "scope", "left").groupBy("file_path").agg(*(F.sum(F.coalesce(s, F.lit(0))).alias(f"n_{s}") for s in sources))


def mentions(documents: DataFrame, key: str, text: str, pattern: str, terms: DataFrame) -> DataFrame:
    """``(term, n_documents, n_mentions)`` of the ``terms (term)`` that whole texts mention as a match of ``pattern``."""
    words = documents.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("term"))
    counted = words.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_mentions"))
    return counted.join(terms.where("term is not null").select("term").distinct(), "term", "left_semi")


def learned_rules(seen: DataFrame) -> DataFrame:
    """Confidence of what is seen again and again, of ``seen (rule, ident, session_id, instant)``, instants in milliseconds.

    One session gives 0.3, two 0.5, three 0.8 and each further one 0.05 more, 0.99 at most. What was last seen thirty
    days or more before the end of the table loses 0.05 but keeps that much. Three sessions approve it. Sessions count
    once each, in whatever order they come, so that all is a sum and no rule is ordered in one task.
    """
    once = seen.where("rule is not null and ident is not null and session_id is not null").groupBy("rule", "session_id", "ident").agg(F.max("instant").alias("instant"))
    per_session = once.groupBy("rule", "session_id").agg(F.count(F.lit(1)).alias("n"), F.max("instant").alias("last"))
    rules = per_session.groupBy("rule").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_sessions"), F.max("last").alias("last_seen"))
    end = seen.agg(F.max("instant").alias("end"))
    s = F.col("n_sessions")
    base = F.when(s >= SESSIONS_TO_APPROVE, F.least(F.lit(0.8) + (s - 3) * 0.05, F.lit(MOST))).otherwise(F.lit(0.3) + (s - 1) * 0.2)
    old = F.col("end") - F.col("last_seen") >= DAYS_TO_FADE * 86_400_000
    faded = F.when(old, F.greatest(base - FADE, F.lit(LEAST))).otherwise(base)
    status = F.when(s >= SESSIONS_TO_APPROVE, "approved").otherwise("suggested")
    return rules.join(F.broadcast(end)).select("rule", "occurrences", "n_sessions", F.round(faded, 6).alias("confidence"), status.alias("status"))  # end is one row


def index_depths(vertices: DataFrame) -> DataFrame:
    """Per file, from the JSON ``metadata`` of its rows: least and greatest stage reached, rows without stage, broken JSON.

    Null, empty and broken JSON has no stage; null and empty JSON does not count as broken.
    """
    parsed = F.try_parse_json("metadata")
    stage = F.try_variant_get(parsed, "$.stage", "int")
    rows = vertices.where("file_path is not null").select("file_path", stage.alias("stage"), (parsed.isNull() & (F.col("metadata") != "")).alias("broken"))
    return rows.groupBy("file_path").agg(
        F.min("stage").alias("least_stage"), F.max("stage").alias("greatest_stage"), F.count_if(F.col("stage").isNull()).alias("n_without"), F.count_if("broken").alias("n_broken")
    )


def affected_symbols(observations: DataFrame) -> DataFrame:
    """``(symbol, n_observations, n_sessions)`` from the JSON lists of ``observations (id, session_id, symbols_affected)``; broken JSON names nothing."""
    named = F.from_json(F.when(F.try_parse_json("symbols_affected").isNotNull(), F.col("symbols_affected")), "array<string>")
    once = observations.where("id is not null").select("id", "session_id", F.explode(named).alias("symbol")).where("symbol is not null").distinct()
    per_session = once.groupBy("symbol", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per_session.groupBy("symbol").agg(F.sum("n").alias("n_observations"), F.count("session_id").alias("n_sessions"))


def async_calls(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per function that calls others: its calls and those of asynchronous functions."""
    waits = functions.where("is_async").select(F.col("id").alias("target_id"), F.lit(True).alias("waits"))
    calls = edges.where("type = 'calls'").join(waits, "target_id", "left")
    return calls.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_calls"), F.count("waits").alias("n_async")).join(functions.select("id"), "id", "left_semi")
