"""Rows that are asked for: resolution of names, neighbours, types, work lists, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Vertices that a name stands for at most; confidence of a type taken from a callee.
NAMED, FROM_CALLEE = 20, 0.8
#: Length of the pieces by which parts of names are found.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n))))


def containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``(asked, name)`` for each of ``names (name)`` that holds ``asked (asked)`` somewhere, ignoring case.

    An equal join instead of comparing each with each: names are listed under their pieces of
    three letters, and what is asked for looks under the rarest of its own (what is shorter,
    under itself). Empty and null ones find nothing.
    """
    low = names.where("name is not null").select("name", F.lower("name").alias("low")).distinct()
    want = asked.where("asked is not null and asked <> ''").select("asked", F.lower("asked").alias("want")).distinct()
    lists = low.select("name", "low", F.inline(F.flatten(F.array(*(
        F.when(F.char_length("low") >= n, F.transform(_grams(F.col("low"), n), lambda g, n=n: F.struct(F.lit(n).alias("n"), g.alias("gram")))).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))
        for n in range(1, GRAM + 1)
    )))))
    size = F.least(F.char_length("want"), F.lit(GRAM))
    own = want.select("asked", "want", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("want") - size + 1), lambda k: F.substring(F.col("want"), k, size)))).alias("gram"))
    counts = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    rarest = own.join(counts, "gram", "left").groupBy("asked", "want").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "gram")).alias("best"))
    found = rarest.select("asked", "want", F.col("best.gram").alias("gram")).join(lists.select("name", "low", "gram"), "gram")
    return found.where(F.contains("low", F.col("want"))).select("asked", "name")


def resolved(asked: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(asked, id, how)``: the vertices that each of ``asked (asked)`` stands for.

    The first of these that gives any: the vertex of that id (``id``), the file's vertex
    (``file``), all vertices of the file of that path (``path``), the first ``NAMED`` by id of
    those whose name holds it, ignoring case (``name``), and itself (``none``).
    """
    want = checkpointed(asked.where("asked is not null").select("asked").distinct())
    ids = vertices.select("id").distinct()
    steps = [
        (want.join(ids, F.col("asked") == F.col("id")).select("asked", "id"), "id"),
        (want.join(ids, F.concat(F.lit("file:"), F.col("asked")) == F.col("id")).select("asked", "id"), "file"),
        (want.join(vertices.select("id", "file_path"), F.col("asked") == F.col("file_path")).select("asked", "id").distinct(), "path"),
    ]
    given = [rows.select("asked", "id", F.lit(how).alias("how"), F.lit(k).alias("k")) for k, (rows, how) in enumerate(steps)]
    given = checkpointed(given[0].unionByName(given[1]).unionByName(given[2]))
    first = given.groupBy("asked").agg(F.min("k").alias("k"))
    found = given.join(first, ["asked", "k"]).select("asked", "id", "how")
    rest = checkpointed(want.join(given.select("asked").distinct(), "asked", "left_anti"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("id"))
    named = containing(rest, vertices.select("name")).join(vertices.select("id", "name"), "name").select("asked", "id").distinct()
    named = checkpointed(named.withColumn("place", place).where(F.col("place") <= NAMED).select("asked", "id", F.lit("name").alias("how")))
    none = rest.join(named.select("asked").distinct(), "asked", "left_anti").select("asked", F.col("asked").alias("id"), F.lit("none").alias("how"))
    return found.unionByName(named).unionByName(none)


def neighbours(asked: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(asked, direction, id, kind, name, file_path)``: what the vertices of ``asked (asked, id)`` depend on and what depends on them, each once.

    Ends that are no vertices are left out.
    """
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("dependency").alias("direction"))
    into = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("dependent").alias("direction"))
    near = out.unionByName(into).join(asked.select("asked", "id").distinct(), "id").select("asked", "direction", F.col("other").alias("id")).distinct()
    return near.join(vertices.select("id", "kind", "name", "file_path"), "id").select("asked", "direction", "id", "kind", "name", "file_path")


def file_neighbours(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(file_path, id, direction, type, other, other_name)``: every edge out of and into the vertices of each file, with the vertex at its other end."""
    own = vertices.where("file_path is not null").select("id", "file_path").distinct()
    other = vertices.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    out = edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "type", F.col("target_id").alias("other"))
    into = edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "type", F.col("source_id").alias("other"))
    return out.unionByName(into).join(own, "id").join(other, "other").select("file_path", "id", "direction", "type", "other", "other_name")


def propagated_types(vertices: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """``(variable, type, confidence, callee)``: the type of each variable by what the functions around it call.

    A variable lies in each function of its file whose lines hold its own; every callee of that
    function gives it the type that the callee's signature returns (``Promise<T>`` gives ``T``,
    ``void`` none). ``functions`` are ``(id, file_path, line_start, line_end, signature)``. Of several the least callee counts, as all are of equal confidence.
    """
    returned = F.regexp_replace(F.regexp_extract("signature", r"\)\s*:\s*(.+)$", 1), r"^Promise<(.*)>$", "$1")
    types = functions.select(F.col("id").alias("target_id"), returned.alias("type")).where("type <> '' and type <> 'void'")
    calls = edges.where("type = 'calls'").select("source_id", "target_id").join(types, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min(F.struct(F.col("target_id").alias("callee"), "type")).alias("best"))
    named = vertices.where("kind = 'variable' and line_start is not null").select(F.col("id").alias("variable"), "file_path", F.col("line_start").alias("line"))
    spans = functions.select("id", "file_path", "line_start", "line_end").join(calls, "id")
    around = named.join(spans, "file_path").where("line between line_start and line_end")
    chosen = around.groupBy("variable").agg(F.min("best").alias("best"))
    return chosen.select("variable", "best.type", F.lit(FROM_CALLEE).alias("confidence"), "best.callee")


def refined_calls(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """``(source_id, target_id)`` of the calls one of whose ends is among ``typed (id)``: two semi-joins, united."""
    calls = edges.where("type = 'calls'").select("source_id", "target_id")
    ids = typed.select("id").distinct()
    by_source = calls.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", "target_id")
    by_target = calls.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")
    return by_source.unionByName(by_target).distinct()


def ripples(touches: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(session_id, total_affected, critical_paths)``: what edits of a session may reach in one step.

    ``touches (session_id, file_path)`` are the edited files; their vertices are edited. Affected
    are the different sources of edges into them that are not edited themselves; critical the
    calls and imports among these edges.
    """
    edited = touches.join(vertices.where("file_path is not null").select("id", "file_path"), "file_path").select("session_id", "id").distinct()
    into = edges.where("type <> 'contains'").select("source_id", F.col("target_id").alias("id"), "type").join(edited, "id")
    outer = into.join(edited.select("session_id", F.col("id").alias("source_id")), ["session_id", "source_id"], "left_anti")
    critical = F.count_if(F.col("type").isin("calls", "imports"))
    per_source = outer.groupBy("session_id", "source_id").agg(critical.alias("c"))
    found = per_source.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_affected"), F.sum("c").alias("critical_paths"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_affected", "critical_paths")]
    return edited.select("session_id").distinct().join(found, "session_id", "left").select("session_id", *zero)
