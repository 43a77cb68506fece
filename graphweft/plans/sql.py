"""Read-only SQL over the graph."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.graph import edges, functions, vertices
from ..sources.tables import table

#: Words that a read-only statement must not hold, and the rows it gives at most.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "COPY", "EXPORT", "ATTACH", "LOAD", "INSTALL")
MAX_ROWS = 500
#: File formats that Spark would read by path from within a statement.
_PATHS = re.compile(r"\b(parquet|csv|json|orc|text|avro|binaryfile)\s*\.\s*`|\bread_files\b", re.I)


#: Expressions and plans that call code by its name or run programs.
_CALLS = frozenset({"CallMethodViaReflection", "TryReflect", "ScriptTransformation", "ScriptInputOutputSchema"})
#: Leaves of a plan that come from the statement alone or from the views.
_OWN = frozenset({"LogicalRelation", "LogicalRDD", "LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "ResolvedInlineTable", "EmptyRelation", "UnionLoopRef"})


def register(spark: SparkSession, d: str) -> None:
    """Make the graph's views known to SQL: ``code_vertex``, ``code_edge``, ``code_function``, ``code_observation``, ``code_change``."""
    vertices(spark, d).createOrReplaceTempView("code_vertex")
    edges(spark, d).createOrReplaceTempView("code_edge")
    functions(spark, d).createOrReplaceTempView("code_function")
    table(spark, d, "session_observations").createOrReplaceTempView("code_observation")
    table(spark, d, "change_records").createOrReplaceTempView("code_change")


def _items(seq: Any) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kin(cls: Any) -> set[str]:
    """Names of the interfaces and classes that a class extends."""
    names = set()
    while cls is not None:
        names |= {cls.getSimpleName(), *(c.getSimpleName() for c in cls.getInterfaces())}
        cls = cls.getSuperclass()
    return names


def check_plan(df: DataFrame, folder: str) -> None:
    """An error if the analysed plan calls Java methods or programs, is a command, or reads other files than those of ``folder``.

    Plans, their expressions, the plans of subqueries and of common table expressions are all
    looked through.
    """
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        names = _kin(node.getClass())
        if kind in _CALLS or kind.endswith("Command") or "Command" in names:
            raise ValueError(f"not read-only: {kind}")
        if "LogicalPlan" in names:
            inner = _items(node.expressions())
            leaf = node.children().isEmpty()
            if leaf and kind not in _OWN:
                raise ValueError(f"not of the views: {kind}")
            if kind == "LogicalRelation":
                for path in _items(node.relation().location().rootPaths()):
                    if not path.toUri().getPath().startswith(folder.removeprefix("file://").rstrip("/") + "/"):
                        raise ValueError("files cannot be read from a statement")
            todo += inner + _items(node.innerChildren())
        elif "PlanExpression" in names:
            todo.append(node.plan())
        todo += _items(node.children())


def check_read_only(statement: str) -> str:
    """The statement without its final semicolon; an error if it could do more than read the views."""
    body = statement.strip().rstrip(";").strip()
    if ";" in body:
        raise ValueError("one statement at a time")
    found = re.search(rf"\b({'|'.join(FORBIDDEN)})\b", body, re.I)
    if found:
        raise ValueError(f"not read-only: {found.group(1)}")
    if _PATHS.search(body):
        raise ValueError("files cannot be read from a statement")
    if not re.match(r"\(*\s*(select|with|from|values)\b", body, re.I):
        raise ValueError("only queries")
    return body


def query_graph(spark: SparkSession, d: str, statement: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of a read-only statement over the graph's views, ``max_rows`` at most.

    The statement is judged by its words and then by its analysed plan, before anything runs.
    """
    body = check_read_only(statement)
    register(spark, d)
    df = spark.sql(body)
    check_plan(df, d)
    return df.limit(max_rows)
