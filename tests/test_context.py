"""Communities, betweenness and contexts against hand-made cases and brute force."""

from __future__ import annotations

import random
import time
from collections import defaultdict, deque

import numpy as np
import pytest

from graphweft.operators import community, context
from graphweft.plans import context_queries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def brute_betweenness(pairs, sources):
    """Brandes' accumulation, one source after the other."""
    out = defaultdict(set)
    for a, b in pairs:
        if a and b and a != b:
            out[a].add(b)
    total = defaultdict(float)
    for s in sources:
        far, paths, before, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        passed = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                passed[v] += paths[v] / paths[w] * (1 + passed[w])
            if w != s:
                total[w] += passed[w]
    return {n: round(x, 9) for n, x in total.items() if x > 0}


def test_betweenness_equals_brute_force(spark):
    draw = random.Random(3)
    names = [f"n{k}" for k in range(14)]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(30)] + [(None, "n1"), ("n1", None), ("n1", "n1")]
    for sources in (names, names[:3]):
        pivots = spark.createDataFrame([(s,) for s in [*sources, None]], "node string")
        got = {r.node: round(r.betweenness, 9) for r in community.betweenness(links_of(spark, pairs), pivots).collect()}
        assert got == pytest.approx(brute_betweenness(pairs, sources))
    assert community.betweenness(links_of(spark, []), pivots).count() == 0


def test_betweenness_follows_long_paths_in_batches(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(66)]
    got = {r.node: r.betweenness for r in community.betweenness(links_of(spark, chain), spark.createDataFrame([("c0",)], "node string")).collect()}
    assert got == {f"c{k}": 66.0 - k for k in range(1, 66)}
    draw = random.Random(5)
    names = [f"n{k}" for k in range(12)]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(24)]
    pivots = spark.createDataFrame([(s,) for s in names], "node string")
    got = {r.node: round(r.betweenness, 9) for r in community.betweenness(links_of(spark, pairs), pivots, batch=5).collect()}
    assert got == pytest.approx(brute_betweenness(pairs, names))


@pytest.mark.parametrize("most", [1, 3, 20, 1 << 20])
def test_paths_from_one_or_many_pivots_equal_brute_force(most):
    draw = random.Random(7)
    pairs = sorted({(a, b) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(90)) if a != b})
    pairs += [(40 + k, 41 + k) for k in range(30)] + [(71, k) for k in range(72, 80)] + [(k, 80) for k in range(72, 80)] + [(80, 71)]
    src, to = (np.array(x) for x in zip(*pairs, strict=True))
    at, total = np.searchsorted(src, np.arange(82)), np.zeros(81)
    community._paths_from_all(np.unique(src), at, to, total, most)
    want = brute_betweenness([(f"{a}", f"{b}") for a, b in pairs], [f"{k}" for k in np.unique(src)])
    assert {f"{k}": round(total[k], 9) for k in np.flatnonzero(total)} == pytest.approx(want)


def test_work_of_a_pivot_goes_with_what_it_reaches():
    n = 3_000_000  # chains of three nodes; a pass over all nodes for each of 6 000 pivots would take minutes
    at, to, total = np.minimum(np.arange(n + 1) - np.arange(n + 1) // 3, n // 3 * 2), np.arange(n)[np.arange(n) % 3 > 0], np.zeros(n)
    began = time.thread_time()
    community._paths_from_all(np.arange(0, 18_000, 3), at, to, total)
    assert time.thread_time() - began < 5
    assert total.sum() == 6000 and (total[1:18_000:3] == 1).all()


def test_betweenness_query_takes_all_sources(spark, monkeypatch):
    pairs = [(f"s{k}", f"m{k}") for k in range(20)] + [(f"m{k}", f"t{k}") for k in range(20)]
    monkeypatch.setattr(context_queries, "_structure", lambda *_: links_of(spark, pairs))
    assert rows(context_queries.betweenness(spark, "")) == sorted((f"m{k}", 1.0) for k in range(20))


def test_communities_of_joined_cliques(spark):
    cliques = [[f"{c}{k}" for k in range(6)] for c in "abc"]
    pairs = [(x, y) for c in cliques for x in c for y in c if x < y] + [("a0", "b0"), ("b1", "c1"), ("c2", "a2"), ("a0", "a0"), (None, "a1"), ("a1", "a0")]
    found = community.communities(links_of(spark, pairs))
    assert rows(found) == sorted((n, c[0]) for c in cliques for n in c)
    judged = {r.community: r for r in community.community_quality(links_of(spark, pairs), found).collect()}
    assert {(r.n_nodes, r.links_inside, r.links_out) for r in judged.values()} == {(6, 15, 2)}
    assert sum(r.modularity for r in judged.values()) == pytest.approx(45 / 48 - 1 / 3)
    assert community.communities(links_of(spark, [])).count() == 0


def test_fingerprints_need_no_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2), ("x", 1), (None, 2), ("w", None)], "node string, community int")
    b = spark.createDataFrame([("z", 3), ("y", 4), ("x", 4)], "node string, community int")
    assert {r[1:] for r in rows(community.fingerprints(a))} == {r[1:] for r in rows(community.fingerprints(b))}
    assert len(rows(community.fingerprints(a))) == 2


def test_definitions(spark):
    functions = spark.createDataFrame([("f1", "f", 0.2), ("f2", "f", 0.5), ("f0", "f", 0.5), ("g", "g", None), ("n", None, 1.0)], "id string, name string, page_rank double")
    edges = spark.createDataFrame([(f"c{k}", "f0", "calls") for k in range(7)] + [("c1", "f1", "calls"), ("c1", "g", "reads")], "source_id string, target_id string, type string")
    assert rows(context.definitions(functions, edges)) == [("f", "f0", 3, 7, "c0 c1 c2 c3 c4"), ("g", "g", 1, 0, "")]


def test_edit_contexts(spark):
    touches = spark.createDataFrame([("s", "a", False, True), ("s", "x1", True, False), ("s", "b", True, True), ("t", "a", True, True)], "session_id string, file_path string, was_read boolean, was_edited boolean")
    links = spark.createDataFrame([(f"x{k}", "a", "calls", 1) for k in range(11)] + [("x1", "a", "imports", 2)], "from_file string, to_file string, type string, n long")
    assert rows(context.edit_contexts(touches, links)) == [("s", "a", 11, 10, True), ("s", "b", 0, 0, False), ("t", "a", 11, 11, True)]


def test_scoped_counts_and_mentions(spark):
    files = spark.createDataFrame([("p/a/x.ts",), ("p/ab/y.ts",), (None,)], "file_path string")
    docs = spark.createDataFrame(
        [(1, "constraints", "global", "x.ts x.ts, y.ts"), (2, "constraints", "p/a", None), (3, "decisions", "p/a/x.ts", "see x.ts."), (4, "decisions", None, ""), (5, "other", "p", "zz")],
        "doc_id long, source string, scope string, text string",
    )
    assert rows(context.scoped_counts(files, docs, ("constraints", "decisions"))) == [("p/a/x.ts", 2, 1), ("p/ab/y.ts", 1, 0)]
    terms = spark.createDataFrame([("x.ts",), ("x.ts",), (None,)], "term string")
    assert rows(context.mentions(docs, "doc_id", "text", r"\w+\.\w+", terms)) == [("x.ts", 2, 3)]


def test_learned_rules(spark):
    day = 86_400_000
    seen = [("r", k, f"s{k}", 100 * day) for k in range(4)] + [("r", 1, "s1", 100 * day), ("old", 9, "s1", 1 * day), ("two", 10, "a", 99 * day), ("two", 11, "b", 99 * day), (None, 12, "a", 0)]
    got = rows(context.learned_rules(spark.createDataFrame(seen, "rule string, ident long, session_id string, instant long")))
    assert got == [("old", 1, 1, 0.25, "suggested"), ("r", 4, 4, 0.85, "approved"), ("two", 2, 2, 0.5, "suggested")]


def test_json_columns(spark):
    nodes = spark.createDataFrame([("f", '{"stage":3}'), ("f", '{"stage":1,"x":2}'), ("f", '{"stage":2'), ("f", ""), ("f", None), (None, "{}")], "file_path string, metadata string")
    assert rows(context.index_depths(nodes)) == [("f", 1, 3, 3, 1)]
    seen = [(1, "s", '["a", "b"]'), (1, "s", '["a", "b"]'), (2, "t", '["a", null]'), (3, "t", '["a"'), (4, "t", None), (5, "t", "null"), (None, "t", '["a"]')]
    assert rows(context.affected_symbols(spark.createDataFrame(seen, "id long, session_id string, symbols_affected string"))) == [("a", 2, 2), ("b", 1, 1)]


def test_issue_list_and_node_metrics(spark):
    frame = spark.createDataFrame
    issues = context.issue_list(
        frame([("f", "x")], "file_path string, id string"), frame([("f", "both")], "file_path string, kind string"),
        frame([("g", "c")], "file_path string, cycle string"), frame([("g", "K", "warning")], "file_path string, name string, severity string"),
    )
    assert rows(issues) == sorted([("info", "dead_code", "f", "x"), ("warning", "coupling", "f", "both"), ("error", "circular", "g", "c"), ("warning", "god_class", "g", "K")])
    vertices = frame([("a", "function", "a", "f"), ("c", "class", "c", None)], "id string, kind string, name string, file_path string")
    edges = frame([("a", "c", "calls"), ("a", "gone", "calls")], "source_id string, target_id string, type string")
    metrics = "id string, community int, page_rank double, betweenness double"
    got = context.node_metrics(vertices, edges, frame([("a", 2, float("nan"), 0.5)], metrics), frame([("c", None, None, None)], metrics))
    assert rows(got) == [("a", "function", "a", "f", 2, 0.0, 0.5, 1), ("c", "class", "c", None, -1, 0.0, 0.0, 1)]


def test_async_calls(spark):
    functions = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "id string, is_async boolean")
    edges = spark.createDataFrame([("b", "a", "calls"), ("b", "c", "calls"), ("x", "a", "calls"), ("c", "a", "reads")], "source_id string, target_id string, type string")
    assert rows(context.async_calls(functions, edges)) == [("b", 2, 1)]


def test_betweenness_takes_no_job_a_level(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(30)]
    pivots = spark.createDataFrame([("c0",), ("c1",)], "node string")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    got = {r.node: r.betweenness for r in community.betweenness(links_of(spark, chain), pivots).collect()}
    assert len(tracker.getJobIdsForGroup()) - before < 30
    assert got == {f"c{k}": (30.0 - k) * (2 if k > 1 else 1) for k in range(1, 30)}


def test_betweenness_of_links_that_are_too_many_for_a_task(spark):
    draw = random.Random(6)
    names = [f"n{k}" for k in range(10)]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(18)]
    pivots = spark.createDataFrame([(s,) for s in names], "node string")
    got = {r.node: round(r.betweenness, 9) for r in community.betweenness(links_of(spark, pairs), pivots, most=0).collect()}
    assert got == pytest.approx(brute_betweenness(pairs, names))
