"""Core operators against hand-made cases and brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphweft.functions import names, texts
from graphweft.operators import features, graph, health, lookup, orphans, patterns, search, sessions, skew, store, traverse
from graphweft.plans import activity_queries
from graphweft.plans.sql import check_read_only, query_graph

T = datetime.fromisoformat


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_path(spark):
    written = [
        ("packages/a/b.ts", "packages/a/b.ts"), ("./packages/a/b.ts ", "packages/a/b.ts"), ("packages\\a\\b.ts", "packages/a/b.ts"),
        ("C:\\x\\packages\\a\\b.ts", "packages/a/b.ts"), ("/srv/y/packages/a/./b.ts", "packages/a/b.ts"), ("packages/a/../a//b.ts", "packages/a/b.ts"),
        ("packages/packages/b", "packages/packages/b"), ("lib/x.ts", "lib/x.ts"), ("..", None), ("", None), ("  ", None), (None, None),
    ]
    df = spark.createDataFrame(written, "p string, want string").select(names.canonical_path(F.col("p")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_current_names_and_instants(spark):
    aliases = spark.createDataFrame([("Read", "Read"), ("open_file", "Read"), (None, "X")], "alias string, tool_name string")
    df = spark.createDataFrame([(" READ ", 1_740_000_000), ("Open_File", 1_740_000_000_123), ("new", None), (None, 5)], "w string, t long")
    got = names.current_names(df, "w", aliases, "tool").select("tool", names.instant_ms(F.col("t")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("Read", 1_740_000_000_000), ("Read", 1_740_000_000_123), ("new", None), (None, 5000)], key=str)


def test_distinct_counts(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice([*range(40), None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, t string, item long").withColumn("n_items", F.lit("clash")).withColumn("__item", F.lit(1))
    got = {(r.k, r.t): (r.n_items, r.n_rows) for r in skew.distinct_counts(df, ["k", "t"], "item", salts=8).collect()}
    n = Counter((k, t) for k, t, _ in data)
    items = Counter((k, t) for k, t, i in set(data) if i is not None)
    assert got == {key: (items[key], n[key]) for key in n}
    assert rows(skew.distinct_counts(df.limit(0), ["k", "t"], "item")) == []


def test_heavy_keys(spark):
    df = spark.createDataFrame([("h",)] * 50 + [(None,)] * 30 + [(str(k),) for k in range(20)], "k string")
    heavy = skew.heavy_keys(df, ["k"])
    assert {r.k for r in df.where(skew.is_heavy(["k"], heavy)).distinct().collect()} == {"h", None}
    assert skew.heavy_keys(df.limit(0), ["k"]) == []


def brute_kind(key, at, records):
    own = [(s, u) for k, s, u in records if k == key]
    if not own:
        return "missing"
    if at is None or any((s is None or s <= at) and (u is None or u > at) for s, u in own):
        return None
    return "deleted" if any(u is not None and u <= at for _, u in own) else "later"


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_orphans(spark, monkeypatch, broadcast):
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    day = lambda: rnd.choice([None, *(T(f"2025-0{m}-{d:02d}") for m in (3, 4, 5) for d in (1, 9, 20))])
    records = [(rnd.choice(["a", "b", "c", "d", "e", "hot"]), day(), day()) for _ in range(14)] * 2 + [(None, None, None)]
    edges = [(n, rnd.choice(["a", "b", "z", "hot", None, "param:q"]), rnd.choice(["hot"] * 14 + ["c", "d", "e", "field:x"]), day()) for n in range(400)]
    edges += edges[:30]
    frame = spark.createDataFrame(edges, "edge_id long, s string, t string, at timestamp").withColumn("key", F.lit(1)).withColumn("spells", F.lit(2))
    refs = orphans.reference_ends(frame, {"source": "s", "target": "t"}, "edge_id", "at")
    known = orphans.spells(spark.createDataFrame(records, "id string, since timestamp, until timestamp"))
    want = Counter(
        (n, side, kind)
        for n, s, t, at in edges
        for side, key in (("source", s), ("target", t))
        if key and not key.startswith(("param:", "field:", "error:")) and (kind := brute_kind(key, at, records))
    )
    assert orphans.orphan_groups(refs, known)[1]
    found = orphans.orphan_references(refs, known)
    assert Counter((r.ref_id, r.side, r.kind) for r in found.collect()) == want
    month = {n: at and at.replace(day=1) for n, _, _, at in edges}
    counts = Counter()
    for (n, side, kind), k in want.items():
        counts[side, month[n], kind] += k
    got = orphans.orphan_counts(refs, known)
    assert {(r.side, r.period, r.kind): r.n_refs for r in got.collect()} == counts
    assert orphans.orphan_references(refs.limit(0), known).isEmpty()
    none = orphans.spells(spark.createDataFrame([], "id string, since timestamp, until timestamp"))
    assert {r.kind for r in orphans.orphan_references(refs, none).collect()} == {"missing"}


def test_features(spark):
    data = [("s", "A", "x", 1, 10), ("s", "A", "x", 1, 10), ("s", "A", "x", 2, 10), ("s", "B", "y", 3, 30), ("t", "A", "y", 4, None), (None, "A", "x", 5, 1), ("s", None, "x", 6, 1), ("s", "A", "x", None, 1)]
    df = spark.createDataFrame(data, "entity string, tool string, event string, ident long, at long").withColumn("n_events", F.lit("clash"))
    long = features.feature_long(df, "entity", ["tool", "event"], "ident", "at")
    assert rows(long.select("entity", "tool", "event", "n_events", "last_id")) == [("s", "A", "x", 2, 2), ("s", "B", "y", 1, 3), ("t", "A", "y", 1, 4)]
    listed = [("A", "x"), ("A", "y"), ("C", "z")]
    back = features.feature_rows(features.feature_wide(long, "entity", ["tool", "event"], listed, 100, last_ids=True), "entity", ["tool", "event"], listed)
    assert rows(back) == [("s", "A", "x", 2, 2), ("s", "B", "y", 1, 3), ("t", "A", "y", 1, 4)]
    wide = {r.entity: r.asDict() for r in features.feature_wide(long, "entity", ["tool", "event"], listed, 100).collect()}
    assert wide["s"]["A|x_n"] == 2 and wide["s"]["A|x_age"] == 90 and wide["s"]["C|z_n"] == 0 and wide["s"]["C|z_age"] is None
    assert wide["s"]["n_events"] == 3 and wide["s"]["n_types"] == 2 and wide["t"]["A|y_n"] == 1 and wide["t"]["A|y_age"] is None
    empty = features.feature_long(df.limit(0), "entity", ["tool", "event"], "ident", "at")
    assert features.feature_wide(empty, "entity", ["tool", "event"], [("A", "x")], 1).isEmpty()


def impact_edges(spark):
    """handler -> auth -> validate, other references validate, file imports and contains."""
    return spark.createDataFrame(
        [("handler", "auth", "calls"), ("auth", "validate", "calls"), ("note", "validate", "references"), ("page", "auth", "imports"), ("dir", "page", "contains")],
        "source_id string, target_id string, type string",
    )


def test_blast_radius(spark):
    seeds = spark.createDataFrame([("validate",), ("absent",)], "seed string")
    got = {(r.seed, r.node): (r.depth, round(r.confidence, 6)) for r in traverse.blast_radius(seeds, impact_edges(spark), 3).collect()}
    assert got == {
        ("validate", "validate"): (0, 1.0), ("validate", "auth"): (1, 0.9), ("validate", "note"): (1, 0.4), ("validate", "handler"): (2, 0.81),
        ("validate", "page"): (2, 0.63), ("validate", "dir"): (3, 0.189), ("absent", "absent"): (0, 1.0),
    }
    summary = traverse.impact_summary(traverse.blast_radius(seeds, impact_edges(spark), 3)).collect()
    assert [(r.seed, r.total_affected, r.critical_paths, r.risk) for r in summary] == [("validate", 5, 2, "HIGH")]


def test_cycles_and_reach(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a"), ("h", "h")], "src string, dst string")
    assert rows(traverse.components_of_cycles(links)) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e")]
    assert traverse.components_of_cycles(links.limit(0)).isEmpty()
    assert rows(traverse.reach(spark.createDataFrame([("g",)], "node string"), links, 3)) == [("a", 1), ("b", 2), ("c", 3), ("g", 0)]


def test_components_of_cycles_are_never_cut_silently(spark):
    ring = spark.createDataFrame([(f"n{k:02}", f"n{(k + 1) % 9:02}") for k in range(9)], "src string, dst string")
    with pytest.raises(RuntimeError):
        traverse.components_of_cycles(ring, rounds=14)
    assert rows(traverse.components_of_cycles(ring)) == [(f"n{k:02}", "n08") for k in range(9)]


def test_pagerank_sums_to_one(spark):
    v = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    links = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("a", "c")], "src string, dst string")
    ranks = {r.id: r.rank for r in traverse.pagerank(v, links, 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["a"] > 0


def test_dead_code(spark):
    v = spark.createDataFrame(
        [("dead", "function", "dead", "a.ts", False), ("child", "function", "child", "a.ts", False), ("main", "function", "main", "a.ts", False), ("used", "function", "used", "a.ts", None),
         ("Page", "function", "Page", "a.tsx", False), ("out", "class", "out", "a.ts", True), ("var", "variable", "v", "a.ts", False)],
        "id string, kind string, name string, file_path string, is_exported boolean",
    )
    e = spark.createDataFrame([("dead", "child", "calls"), ("main", "used", "calls"), ("f", "dead", "contains")], "source_id string, target_id string, type string")
    assert rows(health.dead_code(v, e)) == [("child", 1), ("dead", 0)]


def test_coupling_percentile(spark):
    links = spark.createDataFrame([(f"f{k}", "hub", "calls", 1) for k in range(10)] + [("f1", "f2", "imports", 2)], "from_file string, to_file string, type string, n long")
    got = health.coupling_hotspots(links).collect()
    assert [(r.file_path, r.fan_in, r.incoming, r.outgoing, r.kind) for r in got] == [("hub", 10.0, 10, 0, "fan-in")]


def test_score(spark):
    df = spark.createDataFrame([(1, 0, 10, 2)], "constraints long, circular long, dead_code long, coupling long")
    assert health.health_score(df).first().score == round(80 * 0.4 + 100 * 0.2 + 80 * 0.2 + 70 * 0.2)


def test_layers(spark):
    nodes = spark.createDataFrame(
        [("1", "UserController", "a.ts", 1), ("2", "x", "src/db/y.ts", 1), ("3", "zzz", "q.ts", 1), ("4", "lonely", "w.ts", None), ("5", "mid", "q.ts", 2)],
        "id string, name string, file_path string, community int",
    )
    degrees = spark.createDataFrame([("5", 1, 1), ("3", 0, 0)], "id string, n_out long, n_in long")
    got = {r.id: (r.layer, r.confidence) for r in patterns.layers(nodes, degrees).collect()}
    assert got["1"] == ("controller", 1.0) and got["2"] == ("database", 1.0) and got["3"] == ("controller", 0.4) and got["4"][0] == "unknown" and got["5"] == ("service", 0.5)


def test_scopes_take_the_tightest(spark):
    v = spark.createDataFrame(
        [("f", "function", "f", "a", 1, 50), ("g", "function", "g", "a", 5, 9), ("v", "variable", "v", "a", 6, 6), ("w", "variable", "w", "b", 6, 6)],
        "id string, kind string, name string, file_path string, line_start int, line_end int",
    )
    assert sorted(map(tuple, graph.enclosing_scopes(v).collect()), key=str) == [("v", "g", 4), ("w", None, None)]


def test_attention_forgets(spark):
    data = [(k, "s", k, "t", "file:read", f"f{k % 60}" if k < 60 else "f59") for k in range(1, 111)] + [(200, "s", 200, "t", "file:edit", "f59")]
    df = spark.createDataFrame(data, "id long, session_id string, instant long, tool_name string, event string, file_path string")
    got = {r.file_path: (r.accesses, r.edited) for r in sessions.attention(df.union(df)).collect()}
    assert got == {"f59": (53, True)}


def test_session_gap(spark):
    ts = [T("2025-03-01T10:00:00"), T("2025-03-01T10:30:00"), T("2025-03-01T11:00:01")]
    df = spark.createDataFrame([(1, t) for t in ts], "u long, ts timestamp")
    assert sorted(r.n_events for r in sessions.sessions_by_gap(df, "u", "ts").collect()) == [1, 2]


def test_fusion_and_cosine(spark):
    left = spark.createDataFrame([("q", d, k + 1) for k, d in enumerate("abc")], "query string, doc string, rank int")
    right = spark.createDataFrame([("q", d, k + 1) for k, d in enumerate("cad")], "query string, doc string, rank int")
    assert [r.doc for r in search.fuse(left, right).orderBy("rank").collect()] == ["a", "c", "b", "d"]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [-1.0, 0.0])], "vec_id long, v array<double>")
    got = search.cosine_top(vectors.where("vec_id = 1"), vectors, "vec_id", "v", 5, most=1).orderBy("rank")
    assert [(r.id, r.score) for r in got.collect()] == [(2, 0.707107), (6, -1.0)]


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v long, c string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "w"), ("c", 1, "n")], "k string, v long, c string")
    assert rows(store.upsert(old, new, ["k"], "v")) == [("a", 1, "z"), ("b", 5, "y"), ("c", 1, "n")]
    assert rows(store.insert_absent(old, new, ["k"])) == [("a", 1, "x"), ("b", 5, "y"), ("c", 1, "n")]


def test_texts(spark):
    df = spark.createDataFrame([("Never use var",), ("We decided on X",), ("prefer tabs",), ("use tabs",), ("use tabs in js",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.category(F.col("t"))).collect()] == ["anti-patterns", "decisions", "preferences", "preferences", "style", None]
    one = spark.createDataFrame([("  Hello, World -- again! ",)], "t string").select(texts.slug(F.col("t")), texts.content_hash(F.lit("abc"))).first()
    assert one[0] == "hello-world-again" and one[1] == "ba7816bf8f01cfea414140de5dae2223"


@pytest.mark.parametrize("bad", ["drop table x", "select 1; select 2", "select replace('a','b','c')", "select * from parquet.`/etc/x`", "show tables"])
def test_gate_refuses(bad):
    with pytest.raises(ValueError):
        check_read_only(bad)


@pytest.fixture(scope="module")
def graph_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graph"))
    node = "id string, type string, name string, file_path string, line_start int, line_end int, is_exported boolean, metadata string, indexed_at timestamp, deleted_at timestamp"
    chain = [(k, "function", k, "packages/a.ts", 1, 2, False, None, None, None) for k in ("foo", "bar", "baz")]
    spark.createDataFrame(chain, node).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([], "id string, name string, file_path string, line_start int, line_end int, is_abstract boolean, is_exported boolean, community int, page_rank double, betweenness double").write.parquet(f"{d}/nodes_class.parquet")
    edge = "edge_id long, source_id string, target_id string, type string, indexed_at timestamp, loaded_at timestamp"
    spark.createDataFrame([(1, "foo", "bar", "calls", None, None), (2, "bar", "baz", " Calls", None, None)], edge).write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([], "id string, name string, file_path string, line_start int, line_end int, is_async boolean, is_exported boolean, community int, page_rank double, betweenness double, indexed_at timestamp").write.parquet(f"{d}/nodes_function.parquet")
    spark.createDataFrame([], "id long").write.parquet(f"{d}/session_observations.parquet")
    spark.createDataFrame([], "id long").write.parquet(f"{d}/change_records.parquet")
    return d


@pytest.mark.parametrize("call", [
    "select java_method('java.lang.System', 'getProperty', 'user.dir')",
    "select reflect('java.util.UUID', 'randomUUID')",
    "select try_reflect('java.util.UUID', 'randomUUID')",
    "select 1 where exists (select java_method('java.util.UUID', 'randomUUID'))",
    "with x as (select java_method('java.util.UUID', 'randomUUID') as u) select * from x",
    "select (select reflect('java.lang.String', 'valueOf', 1) from code_vertex limit 1)",
    "select * from (select transform(id) using 'cat' as (a) from code_vertex)",
])
def test_plan_gate_refuses(spark, graph_tables, call):
    with pytest.raises(ValueError):
        query_graph(spark, graph_tables, call)


def test_plan_gate_passes(spark, graph_tables):
    spark.range(3).createOrReplaceTempView("edge")
    hop = "select b.target_id from code_edge a join code_edge b on b.source_id = a.target_id where a.source_id = 'foo'"
    assert query_graph(spark, graph_tables, hop).collect() == [("baz",)]
    reach = "with recursive r(id, n) as (select 'foo', 0 union all select e.target_id, r.n + 1 from r join code_edge e on e.source_id = r.id where r.n < 5) select id from r where id in (select id from code_vertex)"
    assert {r.id for r in query_graph(spark, graph_tables, reach).collect()} == {"foo", "bar", "baz"}
    assert query_graph(spark, graph_tables, "select id from code_vertex order by id", 1).collect() == [("bar",)]
    assert query_graph(spark, graph_tables, "values (1), (2)").count() == 2
    assert spark.table("edge").count() == 3


def test_gate_passes():
    assert check_read_only(" select 1 ; ") == "select 1"


def test_streams(spark, tmp_path):
    from graphweft.streaming import observations as streams

    data = [(1, "s", 1_740_000_000_000, "T", "file:read", "packages/a", None, None, None), (2, "s", 1_740_000_001_000, "T", " File:Read", "./packages/a", None, None, None), (2, "s", 1_740_000_001_000, "T", "file:read", "packages/a", None, None, None)]
    schema = "id long, session_id string, timestamp long, tool_name string, event string, file_path string, symbols_affected string, metadata string, received_at timestamp"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/log.parquet")
    hourly = streams.run_updates(streams.hourly_counts(streams.observation_stream(spark, f"{tmp_path}/log.parquet")), ["hour", "event"])
    assert [(r.event, r.n) for r in hourly.collect()] == [("file:read", 2)]


def test_flow_steps_give_reads_and_writes_but_do_not_follow_them(spark):
    told = [("h", "f", "calls"), ("f", "g", "flows_to"), ("g", "h", "calls"), ("f", "v", "reads"), ("g", "w", "writes"), ("f", "e", "returns"), ("v", "x", "calls"), ("g", "z", "contains")]
    steps = traverse.flow_steps(spark.createDataFrame([("h",)], "node string"), spark.createDataFrame(told, "source_id string, target_id string, type string"), 2)
    assert rows(steps) == [("f", "e", "returns", 2), ("f", "g", "flows_to", 2), ("f", "v", "reads", 2), ("h", "f", "calls", 1)]


def test_bm25_documents_finds_words_of_any_script(spark, tmp_path):
    told = [(0, "Кэш очищен"), (1, "кэш полон"), (2, "पूर्ण कैश"), (3, "naïve cache"), (100, "naïve"), (200, "कैश"), (300, None)]
    spark.createDataFrame(told, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = activity_queries.bm25_documents(spark, str(tmp_path))
    assert [r[:2] for r in rows(found.select("query", "doc"))] == [(0, 0), (0, 1), (100, 3), (100, 100), (200, 2), (200, 200)]


def test_implementors_of_a_deep_hierarchy(spark):
    told = spark.createDataFrame([(f"n{k + 1}", f"n{k}", "implements") for k in range(14)], "source_id string, target_id string, type string")
    assert traverse.implementors(told).where("target_id = 'n0'").count() == 14


def test_resolution_goes_by_priority(spark):
    told = [("x", "function", "loadCache", "p/a.ts"), ("file:p/a.ts", "file", "a.ts", "p/a.ts"), ("y", "function", "cacheOf", "p/b.ts"), ("z", "function", None, None), ("p/c.ts", "file", "c", "p/c.ts")]
    v = spark.createDataFrame(told, "id string, kind string, name string, file_path string")
    asked = spark.createDataFrame([(a,) for a in ("x", "p/a.ts", "p/b.ts", "CACHE", "ca", "e", "nothing", "", None, "p/c.ts")], "asked string")
    got = lookup.resolved(asked, v)
    assert rows(got) == sorted([
        ("x", "x", "id"), ("p/a.ts", "file:p/a.ts", "file"), ("p/b.ts", "y", "path"), ("CACHE", "x", "name"), ("CACHE", "y", "name"), ("ca", "x", "name"), ("ca", "y", "name"),
        ("e", "x", "name"), ("e", "y", "name"), ("nothing", "nothing", "none"), ("", "", "none"), ("p/c.ts", "p/c.ts", "id"),
    ])
    edges = spark.createDataFrame([("x", "y", "calls"), ("x", "y", "reads"), ("z", "x", "calls"), ("x", "gone", "calls")], "source_id string, target_id string, type string")
    near = lookup.neighbours(got.where("asked = 'x'"), edges, v)
    assert rows(near.select("direction", "id")) == [("dependency", "y"), ("dependent", "z")]
    assert lookup.resolved(asked.limit(0), v).isEmpty()


def test_flows_of_many_entries(spark):
    rnd = random.Random(12)
    links = {(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(170)}
    edges = spark.createDataFrame([(a, b, "calls") for a, b in links] + [("n3", "error:x", "returns"), ("n4", "n5", "reads")], "source_id string, target_id string, type string")
    fns = spark.createDataFrame([(f"n{k}", k % 40 == 0) for k in range(150)], "id string, is_async boolean")
    entries = spark.createDataFrame([(f"n{k}",) for k in range(150)] + [("alone",), (None,)], "node string")
    want = set()
    for e in [f"n{k}" for k in range(150)] + ["alone"]:
        seen, front, d = {e: 0}, [e], 0
        while front and d < 4:
            d += 1
            front = [b for b in {b for a, b in links if a in front} if b not in seen]
            seen |= {b: d for b in front}
        want.add((e, len(seen), max(seen.values()), any(k[1:].isdigit() and int(k[1:]) % 40 == 0 for k in seen), "n3" in seen))
    assert {tuple(r) for r in traverse.execution_flows(entries, edges, fns, 4).collect()} == want


def test_topological_levels(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("p", "q"), ("q", "p"), ("q", "r"), (None, "a")], "src string, dst string")
    got = {r.node: r.level for r in traverse.topological_levels(links.dropna()).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "p": None, "q": None, "r": None}


def test_salted_join(spark):
    left = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(300)] + [(None, 1)], "key string, n long")
    right = spark.createDataFrame([("hot", "h"), ("k3", "x"), (None, "y")], "key string, v string")
    heavy = skew.heavy_keys(left, ["key"])
    assert heavy and rows(skew.salted_join(left, right, "key", ["n"], heavy)) == rows(left.join(right, "key"))
