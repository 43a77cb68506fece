"""Communities of a graph: finding them, judging them, telling two of their states apart; and betweenness from pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, written

#: Rows up to which a side of a join is broadcast in the search for shortest paths.
NARROW = 50_000
#: Links that every task may hold at most in the search for shortest paths (4 bytes each, and some 60 a node).
MOST_LINKS = 1 << 23
#: Links that a task follows at once at most, of all pivots that it searches from together (some 100 bytes each).
MOST_AT_ONCE = 1 << 20


def simple_projection(links: DataFrame) -> DataFrame:
    """``links (src, dst)`` as an undirected simple graph ``(src, dst, w)``: both directions of every pair once, no loops."""
    pairs = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ways = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(ways.alias("way")).select("way.src", "way.dst", F.lit(1.0).alias("w"))


def _quality(graph: DataFrame) -> float:
    """Modularity of a graph whose nodes are the communities; a loop weighs twice what lies inside."""
    own = graph.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = own.agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return r.inside / r.m2 - r.squares / (r.m2 * r.m2) if r.m2 else 0.0


def _local_moves(graph: DataFrame, m2: float, sweeps: int, settled: float) -> DataFrame:
    """``(node, c)`` after sweeps in which nodes move to the neighbouring community of greatest gain.

    Half of the nodes, by a hash that changes with the sweep, may move at a time, and of two
    lone nodes only the one of greater name joins the other, so that they do not swap places.
    Two sweeps in which a share of at most ``settled`` moved are the last.
    """
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = written(degree.select("node", "k", F.col("node").alias("c")))
    outer = graph.where("src <> dst")
    still, nodes = 0, state.count()
    for sweep in range(sweeps):
        totals = state.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
        mine = state.join(totals, "c").select(F.col("node").alias("src"), "k", F.col("c").alias("own"), F.col("total").alias("own_total"), F.col("n").alias("own_n"))
        toward = outer.join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("w").alias("wc"))
        options = toward.join(totals, "c").join(mine, "src")
        gain = F.col("wc") - F.col("k") * F.col("total") / m2
        other = F.when(F.col("c") != F.col("own"), F.struct((-gain).alias("loss"), F.col("c").alias("c"), F.col("n").alias("n")))
        best = options.groupBy("src", "k", "own", "own_total", "own_n").agg(F.min(other).alias("best"), F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("wc"))), F.lit(0.0)).alias("w_own"))
        stay = F.col("w_own") - F.col("k") * (F.col("own_total") - F.col("k")) / m2
        turn = F.pmod(F.xxhash64("src", F.lit(sweep)), F.lit(2)) == 0
        swap = (F.col("own_n") == 1) & (F.col("best.n") == 1) & (F.col("best.c") > F.col("own"))
        moves = best.where(turn & ~swap & (-F.col("best.loss") > stay + 1e-9)).select(F.col("src").alias("node"), F.col("best.c").alias("to"))
        state = written(state.join(moves, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
        still = still + 1 if state.where("moved").count() <= settled * nodes else 0
        state = state.select("node", "k", "c")
        if still == 2:  # neither half moves on
            break
    return state.select("node", "c")


def communities(links: DataFrame, *, levels: int = 5, sweeps: int = 8, settled: float = 0.02, least_gain: float = 1e-3) -> DataFrame:
    """``(node, community)`` by local moving and merging (Louvain) on the undirected simple graph of ``links (src, dst)``.

    At each level nodes move between communities, then communities become the nodes of the next
    level. A level that gains less than ``least_gain`` modularity is not kept and ends the work. All of it
    is joins and sums over links; no component or community is held in one task. A community
    goes by its least node. Nulls and loops are ignored; a node without links does not come
    out; an empty table gives no rows. The same links give the same result.
    """
    graph = written(simple_projection(links.dropna(subset=["src", "dst"])))
    found = graph.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    m2 = graph.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    quality = _quality(graph) if m2 else 0.0
    for _ in range(levels if m2 else 0):
        moved = _local_moves(graph, m2, sweeps, settled)
        a, b = moved.select(F.col("node").alias("src"), F.col("c").alias("ca")), moved.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        merged = written(graph.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")))
        now = _quality(merged)
        if now < quality + least_gain:
            break
        found = written(found.join(moved.withColumnRenamed("node", "community"), "community").select("node", F.col("c").alias("community")))
        graph, quality = merged, now
    names = found.groupBy("community").agg(F.min("node").alias("least"))
    return found.join(names, "community").select("node", F.col("least").alias("community"))


def community_quality(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per community of ``members (node, community)``: size, links inside and leaving, and its share of the modularity.

    The graph is the undirected simple one of the ``links`` between members. The shares sum to
    the modularity. Members without links count in ``n_nodes`` alone; those without community not at all.
    """
    of = members.dropna().dropDuplicates(["node"])
    graph = simple_projection(links).join(of.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src")
    graph = graph.join(of.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    inner = F.col("ca") == F.col("cb")
    sums = graph.groupBy(F.col("ca").alias("community")).agg(F.sum(inner.cast("long")).alias("twice"), F.sum((~inner).cast("long")).alias("links_out"))
    m2 = sums.agg(F.sum(F.col("twice") + F.col("links_out")).cast("double").alias("m2"))
    sizes = of.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    twice, out = F.coalesce("twice", F.lit(0)), F.coalesce("links_out", F.lit(0))
    degree = (twice + out) / F.col("m2")
    return sizes.join(sums, "community", "left").join(F.broadcast(m2)).select(  # m2 is one row
        "community", "n_nodes", (twice / 2).cast("long").alias("links_inside"), out.alias("links_out"),
        F.round(F.coalesce(twice / F.col("m2") - degree * degree, F.lit(0.0)), 9).alias("modularity"),
    )


def fingerprints(members: DataFrame) -> DataFrame:
    """Per community of ``members (node, community)``: its size and a sum of its nodes' hashes.

    Two states of a community have the same members if they have the same fingerprint (but for
    collisions of hashes). A sum needs no order, so it is combined before the shuffle and the
    largest community passes through no single value or task.
    """
    digit = F.conv(F.substring(F.md5(F.col("node").cast("binary")), 1, 8), 16, 10).cast("long")
    return members.dropna().distinct().groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(digit).alias("fingerprint"))


def _narrow(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows, broadcast if these are few, so that the other side of a join need not be shuffled."""
    return F.broadcast(df) if n <= NARROW else df


def _passed(step: DataFrame, pivots: DataFrame, folder: str) -> DataFrame:
    """``(node, passed)`` per pivot of ``pivots (node)`` and node passed, for distinct links ``step (src, dst)``.

    The tables of all levels lie in one folder and are read as one, so that no plan grows with the levels.
    """
    spark = step.sparkSession
    front = written(pivots.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("paths")), folder, "reached/level=0")
    levels = [(front, front.count())]
    while levels[-1][1]:
        front, n = levels[-1]
        on = _narrow(front.withColumnRenamed("node", "src"), n).join(step, "src").groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        on = written(on, folder)
        n = on.count()
        seen = spark.read.schema(front.schema).parquet(f"{folder}/reached").select("pivot", "node")
        known = seen.join(_narrow(on.select("pivot", "node"), n), ["pivot", "node"], "left_semi")
        front = written(on.join(_narrow(known, n), ["pivot", "node"], "left_anti"), folder, f"reached/level={len(levels)}")
        levels.append((front, front.count()))
    front, n_below = levels.pop()
    below = written(front.withColumn("passed", F.lit(0.0)), folder, "passed/level=0")
    for k in range(len(levels) - 1, 0, -1):  # the pivots themselves are not passed
        level, n = levels[k]
        down = below.select("pivot", F.col("node").alias("dst"), ((F.col("passed") + 1) / F.col("paths")).alias("each"))
        hand = _narrow(level.select("pivot", F.col("node").alias("src"), "paths"), n).join(step, "src").join(_narrow(down, n_below), ["pivot", "dst"])
        got = hand.groupBy("pivot", F.col("src").alias("node")).agg(F.sum(F.col("paths") * F.col("each")).alias("passed"))
        below = level.join(_narrow(got, n), ["pivot", "node"], "left").select("pivot", "node", "paths", F.coalesce("passed", F.lit(0.0)).alias("passed"))
        below, n_below = written(below, folder, f"passed/level={k}"), n
    return spark.read.schema(below.schema).parquet(f"{folder}/passed").where("passed > 0").select("node", "passed")


def _spread(front: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all links from ``front``: the place in ``front`` of the one end, and the other end."""
    sizes = at[front + 1] - at[front]
    place = np.repeat(np.arange(len(front)), sizes)
    return place, to[np.arange(len(place)) + (at[front] - np.cumsum(sizes) + sizes)[place]]


def _paths_from_many(pivots: np.ndarray, at: np.ndarray, to: np.ndarray, total: np.ndarray, most: int) -> int:
    """Add to ``total`` how many shortest paths from ``pivots`` pass each node, and give the number of links followed.

    Links of node ``k`` are ``to[at[k]:at[k + 1]]``. All pivots go level by level together; state is
    a number per pivot and node reached, so that work goes with what pivots reach and not with the size
    of the graph. If they follow more than ``most`` links, nothing is added and the result is -1.
    """
    n, followed, levels = len(at) - 1, 0, []
    own, front, paths = np.arange(len(pivots)), pivots, np.ones(len(pivots))
    seen, n_going = own * n + front, len(pivots)
    while len(front):
        followed += int((at[front + 1] - at[front]).sum())
        if followed > most:
            return -1
        place, dst = _spread(front, at, to)
        keys = own[place] * n + dst
        new = seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] != keys
        place = place[new]
        found, which = np.unique(keys[new], return_inverse=True)
        levels.append((front, paths, place, which))
        paths = np.bincount(which, paths[place], len(found))
        own, front = np.divmod(found, n)
        going = np.unique(own)
        if len(going) <= n_going // 2:  # what the others have seen is not asked any more
            n_going, still = len(going), np.zeros(len(pivots), bool)
            still[going] = True
            seen = seen[still[seen // n]]
        seen = np.concatenate([seen, found])
        seen.sort(kind="stable")  # merges two runs
    passed = np.zeros(0)
    for front, before, place, which in levels[:0:-1]:  # the pivots themselves are not passed
        passed = np.bincount(place, before[place] * ((1 + passed) / paths)[which], len(front))
        np.add.at(total, front, passed)
        paths = before
    return followed


def _paths_from(pivot: int, at: np.ndarray, to: np.ndarray, total: np.ndarray, most: int) -> None:
    """Like ``_paths_from_many`` for one pivot that reaches much: a number per node of the graph, links in pieces of about ``most``."""
    n, front, fronts = len(at) - 1, np.array([pivot]), []
    dist, paths, mark, passed = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    dist[pivot], paths[pivot] = 0, 1.0

    def pieces(front: np.ndarray) -> Iterator[np.ndarray]:
        ends = np.cumsum(at[front + 1] - at[front])
        yield from np.split(front, np.searchsorted(ends, np.arange(most, ends[-1], most)))

    while len(front):
        fronts.append(front)
        fresh = []
        for some in pieces(front):
            place, dst = _spread(some, at, to)
            on = (dist[dst] < 0) | (dist[dst] == len(fronts))
            np.add.at(paths, dst[on], paths[some[place[on]]])
            dst = dst[dist[dst] < 0]
            dist[dst] = len(fronts)
            mark[dst] = np.arange(len(dst))
            fresh.append(dst[mark[dst] == np.arange(len(dst))])  # each once
        front = np.concatenate(fresh)
    for level in range(len(fronts) - 1, 0, -1):
        for some in pieces(fronts[level]):
            place, dst = _spread(some, at, to)
            on = dist[dst] == level + 1
            src, dst = some[place[on]], dst[on]
            np.add.at(passed, src, paths[src] / paths[dst] * (1 + passed[dst]))
    total += passed


def _paths_from_all(pivots: np.ndarray, at: np.ndarray, to: np.ndarray, total: np.ndarray, most: int = MOST_AT_ONCE) -> None:
    """``_paths_from_many`` for as many pivots at once as follow about half of ``most`` links, ``_paths_from`` for one that follows more than ``most``."""
    done, size = 0, 256
    while done < len(pivots):
        some = pivots[done : done + size]
        followed = _paths_from_many(some, at, to, total, most)
        if followed < 0 and len(some) > 1:
            size = len(some) // 4 or 1
            continue
        if followed < 0:
            _paths_from(int(some[0]), at, to, total, most)
        done += len(some)
        size = max(1, min(4 * size, len(some) * most // (2 * max(followed, 1)))) if followed >= 0 else 1


def _passed_in_tasks(step: DataFrame, starts: DataFrame) -> DataFrame:
    """``(node, passed)``, maybe several of a node: like ``_passed``, with all links in every task, which takes its share of the pivots."""
    spark = step.sparkSession
    links = step.toArrow()
    nodes = np.unique(np.concatenate([np.unique(links[c].to_numpy()) for c in ("src", "dst")]))
    src, dst = (np.searchsorted(nodes, links[c].to_numpy()).astype(np.int32) for c in ("src", "dst"))
    del links
    at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(nodes)))])
    held = spark.sparkContext.broadcast((nodes, at, dst[np.argsort(src, kind="stable")]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, at, to = held.value
        total = np.zeros(len(nodes))
        for batch in batches:
            _paths_from_all(np.searchsorted(nodes, batch["node"].to_numpy()), at, to, total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(total[some])], names=["node", "passed"])

    return starts.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(summed, "node long, passed double")


def betweenness(links: DataFrame, pivots: DataFrame, batch: int = 1 << 18, most: int = MOST_LINKS) -> DataFrame:
    """``(node, betweenness)``: how many shortest paths from ``pivots (node)`` over ``links (src, dst)`` pass each node.

    With all nodes as pivots this is the exact betweenness (not normalised); fewer are the usual
    sample of it. Each is a breadth-first search that counts shortest paths level by level until
    nothing new is reached; then the levels hand their dependencies back, and pivots are summed
    per node. Up to ``most`` different links go to every task, which searches from its share of
    the pivots. More links are joined level by level, for pivots in batches, by a hash, of about
    ``batch``; state is one row per pivot of the batch and node reached, and is deleted with its batch.
    Nodes go by numbers meanwhile. Nodes that no path passes do not come out.
    """
    named = links.dropna(subset=["src", "dst"]).where("src <> dst").select("src", "dst").distinct()
    with scratch(links.sparkSession) as folder:
        ids = written(named.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("k", F.monotonically_increasing_id()), folder)
        step = named.join(ids.select(F.col("node").alias("src"), F.col("k").alias("a")), "src").join(ids.select(F.col("node").alias("dst"), F.col("k").alias("b")), "dst")
        step = written(step.select(F.col("a").alias("src"), F.col("b").alias("dst")), folder)
        starts = pivots.select("node").distinct().join(ids, "node").select(F.col("k").alias("node"))
        starts = written(starts.join(step.select(F.col("src").alias("node")), "node", "left_semi"), folder)
        if step.count() <= most:
            part = written(_passed_in_tasks(step, starts).groupBy("node").agg(F.sum("passed").alias("passed")), folder, "sums/batch=0")
        else:
            n_batches = max(1, -(-starts.count() // batch))
            for k in range(n_batches):
                with scratch(links.sparkSession) as own:
                    passed = _passed(step, starts.where(F.pmod(F.xxhash64("node"), F.lit(n_batches)) == k), own)
                    part = written(passed.groupBy("node").agg(F.sum("passed").alias("passed")), folder, f"sums/batch={k}")
        every = links.sparkSession.read.schema(part.schema).parquet(f"{folder}/sums")
        whole = every.groupBy(F.col("node").alias("k")).agg(F.sum("passed").alias("betweenness"))
        return written(whole.join(ids, "k").select("node", "betweenness"))
