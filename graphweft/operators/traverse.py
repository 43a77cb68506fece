"""Bounded and closed traversals of the graph, one join a round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Confidence that a change passes an edge backwards.
CONFIDENCE = {"calls": 0.9, "imports": 0.7, "imports_symbol": 0.7, "references": 0.4, "contains": 0.3}
OTHER_CONFIDENCE = 0.5


def blast_radius(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """``(seed, node, depth, confidence, via)``: what a change of each seed may affect.

    Edges are followed backwards; confidences multiply, a node is entered again at a greater
    depth only with strictly more confidence than before, and at one depth counts with its
    best (of equal ones the greatest ``via``). Depth 0 is the seed itself.
    """
    weight = F.lit(OTHER_CONFIDENCE)
    for t, w in CONFIDENCE.items():
        weight = F.when(F.col("type") == t, w).otherwise(weight)
    back = checkpointed(edges.select("source_id", F.col("target_id").alias("node"), weight.alias("w")).groupBy("source_id", "node").agg(F.max("w").alias("w")))
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("via")).distinct()
    found = checkpointed(front)
    front = found
    for k in range(1, depth + 1):
        reached = front.join(back, "node").groupBy("seed", F.col("source_id").alias("node")).agg(
            F.max(F.struct((F.col("confidence") * F.col("w")).alias("confidence"), F.col("node").alias("via"))).alias("best")
        )
        before = found.groupBy("seed", "node").agg(F.max("confidence").alias("had"))
        better = reached.join(before, ["seed", "node"], "left").where(F.col("had").isNull() | (F.col("best.confidence") > F.col("had")))
        front = checkpointed(better.select("seed", "node", F.lit(k).alias("depth"), "best.confidence", "best.via"))
        found = found.unionByName(front)
    return found


def impact_summary(radius: DataFrame) -> DataFrame:
    """Per seed: entries affected, critical ones (above 0.7), and the risk of the greatest confidence."""
    affected = radius.where("depth > 0")
    most = F.max("confidence")
    risk = F.when(most > 0.7, "HIGH").when(most > 0.4, "MEDIUM").otherwise("LOW")
    return affected.groupBy("seed").agg(F.count(F.lit(1)).alias("total_affected"), F.count_if(F.col("confidence") > 0.7).alias("critical_paths"), risk.alias("risk"))


def reach(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)``: least number of ``links (src, dst)`` from any of ``seeds (node)``, up to ``depth``."""
    hops = checkpointed(links.select(F.col("src").alias("node"), "dst").distinct())
    found = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = found
    for k in range(1, depth + 1):
        front = front.join(hops, "node").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        front = checkpointed(front)
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def flow_steps(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``(source, target, type, depth)``: every step of the flows from ``seeds (node)``.

    Calls and ``flows_to`` are followed; each node less than ``depth`` links away gives a step,
    one deeper than itself, for each of these edges and for each of what it reads, writes and
    returns (the ``returns`` steps are those of errors, to be filtered by type if not asked for).
    """
    onward = edges.where("type in ('calls', 'flows_to')").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    visited = reach(seeds, onward, depth - 1).select(F.col("node").alias("source_id"), "depth")
    steps = edges.where("type in ('calls', 'flows_to', 'reads', 'writes', 'returns')").join(visited, "source_id")
    return steps.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", (F.col("depth") + 1).alias("depth"))


def data_steps(seeds: DataFrame, edges: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """``(source, target, type, depth)``: every step of the data that flows from, or else to, ``seeds (node)``.

    ``flows_to`` is followed with or against its direction; each node less than ``depth`` links
    away also gives a step, one deeper than itself, for what it reads (forward) or for what
    writes it (backward).
    """
    here, there, extra = ("source_id", "target_id", "reads") if forward else ("target_id", "source_id", "writes")
    links = edges.where("type = 'flows_to'").select(F.col(here).alias("src"), F.col(there).alias("dst"))
    visited = reach(seeds, links, depth - 1).select(F.col("node").alias(here), "depth")
    steps = edges.where(F.col("type").isin("flows_to", extra)).join(visited, here)
    return steps.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", (F.col("depth") + 1).alias("depth"))


#: Entries that one number tells apart, a bit for each.
_BITS = 63


def execution_flows(entries: DataFrame, edges: DataFrame, functions: DataFrame, depth: int, types: Sequence[str] = ("calls", "flows_to")) -> DataFrame:
    """``(entry, n_nodes, depth, has_async, has_error_path)``: the flow of each of ``entries (node)``.

    A flow has the nodes that at most ``depth`` edges of ``types`` lead to, the entry included;
    ``depth`` is that of its farthest node. It is asynchronous if a node of it is, and has an
    error path if an edge leads from a node of it to an ``error:`` id.

    All entries are followed at once: each 63 of them share a number per node, a bit for each
    entry that reaches it, so the state has a row per node and 63 entries, and a round is a
    join and a bitwise aggregation that takes only bits that are new.
    """
    known = entries.where("node is not null").select("node").distinct()
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    numbered = known.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(1024))).withColumn("k", place)
    numbered = checkpointed(numbered.select("node", F.concat_ws(":", "part", F.floor(F.col("k") / _BITS)).alias("block"), (F.col("k") % _BITS).cast("int").alias("bit")))
    hops = checkpointed(edges.where(F.col("type").isin(*types)).select(F.col("source_id").alias("node"), "target_id").distinct())
    front = checkpointed(numbered.select("node", "block", F.expr("shiftleft(1L, bit)").alias("mask")))
    found, rounds = front, front.select("block", "mask", F.lit(0).alias("round"))
    for k in range(1, depth + 1):
        came = front.join(hops, "node").groupBy(F.col("target_id").alias("node"), "block").agg(F.bit_or("mask").alias("came"))
        had = found.groupBy("node", "block").agg(F.bit_or("mask").alias("had"))
        new = came.join(had, ["node", "block"], "left").select("node", "block", F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("mask"))
        front = checkpointed(new.where("mask <> 0"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        rounds = rounds.unionByName(front.select("block", "mask", F.lit(k).alias("round")))
    waits = functions.where("is_async").select(F.col("id").alias("node")).distinct().withColumn("waits", F.lit(True))
    fails = edges.where("target_id like 'error:%'").select(F.col("source_id").alias("node")).distinct().withColumn("fails", F.lit(True))
    whole = found.groupBy("node", "block").agg(F.bit_or("mask").alias("mask")).join(waits, "node", "left").join(fails, "node", "left")
    bit = lambda c, k: F.expr(f"{c} >> {k} & 1L")
    counts = whole.groupBy("block").agg(
        F.array(*(F.sum(bit("mask", k)) for k in range(_BITS))).alias("n"),
        F.coalesce(F.bit_or(F.when(F.col("waits"), F.col("mask"))), F.lit(0).cast("long")).alias("waits"),
        F.coalesce(F.bit_or(F.when(F.col("fails"), F.col("mask"))), F.lit(0).cast("long")).alias("fails"),
    )
    far = rounds.groupBy("block", "round").agg(F.bit_or("mask").alias("mask")).groupBy("block").agg(
        F.array(*(F.max(F.when(bit("mask", k) == 1, F.col("round"))) for k in range(_BITS))).alias("far")
    )
    flows = numbered.join(counts, "block").join(far, "block")
    own = lambda c: F.expr(f"shiftright({c}, bit) & 1L") == 1
    return flows.select(
        F.col("node").alias("entry"), F.col("n")[F.col("bit")].alias("n_nodes"), F.col("far")[F.col("bit")].alias("depth"), own("waits").alias("has_async"), own("fails").alias("has_error_path")
    )


def topological_levels(links: DataFrame) -> DataFrame:
    """``(node, level)``: how many rounds of taking off nodes without a link in come before each node's own.

    Self-loops do not count. Nodes on cycles, and behind them, are never taken off; their level
    is null. One join a round over the links left, until nothing more is taken off.
    """
    left = checkpointed(links.select("src", "dst").where("src <> dst").distinct())
    nodes = checkpointed(links.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct())
    found, rest, k = nodes.limit(0).withColumn("level", F.lit(0)), nodes, 0
    while True:
        free = checkpointed(rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            break
        found = found.unionByName(free.withColumn("level", F.lit(k)))
        rest = checkpointed(rest.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        k += 1
    return found.unionByName(rest.withColumn("level", F.lit(None).cast("int")))


def implementors(edges: DataFrame) -> DataFrame:
    """``(target_id, implementor, indirect)``: direct implementors of anything and, one by one, theirs."""
    direct = checkpointed(edges.where("type = 'implements' and source_id <> target_id").select("target_id", F.col("source_id").alias("implementor")).distinct())
    found, front = direct.withColumn("indirect", F.lit(False)), direct
    step = direct.select(F.col("target_id").alias("implementor"), F.col("implementor").alias("next"))
    while True:
        more = front.join(step, "implementor").select("target_id", F.col("next").alias("implementor")).distinct().where("target_id <> implementor")
        front = checkpointed(more.join(found.select("target_id", "implementor"), ["target_id", "implementor"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front.withColumn("indirect", F.lit(True)))
    return found


def pagerank(vertices: DataFrame, links: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 2) -> DataFrame:
    """``(id, rank)`` after ``rounds`` rounds on ``links (src, dst)``, parallel links counted each.

    Links carry their share of the source's rank, so a round is one join by source and one
    aggregation by target (combined before the shuffle, which a hub needs); the rank of
    vertices without links out is spread over all.
    """
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    shares = checkpointed(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    base = checkpointed(vertices.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(True).alias("leads")), "id", "left"))
    n = base.count()
    ranks = base.select("id", "leads", F.lit(1.0 / max(1, n)).alias("rank"))
    for k in range(1, rounds + 1):
        given = ranks.select(F.col("id").alias("src"), "rank").join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        idle = ranks.where("leads is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        fresh = (F.lit(1 - damping) + idle * damping) / F.lit(float(n)) + F.coalesce("got", F.lit(0.0)) * damping
        ranks = base.join(given, "id", "left").select("id", "leads", fresh.alias("rank"))
        if k % cut_every == 0 or k == rounds:
            ranks = checkpointed(ranks)
    return ranks.select("id", "rank")


def components_of_cycles(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, cycle)``: strongly connected components of two or more nodes, named by their greatest id.

    Colouring: nodes without a link in or out are peeled off; then every node takes the
    greatest id that reaches it, and what reaches the owner of a colour back within the colour
    is its component, which is taken out; the rest goes on. Each step is a join and an
    aggregation over the links left, repeated until nothing changes, which each of them reaches
    by itself. More than ``rounds`` inner rounds together, where given, are an error.
    """
    left = checkpointed(links.select("src", "dst").where("src <> dst").distinct())
    found = left.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    used = 0

    def count_round() -> None:
        nonlocal used
        used += 1
        if rounds is not None and used > rounds:
            raise RuntimeError(f"components of cycles need more than {rounds} rounds")

    while not left.isEmpty():
        size = left.count()
        while True:  # peel
            count_round()
            inner = left.select(F.col("src").alias("k")).intersect(left.select(F.col("dst").alias("k")))
            left = checkpointed(left.join(inner.withColumnRenamed("k", "src"), "src", "left_semi").join(inner.withColumnRenamed("k", "dst"), "dst", "left_semi"))
            now = left.count()
            if now == size:
                break
            size = now
        if not size:
            break
        colour = checkpointed(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # the greatest id that reaches each node
            count_round()
            came = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
            after = checkpointed(colour.join(came, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), (F.coalesce("came", "colour") > F.col("colour")).alias("new")))
            moved = not after.where("new").isEmpty()
            colour = after.select("node", "colour")
            if not moved:
                break
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
        back = checkpointed(same.where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        mine = checkpointed(colour.where("node = colour"))
        front = mine
        while True:  # who reaches the owner of the colour
            count_round()
            front = front.select(F.col("node").alias("dst"), "colour").join(back, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = checkpointed(front.join(mine, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            mine = mine.unionByName(front)
        mine = checkpointed(mine)
        found = found.unionByName(mine.select("node", F.col("colour").alias("cycle")))
        gone = mine.select("node")
        left = checkpointed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    sizes = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes.select("cycle"), "cycle", "left_semi").select("node", "cycle")
