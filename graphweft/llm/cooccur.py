"""Items that occur together more often than chance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: An item in at least so many baskets of its group is frequent.
FREQUENT = 48
#: Frequent items of a group are divided into tiles of about so many, whose bit matrices meet in pairs.
TILE_ITEMS = 512
#: Baskets of a group that one bit matrix covers.
BLOCK_BASKETS = 4096
#: Rare items of a block that one task probes against its bit matrix.
BLOCK_RARE = 50_000
#: Rare items of one basket that are paired in one task.
RARE_AT_ONCE = 128

_PAIRS = "grp string, item_a string, item_b string, n_ab long"


def _matrix(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, their rows as booleans per basket, and these packed into words."""
    names, at = np.unique(rows["item"].to_numpy(dtype=object), return_inverse=True)
    full = np.zeros((len(names), width), dtype=bool)
    full[at, rows["col"].to_numpy()] = True
    bits = np.packbits(full, axis=1)
    return names, full, np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def _bit_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts pairs of one cell, two tiles of frequent items in one block of baskets.

    Frequent pairs by popcounts of intersections. A cell of a tile with itself also counts
    mixed pairs: the lists of rare items (tile -1) probe the matrix.
    """
    one, other, part = (int(rows[c].iloc[0]) for c in ("one", "other", "part"))
    width = int(rows["col"].max()) + 1
    names, full, bits = _matrix(rows[rows["tile"] == one], width)
    a: list[str] = []
    b: list[str] = []
    c: list[int] = []
    if one != other:
        theirs, _, more = _matrix(rows[rows["tile"] == other], width)
        for name, own in zip(names, bits):
            both = np.bitwise_count(own & more).sum(axis=1, dtype=np.int64)
            for k in np.flatnonzero(both):
                x, y = (name, theirs[k]) if name < theirs[k] else (theirs[k], name)
                a.append(x)
                b.append(y)
                c.append(int(both[k]))
    elif part == 0:
        for i in range(len(names) - 1):
            both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(both)
            a += [names[i]] * len(hit)
            b += names[i + 1 + hit].tolist()
            c += both[hit].tolist()
    rare = rows[rows["tile"] < 0]
    if len(rare) and len(names):
        for item, cols in rare.groupby("item", sort=False)["col"]:
            both = full[:, cols.to_numpy()].sum(axis=1)
            for k in np.flatnonzero(both):
                x, y = (item, names[k]) if item < names[k] else (names[k], item)
                a.append(x)
                b.append(y)
                c.append(int(both[k]))
    text = [pd.Series(x, dtype=object) for x in ([rows["grp"].iloc[0]] * len(a), a, b)]
    return pd.DataFrame({"grp": text[0], "item_a": text[1], "item_b": text[2], "n_ab": np.array(c, dtype=np.int64)})


def cooccurrence(
    df: DataFrame, group: str, basket: str, item: str, *, min_together: int = 1, min_lift: float = 0.0,
    frequent: int = FREQUENT, tile_items: int = TILE_ITEMS, block_baskets: int = BLOCK_BASKETS,
) -> DataFrame:
    """``(group, item_a, item_b, n_ab, n_a, n_b, n, lift)`` of items that occur in one basket.

    ``df`` has a row for each item of a basket; repeated rows count once. ``n`` is the number
    of baskets of the group (those without items too: rows with a null item), ``n_a`` and
    ``n_b`` the baskets that hold each item, ``n_ab`` both, ``lift`` is
    ``n_ab * n / (n_a * n_b)``; ``item_a < item_b`` by byte. Pairs below ``min_together`` or
    ``min_lift`` are left out. Null groups or baskets name no basket and are left out; an
    empty table gives no rows.

    Heavy-light decomposition, exact at any threshold. First, items are left out that no
    qualifying pair can hold: those in fewer than ``min_together`` baskets, and those in so
    many that even a partner found nowhere else would miss ``min_lift``. Of the rest, an item
    in at least ``frequent`` baskets is frequent, however many there are.

    * frequent with frequent: baskets of a group are numbered and cut into blocks, its frequent
      items by a hash into tiles of about ``tile_items``; a tile's items are rows of a dense
      bit matrix over a block, and popcounts of the rows' intersections count, for each two
      tiles in a cell of its own;
    * rare with frequent: each rare item's list of baskets in a block probes each tile's matrix;
      a block with many rare items is spread over several tasks, each with the matrix;
    * rare with rare: pairs of a basket are counted by hash, combined before the shuffle;
      a basket of more than ``RARE_AT_ONCE`` rare items is cut into tiles, so that no task
      gets all of a huge basket.

    Partial counts are united and summed per pair. The distinct rows, the items left and their
    rows are read more than once and so written to the checkpoint folder.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(basket).alias("basket"), F.col(item).alias("item")).where(
        "grp is not null and basket is not null"
    )
    rows = checkpointed(rows.distinct())
    sizes = rows.select("grp", "basket").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    items = rows.where("item is not null")
    support = items.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n_item"))
    able = (
        support.where(F.col("n_item") >= min_together)
        .join(sizes, "grp")
        .where(F.col("n_item") * F.lit(float(min_lift)) <= F.col("n"))
    )
    often = F.col("n_item") >= frequent
    tiles = able.where(often).groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / tile_items).cast("long").alias("tiles"))
    tile = F.when(often, F.pmod(F.xxhash64("item", F.lit("tile")), F.col("tiles"))).otherwise(F.lit(-1).cast("long"))
    able = able.join(tiles, "grp", "left").select("grp", "item", "n_item", "n", F.coalesce("tiles", F.lit(0)).alias("tiles"), tile.alias("tile"))
    able = checkpointed(able)
    kept = checkpointed(items.join(able.select("grp", "item", "tile", "tiles", "n"), ["grp", "item"]))

    # Frequent items, and rare ones beside them, by blocks of baskets: the block and the column come from a hash of the basket, made dense within the block.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_baskets)).cast("long")
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("basket"), blocks))
    in_block = numbered.select("grp", "block", "basket").distinct()
    columns = in_block.withColumn("col", F.row_number().over(Window.partitionBy("grp", "block").orderBy("basket")) - 1)
    placed = numbered.join(columns, ["grp", "block", "basket"]).select("grp", "block", "col", "item", "tile", "tiles")
    rare_in_block = placed.where("tile < 0").groupBy("grp", "block").agg(F.count(F.lit(1)).alias("rare"))
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("rare", F.lit(0)) / BLOCK_RARE)).cast("long")
    placed = placed.join(rare_in_block, ["grp", "block"], "left").withColumn("parts", parts)

    # Cells: a frequent item meets each tile of its group, its own one in every part of the block's rare items; a rare item meets each tile in its part.
    none = F.lit(0).cast("long")
    every = F.sequence(none, F.col("tiles") - 1)
    pair = F.transform(F.filter(every, lambda t: t != F.col("tile")), lambda t: F.struct(F.least(t, "tile").alias("one"), F.greatest(t, "tile").alias("other"), none.alias("part")))
    itself = F.transform(F.sequence(none, F.col("parts") - 1), lambda p: F.struct(F.col("tile").alias("one"), F.col("tile").alias("other"), p.alias("part")))
    probe = F.transform(every, lambda t: F.struct(t.alias("one"), t.alias("other"), F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")))
    cells = F.when(F.col("tile") < 0, probe).otherwise(F.concat(itself, pair))
    dense = (
        placed.where("tiles > 0")
        .select("grp", "block", "col", "item", "tile", F.inline(cells))
        .groupBy("grp", "block", "one", "other", "part")
        .applyInPandas(_bit_pairs, _PAIRS)
    )

    # Rare pairs: per basket, in tiles of its rare items.
    rare = kept.where("tile < 0").select("grp", "basket", "item")
    cut_into = rare.groupBy("grp", "basket").agg(F.ceil(F.count(F.lit(1)) / RARE_AT_ONCE).cast("long").alias("tiles"))
    tiled = rare.join(cut_into, ["grp", "basket"]).withColumn("tile", F.pmod(F.xxhash64("item"), F.col("tiles")))
    lists = tiled.groupBy("grp", "basket", "tile").agg(F.first("tiles").alias("tiles"), F.sort_array(F.collect_list("item")).alias("items"))
    within = lists.where(F.size("items") > 1).select("grp", F.posexplode("items").alias("at", "x"), "items").select(
        "grp", "x", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("y")
    )
    cut = lists.where("tiles > 1")
    left, right = cut.alias("l"), cut.alias("r")
    across = left.join(
        right, (F.col("l.grp") == F.col("r.grp")) & (F.col("l.basket") == F.col("r.basket")) & (F.col("l.tile") < F.col("r.tile"))
    ).select(F.col("l.grp").alias("grp"), F.explode("l.items").alias("x"), F.col("r.items").alias("ys")).select("grp", "x", F.explode("ys").alias("y"))
    pairs = within.unionByName(across).groupBy("grp", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(
        F.count(F.lit(1)).alias("n_ab")
    )

    together = dense.unionByName(pairs).groupBy("grp", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= min_together)
    side = able.select("grp", "item", "n_item", "n")
    scored = (
        together.join(side.select("grp", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n"), ["grp", "item_a"])
        .join(side.select("grp", F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), ["grp", "item_b"])
        .where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    )
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return scored.select(F.col("grp").alias(group), "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"))
