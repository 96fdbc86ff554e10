"""Merge trees of images that no worker holds: a distributed spanning forest, then its edges in blocks of their order.

Within a block the merges are one task's work for each image, over the tops of the trees that the blocks before it have made;
the edges that are left are then moved up to the new tops. So memory is bounded by a block, and the number of rounds is
that of the blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators import distributed
from gridwright.operators.grouped import per_group
from gridwright.session import save

#: Columns as in tree.NODES, with long node numbers.
COLUMNS = ["image_id", "node", "father", "is_leaf", "level", "altitude", "sons", "pixel", "merge_src", "merge_dst", "weight"]


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a column of that name: places from 0 within image_id, in the given order. Rows are sorted by ranges; what goes
    through one task is a count for each range and each image."""
    at = F.monotonically_increasing_id()
    keys = ["image_id", *order]
    placed = save(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), f"numbered-{name}")
    # the id holds the range in its high bits and the place in it in the low ones
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    each = placed.groupBy("image_id", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_in").alias("first"))
    before = Window.partitionBy("image_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("image_id", "_range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["image_id", "_range"]).withColumn(name, F.col("_in") - F.col("first") + F.col("base")).drop("_at", "_range", "_in", "first", "base")


def _merges(c: dict) -> dict:
    """Merges of one block, in order: rows (z, its sons); then for every top that the block meets a row (top, its new top, -1)."""
    up: dict[int, int] = {}

    def top(a: int) -> int:
        path = []
        while a in up:
            path.append(a)
            a = up[a]
        for b in path:
            up[b] = a
        return a

    order = np.argsort(c["z"])
    node, a, b = [], [], []
    for z, u, v in zip(*[c[k][order].tolist() for k in ("z", "cu", "cv")]):
        x, y = sorted((top(u), top(v)))
        up[x] = up[y] = z
        node.append(z)
        a.append(x)
        b.append(y)
    met = sorted({*c["cu"].tolist(), *c["cv"].tolist()})
    return {"node": node + met, "a": a + [top(x) for x in met], "b": b + [-1] * len(met)}


def merge_tree(edges: DataFrame, pixels: DataFrame, width: int, block: int = 4_000_000) -> DataFrame:
    """The table of tree.merge_tree (node numbers are long), from graphs of any size. block: edges of one image in a round.

    Pixels without edges are leaves that are roots; no pixels, no rows. Planes over 1 are left out."""
    p = (F.col("y").cast("long") * width + F.col("x")).alias("pixel")
    leaves = save(numbered(pixels.select(F.col("image_id").cast("long").alias("image_id"), p).distinct(), ["pixel"], "node"), "tree-leaves")
    span, first, last = leaves.agg(F.max("pixel") + 1, F.min("image_id"), F.max("image_id")).first()
    span, places = span or 1, (span or 1) * ((last or 0) - (first or 0) + 1)
    key = lambda c: (F.col("image_id").cast("long") - F.lit(first or 0)) * span + F.col(c)
    # the number of an edge breaks ties: plane, row, column
    q = F.floor(F.least(F.greatest(F.round("w", 9) * 255, F.lit(0)), F.lit(255))).cast("int")
    every = edges.where("plane < 2").select(F.col("image_id").cast("long").alias("image_id"), (F.col("plane") * F.lit(places) + key("src")).alias("e"), key("src").alias("u"), key("dst").alias("v"), q.alias("w"), "src", "dst")
    every = save(every, "tree-edges")
    chosen = save(distributed.spanning_forest(every.select("e", "u", "v", "w")).select("e"), "tree-spanning")
    count = leaves.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_leaves"))
    ranked = numbered(every.join(chosen, "e", "left_semi").drop("u", "v"), ["w", "e"], "rank").join(count, "image_id")
    ranked = save(ranked.withColumn("z", F.col("rank") + F.col("n_leaves")), "tree-ranked")

    def moved(live: DataFrame, tops: DataFrame, end: str, other: str) -> DataFrame:
        found = live.join(tops.select("image_id", F.col("node").alias(end), F.col("a").alias("new")), ["image_id", end], "left")
        return found.select("image_id", "rank", "z", F.coalesce("new", end).alias(end), other)

    leaf = lambda c: leaves.select("image_id", F.col("pixel").alias(c), F.col("node").alias(f"c{'u' if c == 'src' else 'v'}"))
    half = save(ranked.join(leaf("src"), ["image_id", "src"]).select("image_id", "rank", "z", "dst", "cu"), "tree-half")
    live = save(half.join(leaf("dst"), ["image_id", "dst"]).select("image_id", "rank", "z", "cu", "cv"), "tree-live")
    made, upto = None, 0
    while live.take(1):
        upto += block
        now = live.where(F.col("rank") < upto).select("image_id", "z", "cu", "cv")
        done = save(per_group(now, "image_id", _merges, "node long, a long, b long"), "tree-merges")
        new = done.where("b >= 0")
        made = new if made is None else made.union(new)
        tops, rest = done.where("b < 0"), live.where(F.col("rank") >= upto)
        live = save(moved(save(moved(rest, tops, "cu", "cv"), "tree-half"), tops, "cv", "cu"), "tree-live")

    none = lambda t: F.lit(None).cast(t)
    flat = leaves.select("image_id", "node", F.lit(True).alias("is_leaf"), F.lit(0).alias("level"), F.array().cast("array<long>").alias("sons"), "pixel", none("long").alias("merge_src"), none("long").alias("merge_dst"))
    fathers = flat.select("image_id", "node", F.lit(-1).cast("long").alias("father")).limit(0)
    if made is not None:
        made = save(made, "tree-made")
        inner = made.join(ranked.select("image_id", F.col("z").alias("node"), "w", "src", "dst"), ["image_id", "node"])
        flat = flat.union(inner.select("image_id", "node", F.lit(False), F.col("w"), F.array("a", "b"), none("long"), F.col("src").cast("long"), F.col("dst").cast("long")))
        fathers = made.select("image_id", F.explode(F.array("a", "b")).alias("son"), F.col("node").alias("father")).withColumnRenamed("son", "node")
    out = flat.join(fathers, ["image_id", "node"], "left").withColumns({"father": F.coalesce("father", F.lit(-1).cast("long")), "altitude": F.col("level"), "weight": none("double")})
    return out.select(*COLUMNS)
