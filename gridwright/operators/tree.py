"""Merge trees of pixel graphs.

A tree is a table image_id, node, father (-1 at a root), is_leaf, level, altitude, sons, pixel (of a leaf, else null),
merge_src, merge_dst (pixels of the edge that made the node), weight. Leaves come first, in the order of their pixels, and
every son before its father. Trees are built from planes 0 and 1, whatever else the graph has.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import kernels
from gridwright.operators.grouped import per_group, per_pair
from gridwright.session import save

NODES = "node int, father int, is_leaf boolean, level int, altitude int, sons array<int>, pixel long, merge_src long, merge_dst long, weight double"


def quantised(w: np.ndarray) -> np.ndarray:
    """Weights in [0, 1] on 255 levels."""
    return np.floor(np.clip(np.round(w, 9) * 255, 0, 255)).astype(np.int64)


def _rows(t: kernels.Tree, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, level: np.ndarray, altitude: np.ndarray) -> dict:
    n, m = t.n, len(t.father)
    some = [None] * n
    return {
        "node": np.arange(m),
        "father": t.father,
        "is_leaf": np.arange(m) < n,
        "level": level,
        "altitude": altitude,
        "sons": [[] if a < 0 else [a, b] for a, b in t.sons.tolist()],
        "pixel": [*ids.tolist(), *[None] * (m - n)],
        "merge_src": some + src[t.edge[n:]].tolist(),
        "merge_dst": some + dst[t.edge[n:]].tolist(),
        "weight": [None] * m,
    }


def _build(edges: DataFrame, pixels: DataFrame, width: int, kind: str) -> DataFrame:
    """Trees of all images; a pixel without an edge is a leaf that is a root."""
    if edges.schema["plane"].dataType.typeName() and edges.where("plane > 1").take(1):
        warnings.warn("planes 2 and 3 are left out of trees", stacklevel=3)

    def run(p: dict, e: dict) -> dict:
        ids = np.unique(p["p"])
        w = e["w"]
        q = quantised(w) if kind == "merge" else w.astype(np.int64) if kind == "arb" else w
        order = np.lexsort((e["x"], e["y"], e["plane"], q)) if kind != "scale" else np.lexsort((e["plane"], e["x"], e["y"], w))
        u, v = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
        t = kernels.merge_tree(len(ids), u, v, q, order)
        level = t.level
        if kind == "scale":
            level = kernels.scales(t, np.r_[np.zeros(t.n), w[t.edge[t.n :]]])
        return _rows(t, ids, e["src"], e["dst"], level, level)

    nodes = pixels.select(F.col("image_id").cast("long").alias("image_id"), (F.col("y").cast("long") * width + F.col("x")).alias("p"))
    flat = edges.where("plane < 2").select(F.col("image_id").cast("long").alias("image_id"), "plane", "y", "x", "src", "dst", "w")
    return per_pair(nodes, flat, "image_id", run, NODES)


def merge_tree(edges: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """Kruskal over weights on 255 levels, ties by plane, row, column; an edge that merges makes a node of its level."""
    return _build(edges, pixels, width, "merge")


def hierarchy_arb(edges: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """The same on weights that are levels already."""
    return _build(edges, pixels, width, "arb")


def hierarchy_scale(edges: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """Kruskal over exact weights; the level of a node is its observation scale."""
    return _build(edges, pixels, width, "scale")


def _tree(c: dict) -> tuple[kernels.Tree, dict, np.ndarray]:
    """A tree from its table's columns, its rows in order, and the pixels of its leaves."""
    order = np.argsort(c["node"])
    c = {k: v[order] for k, v in c.items()}
    leaf = c["is_leaf"].astype(bool)
    n = int(leaf.sum())
    if not leaf[:n].all() or (c["father"][c["father"] >= 0] <= c["node"][c["father"] >= 0]).any():
        raise ValueError("leaves must come first, and sons before fathers")
    sons = np.full((len(leaf), 2), -1)
    for z in range(n, len(leaf)):
        sons[z] = c["sons"][z]
    return kernels.Tree(n, c["father"].astype(np.int64), c["level"].astype(np.int64), np.r_[np.full(n, -1), np.arange(len(leaf) - n)], sons), c, c["pixel"][:n].astype(np.int64)


def filter_tree(tree: DataFrame, mode: str = "surface") -> DataFrame:
    """The tree rebuilt from its spanning edges in the order of an attribute: surface, dynamic, volume or alphaomega.

    altitude is that of the node of the same number before filtering, as the operator returns it; attr_altitude is
    the attribute value that ordered the node's edge; level is the edge's own level."""
    kinds = {"surface": "surface", "dynamic": "dynamic", "volume": "volume", "alphaomega": "omega"}
    if mode not in kinds:
        raise ValueError(f"unknown filter: {mode}")

    def run(c: dict) -> dict:
        t, c, ids = _tree(c)
        n = t.n
        src, dst = (c[k][n:].astype(np.int64) for k in ("merge_src", "merge_dst"))
        u, v = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        new, value = kernels.filtered(t, u, v, kinds[mode])
        level = np.r_[np.zeros(n, np.int64), t.level[n:][new.edge[n:]]]
        return _rows(new, ids, src, dst, level, c["altitude"].astype(np.int64)) | {"attr_altitude": value}

    return per_group(tree, "image_id", run, NODES + ", attr_altitude double")


def weight_tree(tree: DataFrame, weights: DataFrame) -> DataFrame:
    """The tree with weights (image_id, node from 1, weight); nodes without one weigh 0."""
    own = weights.select("image_id", (F.col("node") - 1).cast("int").alias("node"), F.col("weight").cast("double").alias("w"))
    return tree.join(own, ["image_id", "node"], "left").withColumn("weight", F.coalesce("w", F.lit(0.0))).drop("w")


def levels(tree: DataFrame) -> DataFrame:
    return tree.select("image_id", "node", "level")


def adjacency(tree: DataFrame, directed: bool = False) -> DataFrame:
    """(image_id, id, neighbor) of sons and fathers, from 1; both ways unless directed."""
    up = tree.where("father >= 0").select("image_id", (F.col("node") + 1).cast("long").alias("id"), (F.col("father") + 1).cast("long").alias("neighbor"))
    return up if directed else up.union(up.select("image_id", F.col("neighbor").alias("id"), F.col("id").alias("neighbor")))


def saliency(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """edges of planes 0 and 1 with w = altitude of the lowest common ancestor of their ends, over 255."""

    def run(c: dict, e: dict) -> dict:
        t, c, ids = _tree(c)
        top = kernels.lowest_common(t.father, np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]))
        return {k: e[k] for k in ("plane", "y", "x", "src", "dst")} | {"w": np.where(top < 0, np.nan, c["altitude"][top] / 255.0)}

    flat = edges.where("plane < 2").select(F.col("image_id").cast("long").alias("image_id"), "plane", "y", "x", "src", "dst")
    return per_pair(tree, flat, "image_id", run, "plane int, y int, x int, src long, dst long, w double")


def components(tree: DataFrame, width: int) -> DataFrame:
    """Geometry of the pixels under every node, ids and coordinates from 1: leaves first, each father from its sons."""

    def run(c: dict) -> dict:
        t, c, ids = _tree(c)
        x, y = ids % width + 1, ids // width + 1
        add, low, high = (lambda z, a, b: a + b), (lambda z, a, b: min(a, b)), (lambda z, a, b: max(a, b))
        size = kernels.areas(t)
        left, right, top, bottom = t.fold(x, low), t.fold(x, high), t.fold(y, low), t.fold(y, high)
        return {
            "id": np.arange(1, len(size) + 1), "centroid_x": t.fold(x, add) / size, "centroid_y": t.fold(y, add) / size, "surface": size,
            "bbox_left": left, "bbox_right": right, "bbox_top": top, "bbox_bottom": bottom, "bbox_width": right - left + 1, "bbox_height": bottom - top + 1,
            "bbox_x": (right + left) / 2, "bbox_y": (bottom + top) / 2,
        }

    return per_group(tree, "image_id", run, "id long, centroid_x double, centroid_y double, surface long, bbox_left int, bbox_right int, bbox_top int, bbox_bottom int, bbox_width int, bbox_height int, bbox_x double, bbox_y double")


def masks(tree: DataFrame, block: int = 512) -> DataFrame:
    """(image_id, id, pixel): the pixels under every node, ids from 1. As many rows as all masks have pixels. The pixels are put in an
    order in which every mask is a run, and cut into blocks; the part that a mask has of a block becomes rows only where it is read."""

    def run(c: dict) -> dict:
        t, _, ids = _tree(c)
        order, first, size = kernels.spans(t)
        return {"id": np.arange(1, len(first) + 1), "first": first, "last": first + size - 1, "pixel": [*ids[order].tolist(), *[None] * (len(first) - t.n)]}

    runs = save(per_group(tree, "image_id", run, "id long, first long, last long, pixel long"), "tree-masks")
    # the pixel at a place is in the row of that number; two blocks or more may meet in a task, and about 4,000,000 rows
    place, total = F.col("id") - 1, runs.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    parts = max(1, total // 4_000_000)
    held = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "pixel"))), lambda s: s["pixel"]).alias("held")
    blocks = runs.where("pixel IS NOT NULL").groupBy("image_id", F.floor(place / block).alias("block")).agg(held)
    pieces = runs.select("image_id", "id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("block"))
    both = pieces.repartition(parts, "image_id", "block").join(blocks.repartition(parts, "image_id", "block"), ["image_id", "block"])
    begin = F.greatest(F.col("first") - F.col("block") * block, F.lit(0)).cast("int")
    end = F.least(F.col("last") - F.col("block") * block, F.lit(block - 1)).cast("int")
    return both.select("image_id", "id", F.explode(F.slice("held", begin + 1, end - begin + 1)).alias("pixel"))


def label_at_level(tree: DataFrame, k: float) -> DataFrame:
    """(image_id, pixel, label): the partition of nodes of level k at most; label is the smallest pixel."""

    def run(c: dict) -> dict:
        t, c, ids = _tree(c)
        own = np.arange(len(t.father))
        for z in range(len(own) - 1, -1, -1):
            f = t.father[z]
            if f >= 0 and c["level"][f] <= k:
                own[z] = own[f]
        first: dict[int, int] = {}
        for p, z in zip(ids.tolist(), own[: t.n].tolist()):
            first.setdefault(z, p)
        return {"pixel": ids, "label": [first[z] for z in own[: t.n].tolist()]}

    return per_group(tree, "image_id", run, "pixel long, label long")


def flatten(tree: DataFrame, bounds: tuple[float, ...] = (10, 30, 150, 300, 500), least_area: int = 1) -> DataFrame:
    """(image_id, node, father, band, area, source): the tree in altitude bands, 0 for leaves and 1 to len(bounds) + 1 above. An
    inner node of its father's band, or of fewer than least_area pixels, is merged into its father; what is left is
    numbered anew, in the old order. source: the old number."""

    def run(c: dict) -> dict:
        t, c, _ = _tree(c)
        band = np.where(np.arange(len(t.father)) < t.n, 0, 1 + np.searchsorted(np.array(bounds, float), c["altitude"].astype(float), "right"))
        stay, above = kernels.flattened(t, band, least_area)
        father = np.where(above[stay] < 0, -1, np.searchsorted(stay, above[stay]))
        return {"node": np.arange(len(stay)), "father": father, "band": band[stay], "area": kernels.areas(t)[stay], "source": stay}

    return per_group(tree, "image_id", run, "node int, father int, band int, area long, source int")


def dump(tree: DataFrame) -> DataFrame:
    """(image_id, line_no, line): a head line with root and number of nodes, then a line for each node."""
    head = tree.groupBy("image_id").agg(F.max(F.when(F.col("father") < 0, F.col("node"))).alias("root"), F.count(F.lit(1)).alias("n"), F.sum(F.size("sons")).alias("cells"))
    first = head.select("image_id", F.lit(-1).alias("line_no"), F.format_string("root %d nbnodes %d nbsoncells %d", "root", "n", "cells").alias("line"))
    sons = F.when(F.size("sons") > 0, F.format_string(" sons %s", F.array_join(F.col("sons").cast("array<string>"), " "))).otherwise("")
    weight = F.when(F.col("weight").isNotNull(), F.format_string(" weight %f", "weight")).otherwise("")
    lines = tree.select("image_id", F.col("node").alias("line_no"), F.concat(F.format_string("node %d father %d level %d", "node", "father", "level"), sons, weight).alias("line"))
    return first.union(lines)


def graphviz(tree: DataFrame) -> DataFrame:
    """(image_id, line): the tree in the DOT language; lines may come in any order between the first and the last."""
    ends = tree.select("image_id").distinct()
    lines = tree.where("father >= 0").select("image_id", F.lit(1).alias("line_no"), F.format_string("  %d -> %d;", "father", "node").alias("line"))
    names = tree.select("image_id", F.lit(1).alias("line_no"), F.format_string('  %d [label="%d:%d"];', "node", "node", "level").alias("line"))
    return ends.select("image_id", F.lit(0).alias("line_no"), F.lit("digraph tree {").alias("line")).union(lines).union(names).union(ends.select("image_id", F.lit(2).alias("line_no"), F.lit("}").alias("line")))


def write_dump(tree: DataFrame, path: str) -> None:
    """The dump as text files, one folder for each image, lines in order."""
    dump(tree).repartition("image_id").sortWithinPartitions("image_id", "line_no").select("image_id", "line").write.partitionBy("image_id").text(path)


def text(tree: DataFrame, most: int = 9 * 1024) -> DataFrame:
    """(image_id, listing): the dump as one string of `most` characters at most, then "..."."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return dump(tree).where(F.col("line_no") < most).groupBy("image_id").agg(whole.alias("t")).select("image_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t")).alias("listing"))
