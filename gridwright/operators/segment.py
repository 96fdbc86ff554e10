"""Segmentation of pixel graphs: components, graph-based segmentation, watershed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import kernels
from gridwright.operators import distributed
from gridwright.operators.grouped import per_group, per_pair, per_sorted

LABEL = "y int, x int, label long"


def _ranked(cols: dict[str, np.ndarray], *names: str) -> np.ndarray:
    return np.lexsort([cols[n] for n in reversed(names)])


def _placed(pixels: dict[str, np.ndarray], edges: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixel ids in order, and the places in them of both ends of each edge."""
    ids = np.unique(pixels["p"])
    return ids, np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])


def numbered(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.select(F.col("image_id").cast("long").alias("image_id"), (F.col("y").cast("long") * width + F.col("x")).alias("p"))


def connected_components(edges: DataFrame, pixels: DataFrame, width: int, threshold: float = 0.5, per_image: bool = True) -> DataFrame:
    """(image_id, y, x, label): components of edges below the threshold, named by their smallest pixel. Images that one
    worker can hold go as a whole; otherwise (per_image=False) the graph is contracted in rounds."""
    near, nodes = edges.where(F.col("w") < threshold), numbered(pixels, width)
    if per_image:

        def run(p: dict, e: dict) -> dict:
            ids, u, v = _placed(p, e)
            return {"y": ids // width, "x": ids % width, "label": ids[kernels.components(len(ids), u, v)] if len(ids) else ids}

        return per_pair(nodes, near.select(F.col("image_id").cast("long").alias("image_id"), "src", "dst"), "image_id", run, LABEL)
    span = nodes.agg(F.max("p")).first()[0] + 1
    key = lambda c: (F.col("image_id").cast("long") * span + F.col(c))
    found = distributed.components(near.select(key("src").alias("u"), key("dst").alias("v")))
    label = F.coalesce(F.col("root") - F.col("image_id") * span, F.col("p"))
    return nodes.withColumn("node", key("p")).join(found, "node", "left").select("image_id", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), label.alias("label"))


def segment(edges: DataFrame, pixels: DataFrame, width: int, thres: float = 3, minsize: int = 20, adaptive: bool = True) -> DataFrame:
    """(image_id, y, x, label) by Felzenszwalb-Huttenlocher; ties of weight go by row, column, plane. With constant limits and
    no least size this is the components of edges at or below the threshold."""
    if not adaptive and minsize <= 1:
        return connected_components(edges.withColumn("w", F.when(F.col("w") <= thres, -1.0).otherwise(1.0)), pixels, width, 0.0)

    def run(p: dict, e: dict) -> dict:
        order = _ranked(e, "w", "y", "x", "plane")
        ids, u, v = _placed(p, {k: e[k][order] for k in ("src", "dst")})
        label = kernels.segment(len(ids), u, v, e["w"][order], thres, minsize, adaptive)
        return {"y": ids // width, "x": ids % width, "label": ids[label] if len(ids) else ids}

    return per_pair(numbered(pixels, width), edges.withColumn("image_id", F.col("image_id").cast("long")), "image_id", run, LABEL)


def segment_sparse(edges: DataFrame, thres: float = 3, minsize: int = 20, adaptive: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """(graph_id, node, label) of edge lists graph_id, src, dst, w; every node from 1 to the largest id is there. Edges pass through
    a worker in order of weight, in chunks; what it holds grows with the nodes only."""

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        sets = kernels.Segments(thres, minsize, adaptive)
        held: list[dict] = []

        def add() -> None:
            u, v, w = (np.concatenate([e[k] for e in held]) for k in ("src", "dst", "w"))
            held.clear()
            if min(u.min(), v.min()) < 1:
                raise ValueError("nodes are numbered from 1")
            sets.add(u - 1, v - 1, w)

        n = 0
        for e in pieces:
            held.append(e)
            n += len(e["w"])
            # flattening the sets costs as much as their nodes, so chunks grow with these
            if n >= max(chunk, sets.n // 4):
                add()
                n = 0
        if held:
            add()
        label = sets.labels(chunk)
        for i in range(0, len(label), chunk):
            yield {"node": np.arange(i + 1, min(i + chunk, len(label)) + 1), "label": label[i : i + chunk] + 1}

    # nan, as a missing weight comes to numpy, is last in either order
    flat = edges.select("graph_id", "src", "dst", F.coalesce(F.col("w").cast("double"), F.lit(float("nan"))).alias("w"))
    return per_sorted(flat, "graph_id", ["w", "src", "dst"], run, "node long, label long")


def watershed(gradient: DataFrame, min_height: float = 0.05, connex: int = 4, topological: bool = True) -> DataFrame:
    """(image_id, y, x, v, basin, n_minima, n_labels) of scalar maps image_id, y, x, v in [0, 1]. v comes back over 255 levels:
    the basin's minimum, or the pass on a divide, where basin is 0. n_labels is n_minima + 1. Images are full rectangles. topological: passes between minima are kept, divides may be
    thick; otherwise divides are thin."""

    def run(c: dict) -> dict:
        h, w = int(c["y"].max()) + 1, int(c["x"].max()) + 1
        image = np.full((h, w), 255, np.int64)
        image[c["y"], c["x"]] = np.floor(np.clip(np.round(c["v"], 9) * 255, 0, 255)).astype(np.int64)
        value, basin, n = kernels.watershed(image, int(min_height * 255), connex, topological)
        return {"y": c["y"], "x": c["x"], "v": value[c["y"], c["x"]] / 255.0, "basin": basin[c["y"], c["x"]], "n_minima": np.full(len(c["y"]), n), "n_labels": np.full(len(c["y"]), n + 1)}

    return per_group(gradient, "image_id", run, "y int, x int, v double, basin long, n_minima long, n_labels long")
