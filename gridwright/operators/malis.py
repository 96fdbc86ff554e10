"""Maximin affinity learning of segmentation: loss and gradient of an affinity graph against a labelling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import kernels
from gridwright.operators.grouped import per_pair

#: Offsets (z, y, x) of the edges that each connexity has.
NEIGHBOURHOODS = {
    4: ((0, 0, 1), (0, 1, 0)),
    8: ((0, 0, 1), (0, 1, 0), (0, 1, 1), (0, 1, -1)),
    6: ((-1, 0, 0), (0, -1, 0), (0, 0, -1)),
}


def malis(edges: DataFrame, target: DataFrame, width: int, tree: str = "max", threshold: float = 0.5, margin: float = 0.3, positive: bool = True, negative: bool = True) -> DataFrame:
    """One row for each edge, with its gradient, and the image's loss, share of wrong pairs (classified) and rand.

    edges: image_id, plane, y, x, src, dst, w; target: image_id, y, x, label, 0 where unlabelled. Edges are known by their
    ends, so those of operators.graph fit whatever their planes. tree="min" turns weights and threshold round, and the gradient is of
    the weights as given. An image without a pair of labelled pixels to judge has null metrics and zero gradients; one that
    is in only one of the tables is like that if it has edges, and gives no rows if it has none."""
    if tree not in ("max", "min"):
        raise ValueError(f"unknown tree: {tree}")
    sign = 1.0 if tree == "max" else -1.0

    def run(e: dict, t: dict) -> dict:
        ids = np.unique(np.concatenate([t["p"], e["src"], e["dst"]]))
        label = np.zeros(len(ids), np.int64)
        label[np.searchsorted(ids, t["p"])] = t["label"]
        rank = np.lexsort((e["x"], e["y"], e["plane"]))
        u, v = (np.searchsorted(ids, e[k][rank]) for k in ("src", "dst"))
        loss, wrong, slope = kernels.malis(len(ids), u, v, sign * e["w"][rank], label, sign * threshold, margin, positive, negative)
        n = len(rank)
        told = [None] * n if np.isnan(loss) else None
        return {k: e[k][rank] for k in ("plane", "y", "x")} | {"gradient": sign * slope + 0.0, "loss": told or np.full(n, loss), "classified": told or np.full(n, wrong), "rand": told or np.full(n, 1 - wrong)}

    labels = target.select(F.col("image_id").cast("long").alias("image_id"), (F.col("y").cast("long") * width + F.col("x")).alias("p"), "label")
    return per_pair(edges.withColumn("image_id", F.col("image_id").cast("long")), labels, "image_id", run, "plane int, y int, x int, gradient double, loss double, classified double, rand double")


def metric(judged: DataFrame, name: str = "loss") -> DataFrame:
    """(image_id, value) of one of loss, classified, rand."""
    if name not in ("loss", "classified", "rand"):
        raise ValueError(f"unknown metric: {name}")
    return judged.groupBy("image_id").agg(F.first(name).alias("value"))
