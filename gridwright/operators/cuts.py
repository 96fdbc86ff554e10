"""Cuts of weighted merge trees: (image_id, node from 1); minimum cuts of any graph between two terminals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import flow, kernels
from gridwright.operators.grouped import per_group, per_pair

MODES = {
    "Kruskal": kernels.cut_kruskal,
    "Prim": kernels.cut_prim,
    "PWatershed": kernels.cut_power,
    "Graphcuts": kernels.cut_minimum,
    "MinCover": kernels.min_cover,
}


def cut_tree(tree: DataFrame, mode: str = "Kruskal", **options) -> DataFrame:
    """The nodes of the cut. Every node needs a weight: see tree.weight_tree."""
    if mode not in MODES:
        raise ValueError(f"unknown cut: {mode}")
    kernel = MODES[mode]

    def run(c: dict) -> dict:
        order = np.argsort(c["node"])
        weight = c["weight"][order].astype(float)
        if np.isnan(weight).any():
            raise ValueError("the tree has nodes without a weight; give it weights with weight_tree first")
        return {"node": np.array(kernel(c["father"][order].astype(np.int64), weight, **options)) + 1}

    return per_group(tree.select("image_id", "node", "father", F.col("weight").cast("double").alias("weight")), "image_id", run, "node int")


def _with_later(now: DataFrame, later: DataFrame | None, keys: list[str], sizes: list[str]) -> DataFrame:
    """Capacities summed by key, and beside them (name_2) those of `later`, which default to the first."""
    rows = now.groupBy(*keys).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sizes])
    if later is None:
        return rows.select("*", *[F.col(c).alias(f"{c}_2") for c in sizes])
    other = later.groupBy(*keys).agg(*[F.sum(F.col(c).cast("double")).alias(f"{c}_2") for c in sizes])
    found = rows.join(other, keys, "left" if keys[-1] == "dst" else "full")
    return found.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sizes], *[F.coalesce(f"{c}_2", c).alias(f"{c}_2") for c in sizes])


def max_flow(terminals: DataFrame, arcs: DataFrame, later_terminals: DataFrame | None = None, later_arcs: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, at_source, flow, changed): the minimum cut that lies nearest the source, the flow of the whole graph, and
    whether the node has changed sides.

    terminals: graph_id, node, cap_source, cap_sink; arcs: graph_id, src, dst, cap, rev_cap. Rows of one node or arc are summed;
    nodes that only arcs name have no terminals. Later tables, of the same columns, hold new capacities of some terminals and
    of some arcs that are there; the first flow is then used again, and the cut returned is the second one. A graph is a task."""
    ends = _with_later(terminals, later_terminals, ["graph_id", "node"], ["cap_source", "cap_sink"])
    lines = _with_later(arcs, later_arcs, ["graph_id", "src", "dst"], ["cap", "rev_cap"])

    def run(t: dict, a: dict) -> dict:
        ids = np.unique(np.r_[t["node"], a["src"], a["dst"]].astype(np.int64))
        net, resized = flow.Network(len(ids)), []
        for node, *sizes in zip(np.searchsorted(ids, t["node"]).tolist(), *[t[c].tolist() for c in ("cap_source", "cap_sink", "cap_source_2", "cap_sink_2")]):
            resized += zip((net.arc(net.source, node, sizes[0]), net.arc(node, net.sink, sizes[1])), sizes[2:])
        for u, v, *sizes in zip(np.searchsorted(ids, a["src"]).tolist(), np.searchsorted(ids, a["dst"]).tolist(), *[a[c].tolist() for c in ("cap", "rev_cap", "cap_2", "rev_cap_2")]):
            e = net.arc(u, v, *sizes[:2])
            resized += [(e, sizes[2]), (e + 1, sizes[3])]
        total, before = net.solve()
        side = before
        if any(net.size[e] != size for e, size in resized):
            for e, size in resized:
                if net.size[e] != size:
                    net.resize(e, size)
            total, side = net.solve()
        n = range(len(ids))
        return {"node": ids, "at_source": [i in side for i in n], "flow": [float(total)] * len(ids), "changed": [(i in side) != (i in before) for i in n]}

    key = F.col("graph_id").cast("long").alias("graph_id")
    return per_pair(ends.withColumn("graph_id", key), lines.withColumn("graph_id", key), "graph_id", run, "node long, at_source boolean, flow double, changed boolean")
