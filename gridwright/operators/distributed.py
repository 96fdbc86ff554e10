"""Components and spanning forests of graphs that are larger than a worker, as rounds of joins between written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.session import save


def roots(step: DataFrame) -> DataFrame:
    """(node, root) followed up to the top: each round doubles the length of the path that it shortens."""
    while True:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = save(step.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), (F.coalesce("higher", "root") != F.col("root")).alias("moved")), "cc-jump")
        step = jumped.select("node", "root")
        if not jumped.where("moved").take(1):
            return step


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches. Each round hooks nodes to their smallest
    neighbour, shortens paths and contracts, until no edge is left. Joins are between written tables, so that Spark can
    split a node that has very many edges."""
    spark = edges.sparkSession
    edges = save(edges, "cc-edges")
    total: DataFrame | None = None
    while edges.take(1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = roots(save(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root")), "cc-hook"))
        a = edges.join(step.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").select("v", "ru")
        b = save(a, "cc-half").join(step.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v").where("ru <> rv")
        edges = save(b.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
        if total is None:
            total = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            total = save(total.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "cc-total")
    return total if total is not None else spark.createDataFrame([], "node long, root long")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Boruvka: the edges (e, u, v, w) of the minimum spanning forest by (w, e). e is unique, so the forest is. In each round
    every component takes its least edge out; components are then merged, and edges within one are dropped."""
    live = save(edges.select("e", "w", "u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")).where("u <> v"), "mst-live")
    chosen: list[DataFrame] = []
    while live.take(1):
        ends = live.select("e", "w", "cu", "cv").union(live.select("e", "w", F.col("cv").alias("cu"), F.col("cu").alias("cv")))
        best = save(ends.groupBy("cu").agg(F.min(F.struct("w", "e", "cv")).alias("b")).select("cu", "b.e", "b.cv"), "mst-best")
        chosen.append(best.select("e").distinct())
        # every component points to the one that its least edge leads to; only pairs can point to each other
        back = best.select(F.col("cu").alias("cv"), F.col("cv").alias("again"))
        top = (F.col("again") == F.col("cu")) & (F.col("cu") < F.col("cv"))
        merged = roots(save(best.join(back, "cv").select(F.col("cu").alias("node"), F.when(top, F.col("cu")).otherwise(F.col("cv")).alias("root")), "mst-hook"))
        name = lambda c: merged.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        half = save(live.join(name("cu"), "cu"), "mst-half")
        live = save(half.join(name("cv"), "cv").where("rcu <> rcv").select("e", "w", "u", "v", F.col("rcu").alias("cu"), F.col("rcv").alias("cv")), "mst-live")
    if not chosen:
        return edges.select("e", "u", "v", "w").limit(0)
    found = chosen[0]
    for more in chosen[1:]:
        found = found.union(more)
    return edges.join(save(found.distinct(), "mst-chosen"), "e").select("e", "u", "v", "w")
