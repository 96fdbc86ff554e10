"""The demonstration chain: one image through all main operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import graph, regions, segment, tree


def products(pixels: DataFrame, width: int) -> dict[str, DataFrame]:
    """Eight products of images in [0, 1]: both graphs, components, segmentation, gradient, watershed, saliency and its map."""
    four, eight = graph.graph(pixels, 4, "euclid", width), graph.graph(pixels, 8, "euclid", width)
    steep = graph.gradient(four, width, pixels)
    merged = tree.filter_tree(tree.merge_tree(four, pixels, width), "volume")
    salient = tree.saliency(merged, four)
    return {
        "graph4": four,
        "graph8": eight,
        "components": segment.connected_components(four, pixels, width, 0.1),
        "segments": regions.components(segment.segment(four, pixels, width, 3, 20)),
        "gradient": steep,
        "watershed": segment.watershed(steep, 0.08, 8),
        "saliency": salient,
        "saliency_map": graph.gradient(salient, width, pixels),
    }


def counts(pixels: DataFrame, width: int) -> DataFrame:
    """(product, n) of all products."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("product"), "n") for name, df in products(pixels, width).items()]
    return reduce(DataFrame.union, each)
