"""Merge trees in blocks are those of one task, whatever the block."""

import numpy as np
import pytest

from gridwright.operators import graph, large_trees, tree


def rows(df):
    return sorted((r.image_id, r.node, r.father, r.is_leaf, r.level, r.altitude, tuple(r.sons), r.pixel, r.merge_src, r.merge_dst) for r in df.collect())


@pytest.mark.parametrize("block", [4, 1000])
def test_blocks_make_the_tree_of_one_task(spark, block):
    rng = np.random.default_rng(3)
    data = [(i, y, x, [float(rng.integers(0, 4)) / 4]) for i, (h, w) in ((2, (3, 3)), (5, (1, 3)), (9, (1, 1))) for y in range(h) for x in range(w) if (i, y, x) != (2, 1, 1)]
    pixels = spark.createDataFrame(data, "image_id long, y int, x int, f array<double>")
    edges = graph.graph(pixels, 4, "euclid", 4)
    got = large_trees.merge_tree(edges, pixels, 4, block)
    assert rows(got) == rows(tree.merge_tree(edges, pixels, 4))
    assert tree.levels(got).count() == tree.levels(tree.merge_tree(edges, pixels, 4)).count()


def test_no_pixels(spark):
    pixels = spark.createDataFrame([], "image_id long, y int, x int, f array<double>")
    assert large_trees.merge_tree(graph.graph(pixels, 4, "euclid", 4), pixels, 4).count() == 0


def test_numbers_follow_the_order(spark):
    data = [(i, k) for i in (1, 4) for k in (9, 3, 7, 3 + i)]
    df = spark.createDataFrame(data, "image_id long, k long")
    got = sorted((r.image_id, r.place, r.k) for r in large_trees.numbered(df, ["k"], "place").collect())
    assert got == [(i, n, k) for i in (1, 4) for n, k in enumerate(sorted(k for j, k in data if j == i))]
