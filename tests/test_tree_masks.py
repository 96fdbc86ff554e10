"""Masks of tree nodes: runs of leaves, cut into blocks."""

import numpy as np
import pytest

from gridwright.functions import kernels
from gridwright.operators import graph, tree


def test_leaves_under_a_node_are_neighbours():
    rng = np.random.default_rng(11)
    for _ in range(50):
        n, m = int(rng.integers(1, 20)), int(rng.integers(0, 40))
        u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        t = kernels.merge_tree(n, u, v, w, np.argsort(w, kind="stable"))
        order, first, size = kernels.spans(t)
        under = t.fold(np.array([{i} for i in range(n)], object), lambda z, a, b: a | b)
        assert [set(order[f : f + s].tolist()) for f, s in zip(first, size)] == list(under)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_masks_of_any_block(spark, block):
    rng = np.random.default_rng(12)
    data = [(i, y, x, [float(rng.integers(0, 4)) / 4]) for i, (h, w) in ((2, (4, 4)), (5, (1, 3)), (9, (1, 1))) for y in range(h) for x in range(w) if (i, y) != (2, 1) or x > 2]
    pixels = spark.createDataFrame(data, "image_id long, y int, x int, f array<double>")
    t = tree.merge_tree(graph.graph(pixels, 4, "euclid", 4), pixels, 4)
    want = []
    for i in (2, 5, 9):
        held = {}
        for r in sorted((r for r in t.collect() if r.image_id == i), key=lambda r: r.node):
            held[r.node] = [r.pixel] if r.is_leaf else held[r.sons[0]] + held[r.sons[1]]
        want += [(i, z + 1, p) for z, ps in held.items() for p in ps]
    out = tree.masks(t, block)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # no task makes all masks of an image
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_tree_has_no_masks(spark):
    pixels = spark.createDataFrame([], "image_id long, y int, x int, f array<double>")
    assert tree.masks(tree.merge_tree(graph.graph(pixels, 4, "euclid", 4), pixels, 4)).count() == 0
