"""Filters, extrema, component trees, labelling and the stream, on small maps."""

import numpy as np
import pytest

from gridwright.functions import filters, kernels
from gridwright.operators import graph, morphology
from gridwright.streaming.per_image import for_each_batch


def maps(spark, image, kind="long"):
    return spark.createDataFrame([(0, y, x, v) for y, line in enumerate(image) for x, v in enumerate(line)], f"image_id long, y int, x int, v {kind}")


def grid(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r.v
    return out.tolist()


@pytest.mark.parametrize("alpha", [0.4, 1.0, 2.0])
def test_recursive_filters_have_their_kernels(alpha):
    t = np.arange(-150, 151)
    spike = (t == 0).astype(float)
    kernel = (1 + alpha * abs(t)) * np.exp(-alpha * abs(t))
    assert np.allclose(filters.smooth(spike, 0, alpha), kernel / kernel.sum(), atol=1e-12)
    kernel = -t * np.exp(-alpha * abs(t))
    assert np.allclose(filters.derive(spike, 0, alpha), kernel / (-kernel * t).sum(), atol=1e-12)


def test_filter_modes(spark):
    ramp = [[float(3 * x) for x in range(60)] for _ in range(40)]
    m = maps(spark, ramp, "double")
    assert abs(grid(morphology.deriche(m, 1.0, "modulus"))[20][30] - 3) < 1e-6
    assert abs(grid(morphology.deriche(m, 1.0, "direction"))[20][30]) < 1e-6
    assert abs(grid(morphology.deriche(m, 1.0, "laplacian"))[20][30]) < 1e-6
    assert abs(grid(morphology.shen_castan(m, 0.5))[20][30] - 3) < 1e-6
    with pytest.raises(ValueError):
        filters.deriche(np.zeros((2, 2)), 1.0, "other")


def test_extrema(spark):
    m = maps(spark, [[1, 5, 2, 5, 0], [1, 5, 5, 5, 9]])
    assert grid(morphology.extrema(m)) == [[1, 0, 2, 0, 3], [1, 0, 0, 0, 0]]
    assert grid(morphology.extrema(m, "maxima")) == [[0, 0, 0, 0, 0], [0, 0, 0, 0, 1]]
    assert grid(morphology.h_minima(m, 4))[0] == [5, 5, 5, 5, 4]
    assert grid(morphology.h_maxima(m, 3))[1] == [1, 5, 5, 5, 6]
    assert grid(morphology.strongest(maps(spark, [[0, 3, 0, 9, 8, 9, 0, 5]]), 2)) == [[0, 0, 0, 1, 0, 0, 0, 1]]


def test_component_tree_areas():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 5, (5, 6))
    parent, area, volume = kernels.component_tree(image, 4)
    flat = image.ravel()
    for p in range(30):
        if parent[p] == p or flat[parent[p]] < flat[p]:  # names a component
            part = kernels.components(30, *np.array([(y * 6 + x, (y + a) * 6 + x + b) for y in range(5) for x in range(6) for a, b in ((0, 1), (1, 0)) if y + a < 5 and x + b < 6 and min(image[y, x], image[y + a, x + b]) >= flat[p]]).reshape(-1, 2).T)
            mine = (part == part[p]) & (flat >= flat[p])
            assert area[p] == mine.sum()
            if parent[p] != p:
                assert volume[p] == (flat[mine] - flat[parent[p]]).sum()


def test_binary_labels(spark):
    m = maps(spark, [[1, 0, 1], [0, 1, 0], [1, 0, 0]])
    four = {(r.y, r.x): r.label for r in morphology.binary_labels(m, 3).collect()}
    assert four == {(0, 0): 0, (0, 2): 2, (1, 1): 4, (2, 0): 6}
    eight = {r.label for r in morphology.binary_labels(m, 3, ((0, 1), (1, 0), (1, 1), (1, -1))).collect()}
    assert eight == {0}


def test_images_in_a_stream(spark, tmp_path):
    rows = [(i, 0, x, [float(x * i)]) for i in (1, 2) for x in range(3)]
    spark.createDataFrame(rows, "image_id long, y int, x int, f array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("image_id long, y int, x int, f array<double>").parquet(str(tmp_path / "in"))
    for_each_batch(stream, lambda df: graph.graph(df, 4, width=3), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 1.0, 2.0, 2.0]
