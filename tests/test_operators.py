"""Operators on hand-made tables: borders, holes, ties, several images, the affinity example."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import cuts, distributed, graph, malis, regions, segment, tree
from gridwright.sources import graph_text


def pixels(spark, *images):
    rows = [(i, y, x, [float(c)] if not isinstance(c, list) else [float(k) for k in c]) for i, image in enumerate(images) for y, line in enumerate(image) for x, c in enumerate(line) if c is not None]
    return spark.createDataFrame(rows, "image_id long, y int, x int, f array<double>")


def edge_set(df):
    return {(r.image_id, r.plane, r.src, r.dst, round(r.w, 6)) for r in df.collect()}


def test_graph_borders_holes_and_images(spark):
    assert graph.graph(pixels(spark, [[1]])).count() == 0
    got = edge_set(graph.graph(pixels(spark, [[1, 3, 6]], [[1], [5]]), 8, width=3))
    assert got == {(0, 0, 0, 1, 2.0), (0, 0, 1, 2, 3.0), (1, 1, 0, 3, 4.0)}
    assert edge_set(graph.graph(pixels(spark, [[1, None, 6], [2, 2, 2]]), 4)) == {(0, 1, 0, 3, 1.0), (0, 1, 2, 5, 4.0), (0, 0, 3, 4, 0.0), (0, 0, 4, 5, 0.0)}
    assert graph.graph(pixels(spark), 8, width=1).count() == 0


def test_graph_over_strips(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 50, (150, 4)).tolist()
    got = edge_set(graph.graph(pixels(spark, image), 8, "max", 4))
    want = {(0, p, y * 4 + x, (y + dy) * 4 + x + dx, float(abs(image[y][x] - image[y + dy][x + dx]))) for p, (dy, dx) in enumerate(graph.PLANES) for y in range(150) for x in range(4) if 0 <= y + dy < 150 and x + dx < 4}
    assert got == want


def test_angle_of_a_zero_vector(spark):
    assert [round(r.w, 6) for r in graph.graph(pixels(spark, [[[0, 0], [1, 2]]]), 4, "angle", 2).collect()] == [round(np.pi / 2, 6)]
    with pytest.raises(ValueError):
        graph.graph(pixels(spark, [[1]]), 4, "city", 1)


def test_gradient_of_a_lone_pixel(spark):
    p = pixels(spark, [[1]])
    assert [r.v for r in graph.gradient(graph.graph(p, 4, width=1), 1, p).collect()] == [-1.0]


def test_uniform_image_is_one_component(spark):
    p = pixels(spark, [[1, 1], [1, 1]], [[1, 9], [1, 9]])
    e = graph.graph(p, 4, width=2)
    for whole in (True, False):
        got = {(r.image_id, r.y, r.x): r.label for r in segment.connected_components(e, p, 2, 0.5, per_image=whole).collect()}
        assert got == {(0, 0, 0): 0, (0, 0, 1): 0, (0, 1, 0): 0, (0, 1, 1): 0, (1, 0, 0): 0, (1, 0, 1): 1, (1, 1, 0): 0, (1, 1, 1): 1}


def test_segment_joins_small_parts(spark):
    p = pixels(spark, [[0, 0, 0, 9, 0, 0, 0]])
    e = graph.graph(p, 4, width=7)
    assert len({r.label for r in segment.segment(e, p, 7, 1, 1).collect()}) == 3
    assert len({r.label for r in segment.segment(e, p, 7, 1, 2).collect()}) == 2
    sparse = spark.createDataFrame([(7, 1, 2, 0.1), (7, 4, 2, 5.0)], "graph_id long, src long, dst long, w double")
    assert {(r.node, r.label) for r in segment.segment_sparse(sparse, 1, 1).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_forest_of_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(a), int(b), float(w)) for i, (a, b, w) in enumerate(zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(0, 5, 80)))]
    got = {r.e for r in distributed.spanning_forest(spark.createDataFrame(rows, "e long, u long, v long, w double")).collect()}
    up = list(range(30))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for e, a, b, w in sorted(rows, key=lambda r: (r[3], r[0])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add(e)
    assert got == want


def test_trees_filters_and_cuts(spark):
    p = pixels(spark, [[0.0, 0.1, 0.9], [0.0, 0.2, 0.8]], [[0.5]])
    e = graph.graph(p, 4, width=3)
    t = tree.merge_tree(e, p, 3)
    assert t.where("image_id = 0").count() == 11 and t.where("image_id = 1").count() == 1
    with pytest.raises(Exception, match="weight"):
        cuts.cut_tree(t, "Kruskal").count()
    w = tree.weight_tree(t, t.select("image_id", (F.col("node") + 1).alias("node"), F.lit(0.5).alias("weight")))
    for mode in cuts.MODES:
        assert cuts.cut_tree(w, mode).where("image_id = 1").collect()[0].node == 1
    for mode in ("surface", "volume", "dynamic", "alphaomega"):
        f = tree.filter_tree(t, mode).where("image_id = 0").orderBy("node").collect()
        assert len(f) == 11 and all(a.attr_altitude <= b.attr_altitude for a, b in zip(f[6:], f[7:]))
    assert tree.components(t, 3).where("image_id = 0 and surface = 6").count() == 1
    assert tree.adjacency(t).count() == 2 * tree.adjacency(t, directed=True).count() == 20
    lines = [r.line for r in tree.dump(t).where("image_id = 1").orderBy("line_no").collect()]
    assert lines == ["root 0 nbnodes 1 nbsoncells 0", "node 0 father -1 level 0"]
    assert "..." in tree.text(t, 40).where("image_id = 0").first().listing


def test_pooling_rules(spark):
    p = pixels(spark, [[[1, 1], [3, 3]], [[0, 4], [2, 2]]])
    segm = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 0, 2), (0, 1, 1, 2)], "image_id long, y int, x int, label long")
    pooled, shape = regions.hist_pooling(p, segm)
    assert {tuple(r.f) for r in pooled.collect()} == {(4 / 3, 4 / 3), (2 / 3, 2.0)}
    assert {(r.label, r["class"]) for r in shape.collect()} == {(1, 2), (2, 2)}
    sure, _ = regions.hist_pooling(p, segm, minconfidence=1.0)
    assert {tuple(r.f) for r in sure.collect()} == {(0.0, 0.0), (0.0, 2.0)}


def test_overlap_of_nothing_is_null(spark):
    segm = spark.createDataFrame([(0, 0, 0, 0.0)], "image_id long, y int, x int, v double")
    mask = spark.createDataFrame([(0, 0, 0, 0)], "image_id long, y int, x int, label long")
    assert [r.ratio for r in regions.overlap(segm, mask, 2).collect()] == [None, None]


def test_malis_step_image(spark):
    image = [[1.0] * 8 for _ in range(4)] + [[1.8] * 8 for _ in range(4)]
    image[4][3] = 1.6
    e = graph.graph(pixels(spark, image), 4, width=8)
    target = spark.createDataFrame([(0, y, x, 1 if y < 4 else 2) for y in range(8) for x in range(8)], "image_id long, y int, x int, label long")
    got = malis.malis(e, target, 8, "min", 0.5, 0.3).collect()
    assert len(got) == 112
    assert round(got[0].loss, 9) == 0.101587302 and got[0].classified == 0 and got[0].rand == 1
    slopes = {(r.plane, r.y, r.x): round(r.gradient, 9) for r in got if r.gradient}
    assert slopes == {(1, 3, 3): -0.507936508}


def test_graph_text_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, 1.5), (1, -2.0)], "id int, v double")
    a = spark.createDataFrame([(0, 1, 0.25)], "a int, b int, w double")
    graph_text.write(v, a, str(tmp_path / "g"), 1, 2)
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "g").glob("part-*")) if p.read_text())
    assert text == "#rs 1 cs 2\n2 1\nval sommets\n0 1.5\n1 -2.0\narcs values\n0 1 0.25"
    (tmp_path / "one.txt").write_text(text)
    v2, a2 = graph_text.read(spark, str(tmp_path / "one.txt"))
    assert v2.collect() == v.collect() and a2.collect() == a.collect()
