"""Height operators, trees of volumes and maximum flows, against their definitions on small inputs."""

import itertools

import numpy as np
import pytest
from compare import DATA

from gridwright.functions import flow, kernels
from gridwright.operators import cuts, morphology
from gridwright.plans import catalog


def parts(keep, connex):
    """Connected parts of the set cells of a map or a volume, as sets of cells."""
    reach = kernels.REACH[connex]
    left, out = {tuple(p) for p in np.argwhere(keep)}, []
    while left:
        todo, mine = [left.pop()], set()
        while todo:
            p = todo.pop()
            mine.add(p)
            near = {q for q in left if max(abs(a - b) for a, b in zip(p, q)) <= 1 and sum(a != b for a, b in zip(p, q)) <= reach}
            left -= near
            todo += near
        out.append(mine)
    return out


def component(image, p, level, connex):
    return next(c for c in parts(image >= level, connex) if p in c)


@pytest.mark.parametrize(("shape", "connex"), [((4, 5), 4), ((4, 5), 8), ((2, 3, 3), 6), ((3, 2, 3), 18), ((2, 3, 3), 26), ((1, 1), 4), ((1, 4, 1), 6)])
def test_component_trees_of_maps_and_volumes(shape, connex):
    for seed in range(4):
        image = np.random.default_rng(seed).integers(0, 4, shape)
        parent, area, _ = kernels.component_tree(image, connex)
        cells = list(np.ndindex(*shape))
        for i, p in enumerate(cells):
            own = component(image, p, image[p], connex)
            name = max(cells.index(q) for q in own if image[q] == image[p])
            if i != name:
                assert parent[i] == name
                continue
            assert area[i] == len(own)
            lower = [v for v in np.unique(image) if v < image[p] and any(image[q] == v for q in component(image, p, v, connex))]
            want = max(cells.index(q) for q in component(image, p, max(lower), connex) if image[q] == max(lower)) if lower else i
            assert parent[i] == want


def test_neighbourhoods_fit_dimensions():
    for shape, connex in (((2, 2), 6), ((2, 2, 2), 4)):
        with pytest.raises(ValueError):
            kernels.component_tree(np.zeros(shape, int), connex)


@pytest.mark.parametrize("connex", [4, 8])
def test_height_operators(connex):
    for seed in range(4):
        image = np.random.default_rng(seed).integers(0, 9, (4, 5))
        cells = list(np.ndindex(4, 5))
        for height in (1, 3, 20):
            # a pixel sinks to the highest level at which its component has a peak of that height
            cut = np.array([max(v for v in range(-20, image[p] + 1) if max(image[q] for q in component(image, p, v, connex)) >= v + height) for p in cells]).reshape(4, 5)
            assert (-kernels.reconstruct_by_erosion(-image, height, connex) == cut).all()
            label = kernels.regional_minima(-cut, connex)[0]
            assert (kernels.height_segments(image, height, connex, False) == label).all()
            for p, k in zip(cells, kernels.height_segments(image, height, connex, True).ravel()):
                held = {int(label[q]) for q in component(cut, p, cut[p], connex)} - {0}
                assert k == (held.pop() if len(held) == 1 else 0)
            peaks = [min((p for p in cells if label[p] == k), key=lambda p: (-image[p], p)) for k in range(1, label.max() + 1)]
            want = [max([cut[p], *[v for v in range(image[p] + 1) if any(q in component(image, p, v, connex) for q in peaks)]]) for p in cells]
            opened = kernels.height_opening(image, height, connex)
            assert opened.ravel().tolist() == want
            assert (kernels.height_opening(opened, height, connex) == opened).all()
    assert (kernels.height_segments(np.full((2, 3), 7), 2, connex, True) == 1).all()


def network(n, ends, arcs):
    net = flow.Network(n)
    own = [(net.arc(net.source, i, s), net.arc(i, net.sink, t)) for i, (s, t) in enumerate(ends)]
    return net, own, [net.arc(*a) for a in arcs]


def least_cut(n, ends, arcs):
    cost = {}
    for side in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(n + 1)):
        a = set(side)
        cost[side] = sum(ends[i][1] if i in a else ends[i][0] for i in range(n)) + sum(c * (u in a and v not in a) + r * (v in a and u not in a) for u, v, c, r in arcs)
    return min(cost.values()), set(min(cost, key=lambda side: (cost[side], len(side))))


def test_flow_of_two_nodes():
    net, *_ = network(2, [(1, 5), (2, 6)], [(0, 1, 3, 4)])
    assert net.solve() == (3, set())


def test_flows_are_least_cuts_and_survive_changes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 6))
        ends = [tuple(rng.integers(0, 9, 2).tolist()) for _ in range(n)]
        arcs = [(u, v, *rng.integers(0, 6, 2).tolist()) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.7]
        net, own, lines = network(n, ends, arcs)
        assert net.solve() == least_cut(n, ends, arcs)
        for _ in range(4):
            i = int(rng.integers(n))
            ends[i] = tuple(rng.integers(0, 9, 2).tolist())
            for e, size in zip(own[i], ends[i]):
                net.resize(e, size)
            if arcs:
                j = int(rng.integers(len(arcs)))
                arcs[j] = (*arcs[j][:2], *rng.integers(0, 6, 2).tolist())
                net.resize(lines[j], arcs[j][2])
                net.resize(lines[j] + 1, arcs[j][3])
            assert min(net.left) >= 0
            assert net.solve() == least_cut(n, ends, arcs)


def test_max_flow_of_tables(spark):
    ends = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 2, 6), (7, 3, 4, 0)], "graph_id long, node long, cap_source int, cap_sink int")
    arcs = spark.createDataFrame([(0, 0, 1, 3, 4), (7, 3, 9, 1, 0), (7, 3, 9, 1, 0)], "graph_id long, src long, dst long, cap int, rev_cap int")
    got = {(r.graph_id, r.node): (r.at_source, r.flow, r.changed) for r in cuts.max_flow(ends, arcs).collect()}
    assert got == {(0, 0): (False, 3.0, False), (0, 1): (False, 3.0, False), (7, 3): (True, 0.0, False), (7, 9): (True, 0.0, False)}
    later = spark.createDataFrame([(7, 9, 0, 3), (0, 0, 20, 5)], "graph_id long, node long, cap_source int, cap_sink int")
    got = {(r.graph_id, r.node): (r.at_source, r.flow, r.changed) for r in cuts.max_flow(ends, arcs, later).collect()}
    assert got == {(0, 0): (True, 10.0, True), (0, 1): (False, 10.0, False), (7, 3): (True, 2.0, False), (7, 9): (False, 2.0, True)}
    assert cuts.max_flow(ends.limit(0), arcs.limit(0)).count() == 0


def test_queries_are_not_trivial(spark):
    sides = [r.at_source for r in catalog.QUERIES["max_flow_changed"](spark, DATA).collect()]
    assert 0 < sum(sides) < len(sides)
    assert any(r.changed for r in catalog.QUERIES["max_flow_changed"](spark, DATA).collect())


def test_heights_of_tables(spark):
    m = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([0, 3, 0, 9, 8, 9, 0, 5])], "image_id long, y int, x int, v long")
    line = lambda df: [r.v for r in df.orderBy("x").collect()]
    assert line(morphology.height_segments(m, 4)) == [0, 0, 0, 1, 1, 1, 0, 2]
    assert line(morphology.height_opening(m, 4)) == [0, 0, 0, 9, 8, 8, 0, 5]
    voxels = m.withColumnRenamed("x", "z").selectExpr("image_id", "z", "y", "0 as x", "v")
    assert {r.pixel: r.parent for r in morphology.volume_tree(voxels).collect()}[3] == 4
