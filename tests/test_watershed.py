"""The watershed against the passes between minima, on small images; segmentation and reconstruction against naive versions."""

import itertools

import numpy as np
import pytest

from gridwright.functions import kernels as K


def passes(image, connex):
    """Lowest pass between every two pixels: the least over ways of the largest value on them."""
    h, w = image.shape
    n = h * w
    low = np.full((n, n), 1 << 40)
    flat = image.ravel()
    low[np.arange(n), np.arange(n)] = flat
    for y, x in itertools.product(range(h), range(w)):
        for dy, dx in K.neighbours(h, w, connex):
            if 0 <= y + dy < h and 0 <= x + dx < w:
                low[y * w + x, (y + dy) * w + x + dx] = max(image[y, x], image[y + dy, x + dx])
    for k in range(n):
        low = np.minimum(low, np.maximum(low[:, k : k + 1], low[k : k + 1, :]))
    return low


def sides(basin, connex):
    h, w = basin.shape
    near = K.neighbours(h, w, connex)
    return [{int(basin[y + dy, x + dx]) for dy, dx in near if 0 <= y + dy < h and 0 <= x + dx < w} - {0} for y, x in itertools.product(range(h), range(w))]


def connected(places, shape, connex):
    """Parts of a set of pixels, as sets."""
    left, out = set(places), []
    while left:
        front = [left.pop()]
        part = set(front)
        while front:
            y, x = divmod(front.pop(), shape[1])
            for dy, dx in K.neighbours(*shape, connex):
                q = (y + dy) * shape[1] + x + dx
                if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1] and q in left:
                    left.remove(q)
                    part.add(q)
                    front.append(q)
        out.append(part)
    return out


def cases(n):
    for seed in range(n):
        rng = np.random.default_rng(seed)
        yield rng.integers(0, rng.integers(2, 12), (rng.integers(1, 8), rng.integers(1, 8))), int(rng.integers(0, 3))


@pytest.mark.parametrize("connex", [4, 8])
def test_topological_watershed_keeps_passes_and_cannot_sink(connex):
    for image, height in cases(150):
        value, basin, n = K.watershed(image, height, connex)
        smooth = K.reconstruct_by_erosion(image, height, connex)
        minima, many = K.regional_minima(smooth, connex)
        flat, label = value.ravel(), basin.ravel()
        assert n == many and (basin[minima > 0] == minima[minima > 0]).all() and (value <= smooth).all()
        first = [int(np.flatnonzero(minima.ravel() == k)[0]) for k in range(1, n + 1)]
        before, after = passes(smooth, connex), passes(value, connex)
        for a, b in itertools.combinations(first, 2):
            assert before[a, b] == after[a, b]
        for k, p in enumerate(first, 1):
            mine = np.flatnonzero(label == k)
            assert (flat[mine] == smooth.ravel()[p]).all() and len(connected(mine.tolist(), image.shape, connex)) == 1
        for p, near in enumerate(sides(basin, connex)):
            if label[p]:
                assert near <= {label[p]}
            else:  # whatever lies lower around a divide is in several parts, so sinking would join them; or nothing does
                y, x = divmod(p, image.shape[1])
                lower = {(y + dy) * image.shape[1] + x + dx for dy, dx in K.neighbours(*image.shape, connex) if 0 <= y + dy < image.shape[0] and 0 <= x + dx < image.shape[1] and value[y + dy, x + dx] < flat[p]}
                assert not lower or sum(bool(part & lower) for part in connected(np.flatnonzero(flat < flat[p]).tolist(), image.shape, connex)) > 1


@pytest.mark.parametrize("connex", [4, 8])
def test_thin_divides_part_basins(connex):
    for image, height in cases(150):
        value, basin, n = K.watershed(image, height, connex, topological=False)
        label = basin.ravel()
        assert set(label.tolist()) - {0} == set(range(1, n + 1))
        for p, near in enumerate(sides(basin, connex)):
            assert near <= {label[p]} if label[p] else len(near) != 1
        for k in range(1, n + 1):
            assert len(connected(np.flatnonzero(label == k).tolist(), image.shape, connex)) == 1


def naive_segments(n, edges, thres, minsize, adaptive):
    """Sets as lists of members, limits by set."""
    own = [{i} for i in range(n)]
    limit = {frozenset(s): thres for s in own}
    for a, b, w in edges:
        if own[a] is not own[b] and w <= limit[frozenset(own[a])] and w <= limit[frozenset(own[b])]:
            both = own[a] | own[b]
            limit[frozenset(both)] = w + thres / len(both) if adaptive else thres
            for i in both:
                own[i] = both
    for a, b, _ in edges:
        if own[a] is not own[b] and min(len(own[a]), len(own[b])) < minsize:
            both = own[a] | own[b]
            for i in both:
                own[i] = both
    return [min(s) for s in own]


@pytest.mark.parametrize("adaptive", [True, False])
def test_segments_of_sparse_graphs(spark, adaptive):
    from gridwright.operators import segment

    rng = np.random.default_rng(4)
    rows = [(g, int(a), int(b), float(w)) for g in range(3) for a, b, w in zip(rng.integers(1, 41, 90), rng.integers(1, 41, 90), rng.integers(0, 30, 90) / 10) if a != b]
    got = segment.segment_sparse(spark.createDataFrame(rows, "graph_id long, src long, dst long, w double"), 1.5, 4, adaptive).collect()
    for g in range(3):
        edges = sorted((w, a, b) for k, a, b, w in rows if k == g)
        top = max(max(a, b) for _, a, b in edges)
        want = naive_segments(top, [(a - 1, b - 1, w) for w, a, b in edges], 1.5, 4, adaptive)
        assert {r.node: r.label for r in got if r.graph_id == g} == {i + 1: s + 1 for i, s in enumerate(want)}


def test_reconstruction_of_weights_is_the_best_way_from_a_seed():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        if not pairs:
            continue
        u, v = (np.array(x) for x in zip(*pairs))
        w = rng.integers(0, 6, len(u)).astype(float)
        seeds = rng.choice(n, int(rng.integers(1, n)), replace=False)
        best = np.full(n, -np.inf)
        best[seeds] = np.inf
        for _ in range(n):
            for a, b, x in zip(u, v, w):
                best[a], best[b] = max(best[a], min(best[b], x)), max(best[b], min(best[a], x))
        want = [min(x, max(best[a], best[b])) if max(best[a], best[b]) > -np.inf else np.nan for a, b, x in zip(u, v, w)]
        np.testing.assert_array_equal(K.reconstructed(n, u, v, w, seeds), want)


def test_an_image_without_labelled_pairs_has_null_metrics(spark):
    from gridwright.operators import graph, malis

    pixels = spark.createDataFrame([(i, y, x, [float(y + 2 * x)]) for i in range(3) for y in range(2) for x in range(2)], "image_id long, y int, x int, f array<double>")
    target = spark.createDataFrame([(i, y, x, (1 + y) * (i == 0)) for i in range(2) for y in range(2) for x in range(2)], "image_id long, y int, x int, label long")
    got = {r.image_id: r.value for r in malis.metric(malis.malis(graph.graph(pixels, 4, "euclid", 2), target, 2), "loss").collect()}
    assert got[0] is not None and got[1] is None and got[2] is None
