"""Kernels against enumeration on small inputs, and properties of trees and cuts."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.functions import kernels as K


def grid(h, w, values):
    u, v, x = [], [], []
    f = np.array(values, float).reshape(h, w)
    for y, c in itertools.product(range(h), range(w)):
        for dy, dx in ((0, 1), (1, 0)):
            if y + dy < h and c + dx < w:
                u.append(y * w + c)
                v.append((y + dy) * w + c + dx)
                x.append(abs(f[y, c] - f[y + dy, c + dx]))
    return np.array(u), np.array(v), np.array(x)


images = st.integers(2, 4).flatmap(lambda h: st.integers(2, 4).flatmap(lambda w: st.lists(st.integers(0, 9), min_size=h * w, max_size=h * w).map(lambda x: (h, w, x))))


@settings(max_examples=40, deadline=None)
@given(images)
def test_tree_is_whole_and_saliency_is_the_lowest_pass(image):
    h, w, x = image
    u, v, d = grid(*image)
    t = K.merge_tree(h * w, u, v, d.astype(int), np.argsort(d, kind="stable"))
    assert len(t.father) == 2 * h * w - 1
    inner = t.father >= 0
    assert (t.father[inner] > np.flatnonzero(inner)).all() and (t.level[t.father[inner]] >= t.level[inner]).all()
    a, b = np.meshgrid(np.arange(h * w), np.arange(h * w))
    top = t.level[K.lowest_common(t.father, a.ravel(), b.ravel())].reshape(a.shape)
    low = np.full((h * w, h * w), 99)
    np.fill_diagonal(low, 0)
    for p, q, c in zip(u, v, d):
        low[p, q] = low[q, p] = min(low[p, q], c)
    for k in range(h * w):
        low = np.minimum(low, np.maximum(low[:, k : k + 1], low[k : k + 1, :]))
    assert (top == low).all()
    assert K.areas(t)[-1] == h * w
    scale = K.scales(t, t.level.astype(float))
    assert (scale[t.father[inner]] >= scale[inner]).all()


@settings(max_examples=40, deadline=None)
@given(images)
def test_constant_limits_give_components(image):
    u, v, d = grid(*image)
    n = image[0] * image[1]
    order = np.argsort(d, kind="stable")
    near = d <= 2
    assert (K.segment(n, u[order], v[order], d[order], 2, 1, False) == K.components(n, u[near], v[near])).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 6), st.randoms(use_true_random=False))
def test_cuts(n, rnd):
    father, top = [-1] * n, list(range(n))
    while len(top) > 1:
        a, b = rnd.sample(top, 2)
        z = len(father)
        father += [-1]
        father[a] = father[b] = z
        top = [x for x in top if x not in (a, b)] + [z]
    father = np.array(father)
    weight = np.array(rnd.sample(range(1, 999), len(father))) / 1000
    leaf = K.leaves(father)

    def path(x):
        while x >= 0:
            yield int(x)
            x = father[x]

    best = None
    for k in range(1, len(leaf) + 1):
        for c in itertools.combinations(range(len(father)), k):
            if all(sum(x in c for x in path(i)) == 1 for i in leaf):
                # a leaf may also be cut below itself, for 1; then it is in the cut all the same
                cost = sum(min(int(weight[x] * 100000), 100000) if x in leaf else int(weight[x] * 100000) for x in c)
                best = min(best or (cost, c), (cost, c))
    assert K.cut_minimum(father, weight) == sorted(best[1])
    for cut in (K.cut_kruskal, K.cut_prim, K.cut_power, K.cut_minimum):
        got = cut(father, weight)
        assert all(sum(x in got for x in path(i)) == 1 for i in leaf), cut
    assert K.cut_kruskal(father, weight) == K.cut_prim(father, weight) == K.cut_power(father, weight)


def test_power_watershed_example():
    u, v, w = np.array([2, 2, 0, 0, 1]), np.array([0, 1, 1, 3, 3]), np.array([1, 6, 2.5, 5, 6])
    assert K.power_watershed(4, u, v, w, {2: 0.0, 3: 1.0}).tolist() == [1, 0.5, 0, 1]


def test_solver_paths_agree():
    rng = np.random.default_rng(1)
    n = 2000
    u, v, w = np.arange(n - 1), np.arange(1, n), rng.random(n - 1) + 0.5
    x = K.laplacian_solve(n, u, v, w, {0: 0.0, n - 1: 1.0})
    assert np.allclose(x, np.r_[0, np.cumsum(1 / w)] / (1 / w).sum(), atol=1e-6)


def test_min_cover():
    father, weight = np.array([1, 2, -1]), np.array([3.0, 5.0, 1.0])
    assert K.min_cover(father, weight) == [0]
    assert K.min_cover(father, weight, running=True) == [2]


def test_watershed_of_two_basins():
    image = np.array([[0, 0, 9, 0, 0]])
    value, basin, n = K.watershed(image, 2, 4)
    assert n == 2 and basin.tolist() == [[1, 1, 0, 2, 2]] and value.tolist() == [[2, 2, 9, 2, 2]]
    assert K.watershed(image, 20, 4)[2] == 1
    assert K.watershed(np.array([[5]]), 1, 8)[2] == 1


def test_prim_needs_weights_of_its_range():
    with pytest.raises(ValueError):
        K.cut_prim(np.array([-1]), np.array([1.5]))
