"""Algorithms on one graph or tree, in numpy and plain Python, without Spark.

Nodes are 0..n-1. Edge lists are arrays u, v, w in the order in which ties are broken. Trees are given by `father`
(-1 at a root), with leaves first and sons before fathers.
"""

from __future__ import annotations

import heapq
import itertools
import tempfile
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


class Sets:
    """Disjoint sets; the smallest member names its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> int:
        """Root of the union of two roots."""
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return a

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    sets = Sets(n)
    for a, b in zip(u.tolist(), v.tolist()):
        a, b = sets.find(a), sets.find(b)
        if a != b:
            sets.join(a, b)
    return sets.labels()


def segment(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, thres: float, minsize: int, adaptive: bool) -> np.ndarray:
    """Felzenszwalb-Huttenlocher. Edges come by weight; an edge joins two sets if it is within both limits; then a set's limit is
    its last weight plus thres over its size (or stays). Last, sets under minsize join a neighbour, in edge order."""
    sets = Sets(n)
    limit = [float(thres)] * n
    edges = list(zip(u.tolist(), v.tolist(), w.tolist()))
    for a, b, weight in edges:
        a, b = sets.find(a), sets.find(b)
        if a != b and weight <= limit[a] and weight <= limit[b]:
            r = sets.join(a, b)
            limit[r] = weight + thres / sets.size[r] if adaptive else float(thres)
    for a, b, _ in edges:
        a, b = sets.find(a), sets.find(b)
        if a != b and min(sets.size[a], sets.size[b]) < minsize:
            sets.join(a, b)
    return sets.labels()


class Segments:
    """segment() on edges that come in chunks, by weight: memory is that of the nodes, which are as many as the largest number met,
    and of a chunk. Edges that the second pass may need are kept in a file without a name.

    A set whose limit is under the weight of an edge stays as it is to the end of the first pass, since later edges weigh no less; so most
    edges are passed over in bulk. Sets only grow, so the second pass needs no edge between sets of minsize or more."""

    def __init__(self, thres: float, minsize: int, adaptive: bool) -> None:
        self.thres, self.minsize, self.adaptive = float(thres), minsize, adaptive
        self.n, self.flat = 0, True
        self.up, self.size, self.limit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.kept = tempfile.TemporaryFile()

    def _reach(self, n: int) -> None:
        if n > len(self.up):
            more = max(n, 2 * len(self.up)) - len(self.up)
            self.up = np.r_[self.up, np.arange(len(self.up), len(self.up) + more)]
            self.size = np.r_[self.size, np.ones(more, np.int64)]
            self.limit = np.r_[self.limit, np.full(more, self.thres)]
        self.n = max(self.n, n)

    def _flatten(self) -> None:
        while not self.flat:
            higher = self.up[self.up]
            self.flat = bool((higher == self.up).all())
            self.up = higher

    def _join(self, u: np.ndarray, v: np.ndarray, w: np.ndarray | None) -> None:
        """The edges one by one; without weights by size."""
        up, size, limit, thres, minsize, adaptive = memoryview(self.up), memoryview(self.size), memoryview(self.limit), self.thres, self.minsize, self.adaptive
        for a, b, weight in zip(u.tolist(), v.tolist(), itertools.repeat(0.0) if w is None else w.tolist()):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b and (min(size[a], size[b]) < minsize if w is None else weight <= limit[a] and weight <= limit[b]):
                if a > b:
                    a, b = b, a
                up[b] = a
                size[a] += size[b]
                self.flat = False
                if w is not None:
                    limit[a] = weight + thres / size[a] if adaptive else thres

    def add(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        if not len(u):
            return
        self._reach(int(max(u.max(), v.max())) + 1)
        self._flatten()
        a, b = self.up[u], self.up[v]
        apart = (a != b) & ~((self.limit[a] < w[0]) | (self.limit[b] < w[0]))
        self._join(a[apart], b[apart], w[apart])
        self._flatten()
        a, b = self.up[a], self.up[b]
        later = (a != b) & (np.minimum(self.size[a], self.size[b]) < self.minsize)
        self.kept.write(np.column_stack([a[later], b[later]]).tobytes())

    def labels(self, chunk: int) -> np.ndarray:
        self.kept.seek(0)
        while block := self.kept.read(16 * chunk):
            self._flatten()
            a, b = self.up[np.frombuffer(block, np.int64).reshape(-1, 2)].T
            some = (a != b) & (np.minimum(self.size[a], self.size[b]) < self.minsize)
            self._join(a[some], b[some], None)
        self._flatten()
        self.kept.close()
        return self.up[: self.n]


@dataclass
class Tree:
    """A binary merge tree. edge[z] is the index of the edge that made node z, -1 at leaves; sons are sorted."""

    n: int
    father: np.ndarray
    level: np.ndarray
    edge: np.ndarray
    sons: np.ndarray  # (nodes, 2), -1 at leaves

    def fold(self, leaf: np.ndarray, combine) -> np.ndarray:
        """Values bottom-up: combine(node, value of son, value of son)."""
        out = list(leaf)
        for z, (a, b) in enumerate(self.sons[self.n :].tolist(), self.n):
            out.append(combine(z, out[a], out[b]))
        return np.array(out)


def merge_tree(n: int, u: np.ndarray, v: np.ndarray, level: np.ndarray, order: np.ndarray) -> Tree:
    """Kruskal in the given order; each edge that joins two sets makes a node whose level is the edge's."""
    sets, top = Sets(n), list(range(n))
    father, levels, edge, sons = [-1] * n, [0] * n, [-1] * n, [(-1, -1)] * n
    us, vs, ls = u.tolist(), v.tolist(), level.tolist()
    for e in order.tolist():
        a, b = sets.find(us[e]), sets.find(vs[e])
        if a == b:
            continue
        x, y = sorted((top[a], top[b]))
        z = len(father)
        father[x] = father[y] = z
        father.append(-1)
        levels.append(ls[e])
        edge.append(e)
        sons.append((x, y))
        top[sets.join(a, b)] = z
    return Tree(n, np.array(father), np.array(levels), np.array(edge), np.array(sons).reshape(-1, 2))


def areas(t: Tree) -> np.ndarray:
    return t.fold(np.ones(t.n, np.int64), lambda z, a, b: a + b)


def spans(t: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the leaves in which those under any node are neighbours, and of every node the place of the first and their number."""
    area = areas(t)
    size, first = area.tolist(), [0] * len(area)
    upto = 0
    for z in range(len(first) - 1, -1, -1):
        if t.father[z] < 0:
            first[z] = upto
            upto += size[z]
        if z >= t.n:
            a, b = t.sons[z]
            first[a], first[b] = first[z], first[z] + size[a]
    order = np.empty(t.n, np.int64)
    order[first[: t.n]] = np.arange(t.n)
    return order, np.array(first, np.int64), area


def scales(t: Tree, weight: np.ndarray) -> np.ndarray:
    """Observation scale of each node: a merge at weight m asks of each son s for (m - weight of s) * area of s, cut to an
    integer, and scales never fall upwards."""
    area = areas(t)
    k = np.zeros(len(t.father), np.int64)
    for z in range(t.n, len(k)):
        k[z] = max(max(int((weight[z] - weight[s]) * area[s]), k[s]) for s in t.sons[z])
    return k


def attribute(t: Tree, mode: str) -> np.ndarray:
    """surface, volume, dynamic or omega of each node."""
    level = t.level.astype(float)
    if mode == "surface":
        return areas(t).astype(float)
    if mode == "volume":
        area, out = areas(t), np.zeros(len(level))
        for z in range(t.n, len(level)):
            out[z] = sum(out[s] + area[s] * (level[z] - level[s]) for s in t.sons[z])
        return out
    inner = t.level.tolist()
    if mode == "dynamic":
        low = t.fold(np.zeros(t.n), lambda z, a, b: min(a, b))
        above = np.where(t.father >= 0, level[t.father], level)
        return above - low
    if mode == "omega":
        none = float("inf")
        low = t.fold(np.full(t.n, none), lambda z, a, b: min(a, b, inner[z]))
        high = t.fold(np.full(t.n, -none), lambda z, a, b: max(a, b, inner[z]))
        return np.where(np.isfinite(low), high - low, 0.0)
    raise ValueError(f"unknown attribute: {mode}")


def filtered(t: Tree, u: np.ndarray, v: np.ndarray, mode: str) -> tuple[Tree, np.ndarray]:
    """The tree of the spanning edges in the order of the smaller attribute of the two sides that each joins, and that value
    for every node (leaves 0). Ties keep the order of the tree."""
    attr = attribute(t, mode)
    value = attr[t.sons[t.n :]].min(axis=1) if len(attr) > t.n else np.zeros(0)
    spanning = t.edge[t.n :]
    order = np.argsort(value, kind="stable")
    out = merge_tree(t.n, u[spanning], v[spanning], t.level[t.n :], order)
    by_node = np.r_[np.zeros(t.n), value[out.edge[out.n :]]]
    out.edge[out.n :] = spanning[out.edge[out.n :]]
    return out, by_node


def lowest_common(father: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest common ancestor of each pair, -1 if there is none: binary lifting, for all pairs at once."""
    n = len(father)
    up = [np.where(father < 0, n, father)]
    up[0] = np.r_[up[0], n]
    while (up[-1] != n).any():
        up.append(up[-1][up[-1]])
    depth = np.zeros(n + 1, np.int64)
    for z in range(n - 1, -1, -1):
        depth[z] = depth[father[z]] + 1 if father[z] >= 0 else 1
    a, b = a.copy(), b.copy()
    for k in reversed(range(len(up))):
        for x, y in ((a, b), (b, a)):
            deeper = depth[x] - depth[y] >= 1 << k
            x[deeper] = up[k][x[deeper]]
    for k in reversed(range(len(up))):
        apart = (a != b) & (up[k][a] != up[k][b])
        a[apart], b[apart] = up[k][a[apart]], up[k][b[apart]]
    top = np.where(a == b, a, up[0][a])
    return np.where(top == n, -1, top)


def flattened(t: Tree, band: np.ndarray, least_area: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that stay, father of each by its old number): an inner node goes if its band is that of the node it hangs on, or
    if it has fewer than least_area leaves; its sons then hang on that node. Leaves and roots stay."""
    area, above = areas(t), t.father.copy()
    stays = np.ones(len(above), bool)
    for z in range(len(above) - 1, t.n - 1, -1):
        f = int(above[z])
        if f >= 0 and (band[z] == band[f] or area[z] < least_area):
            stays[z] = False
            above[t.sons[z]] = f
    return np.flatnonzero(stays), above


def leaves(father: np.ndarray) -> np.ndarray:
    inner = np.zeros(len(father), bool)
    inner[father[father >= 0]] = True
    return np.flatnonzero(~inner)


def _cut(father: np.ndarray, near_leaves: np.ndarray) -> list[int]:
    """Nodes on another side than their father, and leaves on the root's side; the roots if there is none."""
    at = set(np.flatnonzero((father >= 0) & (near_leaves[father] != near_leaves)).tolist())
    at |= {int(x) for x in leaves(father) if not near_leaves[x]}
    return sorted(at) if at else np.flatnonzero(father < 0).tolist()


def _marked(father: np.ndarray, weight: np.ndarray, leaf_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree with a marker under each leaf and one over the root: edges (u, v, w), and the side of each node (1 leaf
    markers, 0 root marker, -1 the rest). Edge i leads up from node i."""
    m, leaf = len(father), leaves(father)
    side = np.full(m + 1 + len(leaf), -1)
    side[m], side[m + 1 :] = 0, 1
    u = np.r_[np.arange(m), leaf]
    v = np.r_[np.where(father < 0, m, father), m + 1 + np.arange(len(leaf))]
    return u, v, np.r_[weight, np.full(len(leaf), leaf_weight)], side


def cut_kruskal(father: np.ndarray, weight: np.ndarray) -> list[int]:
    """Two-label cut by a maximum spanning forest rooted in the markers."""
    u, v, w, side = _marked(father, weight, 1.0)
    sets, mark = Sets(len(side)), side.tolist()
    for e in np.argsort(-w, kind="stable").tolist():
        a, b = sets.find(int(u[e])), sets.find(int(v[e]))
        if a != b and (mark[a] < 0 or mark[b] < 0):
            mark[sets.join(a, b)] = max(mark[a], mark[b])
    return _cut(father, np.array([mark[sets.find(i)] == 1 for i in range(len(father))]))


def cut_prim(father: np.ndarray, weight: np.ndarray) -> list[int]:
    """The same cut, grown from the markers over the nearest edge (key 1 - weight, 0 at leaf markers). Weights lie in [0, 1]."""
    if len(weight) and (weight.min() < 0 or weight.max() > 1):
        raise ValueError("weights must lie in [0, 1]")
    u, v, w, side = _marked(father, weight, 1.0)
    at: list[list[int]] = [[] for _ in side]
    for e, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        at[a].append(e)
        at[b].append(e)
    heap = [(1 - w[e], e) for x in np.flatnonzero(side >= 0) for e in at[x]]
    heapq.heapify(heap)
    while heap:
        _, e = heapq.heappop(heap)
        a, b = int(u[e]), int(v[e])
        if (side[a] < 0) == (side[b] < 0):
            continue
        x, y = (a, b) if side[a] < 0 else (b, a)
        side[x] = side[y]
        for f in at[x]:
            heapq.heappush(heap, (1 - w[f], f))
    return _cut(father, side[: len(father)] == 1)


def laplacian_solve(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, known: dict[int, float]) -> np.ndarray:
    """Random walker: harmonic values with the given ones fixed; dense for few unknowns, else conjugate gradients."""
    x = np.full(n, np.nan)
    for i, value in known.items():
        x[i] = value
    free = np.flatnonzero(np.isnan(x))
    if not len(free):
        return x
    place = np.full(n, -1)
    place[free] = np.arange(len(free))
    diagonal, right = np.zeros(len(free)), np.zeros(len(free))
    inner = (place[u] >= 0) & (place[v] >= 0)
    for a, b in ((u, v), (v, u)):
        mine = place[a] >= 0
        np.add.at(diagonal, place[a[mine]], w[mine])
        edge = mine & (place[b] < 0)
        np.add.at(right, place[a[edge]], w[edge] * x[b[edge]])
    p, q, c = place[u[inner]], place[v[inner]], w[inner]
    if len(free) <= 1500:
        m = np.diag(diagonal)
        np.add.at(m, (p, q), -c)
        np.add.at(m, (q, p), -c)
        x[free] = np.linalg.solve(m, right)
        return x

    def times(y: np.ndarray) -> np.ndarray:
        out = diagonal * y
        np.add.at(out, p, -c * y[q])
        np.add.at(out, q, -c * y[p])
        return out

    x[free] = conjugate_gradient(times, right)
    return x


def conjugate_gradient(times, right: np.ndarray, steps: int = 5000, least: float = 1e-12) -> np.ndarray:
    """Solution of a symmetric positive definite system given as a product."""
    x, r = np.zeros_like(right), right.copy()
    p, rr = r.copy(), float(right @ right)
    stop = least * max(rr, 1e-300)
    for _ in range(steps):
        if rr <= stop:
            break
        ap = times(p)
        a = rr / float(p @ ap)
        x += a * p
        r -= a * ap
        now = float(r @ r)
        p, rr = r + now / rr * p, now
    return x


def reconstructed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Geodesic dilation of the weights from the edges at seeds: for each edge the least weight on the best way from a seed
    through it, itself included, that is, the reconstruction of the weights from those edges. nan where no seed reaches."""
    level = np.full(n, -np.inf)
    level[seeds] = np.inf
    at: list[list[int]] = [[] for _ in range(n)]
    for e, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        at[a].append(e)
        at[b].append(e)
    heap = [(-np.inf, int(s)) for s in seeds]
    done = np.zeros(n, bool)
    while heap:
        x = heapq.heappop(heap)[1]
        if done[x]:
            continue
        done[x] = True
        for e in at[x]:
            y = int(v[e]) if u[e] == x else int(u[e])
            through = min(level[x], w[e])
            if through > level[y]:
                level[y] = through
                heapq.heappush(heap, (-through, y))
    best = np.maximum(level[u], level[v])
    return np.where(np.isneginf(best), np.nan, np.minimum(best, w))


def power_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seeds: dict[int, float]) -> np.ndarray:
    """Energy minimiser for q = 2 and the power of the weights going to infinity. Edges go by falling reconstructed weight, so that a
    plateau that no seed is in waits for the level on which one reaches it, and within that by falling weight; a plateau of
    equal ones that meets seeds of two values is solved as a random walk, any other is contracted. Nodes that no seed
    reaches are nan."""
    sets = Sets(n)
    value: dict[int, float] = dict(seeds)
    level = reconstructed(n, u, v, w, np.array(sorted(seeds), np.int64)) if len(w) else w
    order = np.lexsort((-w, -np.nan_to_num(level, nan=-np.inf)))
    changes = (np.diff(w[order]) != 0) | (np.diff(level[order]) != 0)
    ends = np.r_[np.flatnonzero(changes) + 1, len(order)] if len(order) else np.zeros(0, int)
    begin = 0
    for end in ends.tolist():
        edges = [(sets.find(int(u[e])), sets.find(int(v[e]))) for e in order[begin:end]]
        begin = end
        edges = [(a, b) for a, b in edges if a != b and not (a in value and b in value)]
        if not edges:
            continue
        nodes = sorted({x for e in edges for x in e})
        place = {x: i for i, x in enumerate(nodes)}
        a, b = (np.array([place[e[i]] for e in edges]) for i in (0, 1))
        part = components(len(nodes), a, b)
        for label in np.unique(part):
            mine = np.flatnonzero(part == label).tolist()
            known = {i: value[nodes[i]] for i in mine if nodes[i] in value}
            if len(set(known.values())) > 1:
                here = {x: i for i, x in enumerate(mine)}
                some = [k for k in range(len(a)) if part[a[k]] == label]
                x = laplacian_solve(len(mine), np.array([here[a[k]] for k in some]), np.array([here[b[k]] for k in some]), np.ones(len(some)), {here[i]: k for i, k in known.items()})
                for i in mine:
                    value[nodes[i]] = float(x[here[i]])
            else:
                root, seeded = None, next(iter(known.values()), None)
                for i in mine:
                    at = sets.find(nodes[i])
                    root = at if root is None else root if root == at else sets.join(root, at)
                    root = sets.find(root)
                if seeded is not None:
                    value[root] = seeded
    return np.array([value.get(sets.find(i), np.nan) for i in range(n)])


def cut_power(father: np.ndarray, weight: np.ndarray) -> list[int]:
    """Power watershed cut; leaf markers hang on the largest weight, 1 at least. Over 0.5 is the leaves' side."""
    u, v, w, side = _marked(father, weight, max(1.0, float(weight.max()) if len(weight) else 1.0))
    x = power_watershed(len(side), u, v, w, {int(i): float(side[i]) for i in np.flatnonzero(side >= 0)})
    return _cut(father, np.nan_to_num(x[: len(father)]) > 0.5)


def cut_minimum(father: np.ndarray, weight: np.ndarray) -> list[int]:
    """Minimum cut between root and leaves, bottom-up, in units of 1 / 100000. At equal cost the cut lies nearer the leaves."""
    unit = 100_000
    cost = [int(x * unit) for x in weight.tolist()]
    below = [0] * len(father)
    best = [0] * len(father)
    leaf = set(leaves(father).tolist())
    for z in range(len(father)):
        if z in leaf:
            below[z] = unit
        best[z] = min(cost[z], below[z])
        if father[z] >= 0:
            below[father[z]] += best[z]
    out, todo = [], np.flatnonzero(father < 0).tolist()
    sons: list[list[int]] = [[] for _ in father]
    for z, f in enumerate(father.tolist()):
        if f >= 0:
            sons[f].append(z)
    while todo:
        z = todo.pop()
        if z in leaf or cost[z] < below[z]:
            out.append(z)
        else:
            todo += sons[z]
    return sorted(out)


def min_cover(father: np.ndarray, weight: np.ndarray, running: bool = False) -> list[int]:
    """Of each leaf the deepest node on its path that weighs less than its father (running: less than all above), else the root."""
    pick, least = list(range(len(father))), weight.tolist()
    for z in range(len(father) - 1, -1, -1):
        f = father[z]
        if f >= 0:
            against = least[f] if running else weight[f]
            if weight[z] < against:
                pick[z] = z
            else:
                pick[z] = pick[f]
                least[z] = least[f] if running else weight[z]
    return sorted({pick[x] for x in leaves(father).tolist()})


def malis(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, label: np.ndarray, threshold: float, margin: float, pos: bool, neg: bool) -> tuple[float, float, np.ndarray]:
    """Loss, share of wrong pairs, and gradient for each edge. Edges join by falling weight (ties in order); each joins all pairs
    of labelled nodes of its two sides, and pays a hinge for those of one label and for those of two. Label 0 is none. Without a pair to
    judge, loss and share are nan and every gradient 0."""
    sets = Sets(n)
    bags = [{int(k): 1} if k else {} for k in label]
    count = np.unique(label[label != 0], return_counts=True)[1]
    labelled = int(count.sum())
    same = int((count * (count - 1) // 2).sum())
    norm = same * pos + (labelled * (labelled - 1) // 2 - same) * neg
    if not norm:
        return float("nan"), float("nan"), np.zeros(len(w))
    loss, wrong, slope = 0.0, 0, np.zeros(len(w))
    for e in np.argsort(-w, kind="stable").tolist():
        a, b = sets.find(int(u[e])), sets.find(int(v[e]))
        if a == b:
            continue
        x, y = bags[a], bags[b]
        alike = sum(c * y.get(k, 0) for k, c in x.items())
        unlike = sum(x.values()) * sum(y.values()) - alike
        above = float(w[e]) - threshold
        if pos and alike:
            wrong += alike * (above <= 0)
            loss += alike * max(0.0, margin - above)
            slope[e] -= alike * (margin - above > 0)
        if neg and unlike:
            wrong += unlike * (above > 0)
            loss += unlike * max(0.0, margin + above)
            slope[e] += unlike * (margin + above > 0)
        small, large = sorted((x, y), key=len)
        for k, c in small.items():
            large[k] = large.get(k, 0) + c
        r = sets.join(a, b)
        bags[a] = bags[b] = {}
        bags[r] = large
    return loss / norm, wrong / norm, slope / norm


def neighbours(height: int, width: int, connex: int) -> list[tuple[int, int]]:
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    return near + [(1, 1), (1, -1), (-1, 1), (-1, -1)] if connex == 8 else near


def reconstruct_by_erosion(image: np.ndarray, height: int, connex: int) -> np.ndarray:
    """The h-minima filter: minima shallower than `height` are filled."""
    return lowered(image.astype(np.int64) + height, image, connex)


def lowered(start: np.ndarray, floor: np.ndarray, connex: int) -> np.ndarray:
    """Reconstruction by erosion: `start`, nowhere under `floor`, sinks along every path as far as the floor on it allows."""
    h, w = floor.shape
    out = start.astype(np.int64)
    heap = [(int(out[y, x]), y, x) for y in range(h) for x in range(w)]
    heapq.heapify(heap)
    done = np.zeros((h, w), bool)
    near = neighbours(h, w, connex)
    while heap:
        level, y, x = heapq.heappop(heap)
        if done[y, x]:
            continue
        done[y, x] = True
        out[y, x] = level
        for dy, dx in near:
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and not done[a, b]:
                new = max(level, int(floor[a, b]))
                if new < out[a, b]:
                    out[a, b] = new
                    heapq.heappush(heap, (new, a, b))
    return out


def height_segments(image: np.ndarray, height: int, connex: int, grown: bool) -> np.ndarray:
    """The regional maxima that stay when peaks lower than `height` are cut off, numbered from 1 in raster order, 0 elsewhere.
    grown: each with the largest component at or above some level that holds no other of them."""
    cut = -reconstruct_by_erosion(-image.astype(np.int64), height, connex)
    label, _ = regional_minima(-cut, connex)
    if not grown:
        return label
    flat, mine = cut.ravel(), label.ravel().tolist()
    parent = component_tree(cut, connex)[0].tolist()
    # number of the one maximum in each component, -1 if there are more
    held = [0] * len(mine)
    for p in np.lexsort((np.arange(flat.size), -flat)).tolist():
        for k, to in ((mine[p], p), (held[p] or mine[p], parent[p])):
            if k and held[to] != k:
                held[to] = k if not held[to] else -1
    named = [p if q == p or flat[q] < flat[p] else q for p, q in enumerate(parent)]
    return np.array([max(held[q], 0) for q in named], np.int64).reshape(image.shape)


def height_opening(image: np.ndarray, height: int, connex: int) -> np.ndarray:
    """Peaks lower than `height` are cut off; of each maximum that then stays the highest peak (the first of equals, in raster
    order) keeps its whole height, and nothing else of it."""
    f = image.astype(np.int64)
    marker = -reconstruct_by_erosion(-f, height, connex)
    label = regional_minima(-marker, connex)[0].ravel()
    order = np.lexsort((np.arange(f.size), -f.ravel(), label))
    order = order[label[order] > 0]
    first = order[np.r_[True, np.diff(label[order]) > 0]] if len(order) else order
    marker.ravel()[first] = f.ravel()[first]
    return -lowered(-marker, -f, connex)


def regional_minima(image: np.ndarray, connex: int) -> tuple[np.ndarray, int]:
    """Minima numbered from 1 in raster order, 0 elsewhere; their number."""
    h, w = image.shape
    out, seen, n = np.zeros((h, w), np.int64), np.zeros((h, w), bool), 0
    near = neighbours(h, w, connex)
    for y in range(h):
        for x in range(w):
            if seen[y, x]:
                continue
            flat, lowest, i = [(y, x)], True, 0
            seen[y, x] = True
            while i < len(flat):
                for dy, dx in near:
                    a, b = flat[i][0] + dy, flat[i][1] + dx
                    if 0 <= a < h and 0 <= b < w:
                        if image[a, b] < image[y, x]:
                            lowest = False
                        elif image[a, b] == image[y, x] and not seen[a, b]:
                            seen[a, b] = True
                            flat.append((a, b))
                i += 1
            if lowest:
                n += 1
                for p in flat:
                    out[p] = n
    return out, n


class Forks:
    """The tree in which basins (nodes 1 to n) meet: each merge at a level makes a node over the trees that it joins."""

    def __init__(self, floors: list[int]) -> None:
        self.level, self.father = [0, *floors], [0] * (len(floors) + 1)

    def root(self, a: int) -> int:
        while self.father[a]:
            a = self.father[a]
        return a

    def merge(self, roots: list[int], level: int) -> int:
        z = len(self.level)
        self.level.append(level)
        self.father.append(0)
        for r in roots:
            self.father[r] = z
        return z

    def line(self, a: int) -> list[int]:
        """a and all above it."""
        out = [a]
        while self.father[out[-1]]:
            out.append(self.father[out[-1]])
        return out

    def lowest(self, nodes: set[int]) -> int:
        """The highest fork of nodes of one tree, or the lowest of them if all lie on one line."""
        above = {a: self.line(a) for a in nodes}
        ends = [a for a in nodes if not any(a in above[b][1:] for b in nodes)]
        if len(ends) == 1:
            return ends[0]
        shared = set(above[ends[0]]).intersection(*(above[a] for a in ends[1:]))
        return next(a for a in above[ends[0]] if a in shared)


def watershed(image: np.ndarray, min_height: int, connex: int, topological: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Markers are the minima deeper than min_height. Pixels are flooded from them by the lowest pass, first come first served.

    topological: a pixel is lowered as far as the lowest passes between all minima allow, to its basin's minimum or to the
    level on which the basins around it meet; it then is a divide, as are those that only divides lead to. No pixel can be
    lowered further. Otherwise a pixel that touches two basins when its turn comes is a divide, which passes no water on;
    divides are thin then, and pixels behind divides alone stay divides, but passes may be lost.
    (value: the pass on divides, the basin's minimum elsewhere; basin, 0 on divides; number of minima)."""
    smooth = reconstruct_by_erosion(image, min_height, connex)
    marker, n = regional_minima(smooth, connex)
    h, w = image.shape
    floors = [int(smooth[marker == k].min()) for k in range(1, n + 1)]
    forks, node = Forks(floors), marker.copy()
    near = neighbours(h, w, connex)
    heap: list[tuple[int, int, int, int]] = []
    turn, queued = 0, marker > 0

    def beside(y: int, x: int) -> Iterator[tuple[int, int]]:
        return ((y + dy, x + dx) for dy, dx in near if 0 <= y + dy < h and 0 <= x + dx < w)

    def spread(y: int, x: int, level: int) -> None:
        nonlocal turn
        for a, b in beside(y, x):
            if not queued[a, b]:
                queued[a, b] = True
                heapq.heappush(heap, (max(level, int(smooth[a, b])), turn, a, b))
                turn += 1

    for y, x in np.argwhere(marker > 0).tolist():
        spread(y, x, 0)
    value = np.where(marker > 0, np.array([0, *floors])[marker], smooth)
    while heap:
        level, _, y, x = heapq.heappop(heap)
        around = {int(node[q]) for q in beside(y, x)} - {0}
        if not topological and len(around) > 1:
            value[y, x] = level
            continue
        roots = sorted({forks.root(a) for a in around})
        node[y, x] = z = forks.merge(roots, level) if len(roots) > 1 else forks.lowest(around)
        value[y, x] = forks.level[z]
        spread(y, x, level)
    # what was settled later may let a divide sink further
    todo = deque(sorted(((int(value[y, x]), y, x) for y, x in np.argwhere(node > n).tolist())))
    while todo:
        _, y, x = todo.popleft()
        under = {int(node[q]) for q in beside(y, x) if value[q] < value[y, x]}
        if under and forks.level[z := forks.lowest(under)] < value[y, x]:
            node[y, x], value[y, x] = z, forks.level[z]
            todo.extend((int(value[q]), *q) for q in beside(y, x) if node[q] > n and value[q] > value[y, x])
    return value, np.where(node > n, 0, node), n


#: How many coordinates may differ between neighbours.
REACH = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}


def component_tree(image: np.ndarray, connex: int, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree of the components of pixels at or above each level, of a map (connex 4, 8) or a volume (6, 18, 26): (parent of each
    pixel, area, volume), by raster index.

    Each component is named by the last of its pixels in the order of falling value, then raster; other pixels of its level point to
    it, and it points to the component around it (a root to itself). volume is the sum of values above the parent's. there: which pixels
    are; others are in no component, and their values mean nothing."""
    if (image.ndim == 3) != (connex in (6, 18, 26)):
        raise ValueError(f"no neighbourhood of {connex} in {image.ndim} dimensions")
    flat = image.ravel()
    order = np.lexsort((np.arange(flat.size), -flat))
    if there is not None:
        order = order[there.ravel()[order]]
    up, parent, seen = list(range(flat.size)), np.arange(flat.size), [False] * flat.size
    # a rim of -1 around the pixels spares the test of every neighbour's coordinates
    rimmed = np.pad(np.arange(flat.size).reshape(image.shape), 1, constant_values=-1)
    place, inner = np.flatnonzero(rimmed >= 0).tolist(), rimmed.ravel().tolist()
    strides = [int(np.prod(rimmed.shape[k + 1 :])) for k in range(image.ndim)]
    near = [sum(d * s for d, s in zip(o, strides)) for o in itertools.product((-1, 0, 1), repeat=image.ndim) if 0 < sum(map(abs, o)) <= REACH[connex]]

    def top(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for p in order.tolist():
        seen[p] = True
        for step in near:
            q = inner[place[p] + step]
            if q >= 0 and seen[q]:
                r = top(q)
                if r != p:
                    up[r] = p
                    parent[r] = p
    for p in order[::-1].tolist():  # from the root up: chains of one level point to the pixel nearest the root
        q = parent[p]
        if flat[parent[q]] == flat[q]:
            parent[p] = parent[q]
    area, volume = np.ones(flat.size, np.int64), np.zeros(flat.size)
    for p in order.tolist():
        q = parent[p]
        if q != p:
            volume[p] += area[p] * float(flat[p] - flat[q])
            area[q] += area[p]
            volume[q] += volume[p]
    return parent, area, volume


def peak_rises(image: np.ndarray, connex: int) -> np.ndarray:
    """By raster index: how far each peak stands over the level at which it meets a higher one (infinite for the highest of
    all), 0 at other pixels. Of equal peaks the first in raster order counts as higher."""
    h, w = image.shape
    flat = image.ravel()
    up, seen, rise = list(range(flat.size)), np.zeros(flat.size, bool), np.zeros(flat.size)
    order = np.lexsort((np.arange(flat.size), -flat)).tolist()
    place = {p: i for i, p in enumerate(order)}
    near = neighbours(h, w, connex)

    def top(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for p in order:  # a set is named by its peak
        seen[p] = True
        y, x = divmod(p, w)
        around = {top((y + dy) * w + x + dx) for dy, dx in near if 0 <= y + dy < h and 0 <= x + dx < w and seen[(y + dy) * w + x + dx]}
        peaks = sorted(around | {p}, key=place.get)
        for q in peaks[1:]:
            up[q] = peaks[0]
            rise[q] = float(flat[q] - flat[p])
    rise[order[0]] = np.inf
    return rise
