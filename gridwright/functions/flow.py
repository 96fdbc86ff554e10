"""Maximum flows whose capacities may change, without Spark: what already flows is kept."""

from __future__ import annotations

from collections import deque


class Network:
    """Nodes 0..n-1, a source n and a sink n + 1. Arcs come in pairs: e from a to b, e ^ 1 back. left is what an arc can still
    take. Whole capacities give exact flows."""

    def __init__(self, n: int) -> None:
        self.source, self.sink = n, n + 1
        self.out: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.size: list[float] = []
        self.left: list[float] = []

    def arc(self, a: int, b: int, size: float, back: float = 0) -> int:
        """A new arc of that capacity, and of `back` against it; its number."""
        e = len(self.to)
        self.to += [b, a]
        self.size += [size, back]
        self.left += [size, back]
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def reached(self, a: int, b: int = -1) -> dict[int, int]:
        """Nodes that a reaches over arcs with room, each with the arc it is reached by; no further than to b."""
        by, todo = {a: -1}, deque([a])
        while todo and b not in by:
            for e in self.out[todo.popleft()]:
                if self.left[e] > 0 and self.to[e] not in by:
                    by[self.to[e]] = e
                    todo.append(self.to[e])
        return by

    def push(self, a: int, b: int, most: float = float("inf")) -> float:
        """Sends up to `most` from a to b, along shortest paths; returns how much went."""
        sent = 0
        while sent < most and b in (by := self.reached(a, b)):
            path, x = [], b
            while x != a:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            step = min([most - sent, *[self.left[e] for e in path]])
            for e in path:
                self.left[e] -= step
                self.left[e ^ 1] += step
            sent += step
        return sent

    def resize(self, e: int, size: float) -> None:
        """Another capacity for arc e. Flow that no longer fits goes around it, and where it cannot, back to source and sink."""
        self.left[e] += size - self.size[e]
        self.size[e] = size
        over = -self.left[e]
        if over <= 0:
            return
        a, b = self.to[e ^ 1], self.to[e]
        self.left[e] = 0
        self.left[e ^ 1] -= over
        over -= self.push(a, b, over)
        if over > 0 and a != self.source:
            self.push(a, self.source, over)
        if over > 0 and b != self.sink:
            self.push(self.sink, b, over)

    def solve(self) -> tuple[float, set[int]]:
        """(flow, nodes on the source's side: those that the source still reaches). All others are the sink's."""
        self.push(self.source, self.sink)
        flow = sum(self.size[e] - self.left[e] for e in self.out[self.source])
        return flow, set(self.reached(self.source)) - {self.source, self.sink}
