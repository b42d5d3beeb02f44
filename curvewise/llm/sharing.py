"""A plan of sums for many sets of terms: what several sets have in common is added up once.

`mine` turns the sets into a graph. Terms that the same sets hold in the same numbers are one
chain of sums. Then the pair of nodes that most sets hold becomes a node of its own in all of
them, again and again, until no two sets share a pair. Every set ends as a list of nodes, and
a node is a term, or the sum of two nodes before it. The plan changes what is computed twice, not
what is computed: any choice of pairs gives the same sums.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

#: Of a set with more shared nodes, pairs are sought among so many that most sets hold.
PAIRED = 64


class Plan:
    """Leaves (term, number), sums of two earlier nodes by depth, and the nodes of each set."""

    def __init__(self, leaves: list[tuple[int, int]], sums: list[tuple[int, int]], sets: list[list[int]]):
        self.terms = np.array([t for t, _ in leaves], np.int64)
        self.times = np.array([c for _, c in leaves], np.int64)
        self.nodes = len(leaves) + len(sums)
        depth = [0] * len(leaves)
        layers: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (a, b) in enumerate(sums, len(leaves)):
            depth.append(1 + max(depth[a], depth[b]))
            layers[depth[k]].append((k, a, b))
        self.layers = [np.array(layers[d], np.int64).T for d in sorted(layers)]
        self.flat = np.array([n for s in sets for n in s], np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)

    @property
    def additions(self) -> int:
        return sum(layer.shape[1] for layer in self.layers) + int(np.maximum(self.sizes - 1, 0).sum())

    def evaluate(self, values: np.ndarray) -> np.ndarray:
        """Sums of all sets, from one row per term and one column per document."""
        rows = np.empty((self.nodes, values.shape[1]), np.int64)
        rows[: self.terms.size] = values[self.terms] * self.times[:, None]
        for node, a, b in self.layers:
            rows[node] = rows[a] + rows[b]
        out = np.zeros((self.sizes.size, values.shape[1]), np.int64)
        some = self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(rows[self.flat], (np.cumsum(self.sizes) - self.sizes)[some], axis=0)
        return out


def mine(bags: list[Counter]) -> Plan:
    """The plan for sets given as numbers by term."""
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, bag in enumerate(bags):
        for leaf in bag.items():
            holders[leaf].append(k)
    leaves = sorted(holders)
    sums: list[tuple[int, int]] = []
    sets: list[set[int]] = [set() for _ in bags]
    held: dict[int, set[int]] = {}
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for node, leaf in enumerate(leaves):
        alike[tuple(holders[leaf])].append(node)

    def add(a: int, b: int) -> int:
        sums.append((a, b))
        return len(leaves) + len(sums) - 1

    for who, nodes in alike.items():
        if len(who) > 1:
            while len(nodes) > 1:  # in a balanced tree, so that the plan stays shallow
                nodes = [add(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
            held[nodes[0]] = set(who)
        for k in who:
            sets[k].update(nodes)
    counts: Counter = Counter()
    for nodes in sets:
        shared = sorted((n for n in nodes if n in held), key=lambda n: (-len(held[n]), n))[:PAIRED]
        counts.update(combinations(sorted(shared), 2))
    heap = [(-c, pair) for pair, c in counts.items() if c > 1]
    heapq.heapify(heap)
    while heap:
        count, (a, b) = heapq.heappop(heap)
        both = held[a] & held[b]
        if len(both) < 2:
            continue
        if len(both) < -count:
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        node = add(a, b)
        held[node] = both
        held[a], held[b] = held[a] - both, held[b] - both
        near: Counter = Counter()
        for k in both:
            near.update(sorted((n for n in sets[k] if n in held and n not in (a, b)), key=lambda n: (-len(held[n]), n))[:PAIRED])
            sets[k] -= {a, b}
            sets[k].add(node)
        for other, c in near.items():
            if c > 1:
                heapq.heappush(heap, (-c, (min(node, other), max(node, other))))
    return Plan(leaves, sums, [sorted(s) for s in sets])
