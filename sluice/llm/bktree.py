"""BK-trees over fingerprints, of 64 bits unless a wider mask is given."""

from __future__ import annotations

BITS = (1 << 64) - 1


def hamming(a: int, b: int, bits: int = BITS) -> int:
    """Differing bits of two 64-bit numbers, given signed or unsigned; ``bits`` masks those of wider ones."""
    return ((a ^ b) & bits).bit_count()


class BkTree:
    """Children are keyed by their Hamming distance to the parent.

    By the triangle inequality a fingerprint within ``radius`` of the query lies below an edge
    whose distance differs by at most ``radius`` from the query's distance to the parent.
    """

    def __init__(self, radius: int, bits: int = BITS):
        self.radius, self.bits = radius, bits
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Positions of all stored fingerprints within the radius."""
        found, radius = [], self.radius
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = hamming(self.values[at], value, self.bits)
            if distance <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) > 2 * radius + 1:
                todo.extend(edges[d] for d in range(distance - radius, distance + radius + 1) if d in edges)
            else:
                todo.extend(child for d, child in edges.items() if -radius <= d - distance <= radius)
        return found

    def add(self, value: int) -> int:
        """Store a fingerprint that is not stored yet; its position."""
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != place:
            edges = self.children[at]
            at = edges.setdefault(hamming(self.values[at], value, self.bits), place)
        return place


def forest(values: list[int], radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (value, root) that connect exactly what chains of distances within ``radius`` connect.

    One link at most per value, whatever the number of close pairs.
    """
    tree, parent = BkTree(radius, bits), []

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    for value in values:
        close = tree.near(value)
        parent.append(tree.add(value))
        for at in close:
            parent[root(at)] = root(len(parent) - 1)
    return [(values[at], values[root(at)]) for at in range(len(values)) if root(at) != at]


def crossing(stored: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between two disjoint sets, enough to connect what close pairs across them connect.

    ``stored`` is one tree; every query follows its edges. A query links to each stored fingerprint
    it is close to, unless earlier links already connect the two.
    """
    tree = BkTree(radius)
    for value in stored:
        tree.add(value)
    parent = list(range(len(stored) + len(queries)))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    links = []
    for offset, value in enumerate(queries):
        for at in tree.near(value):
            a, b = root(at), root(len(stored) + offset)
            if a != b:
                parent[a] = b
                links.append((value, stored[at]))
    return links
