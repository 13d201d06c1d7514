"""Plain version of the search of a cluster tree (M1-M7, T9, T10): one sample, node by node."""

from __future__ import annotations

import math
import statistics
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from seqlake.operators.tree_search import PRESETS, Preset


@dataclass
class Node:
    id: int
    parent: int | None
    children: tuple[int, ...]
    category: str  # 0 weak, 1, 2; o1, o2 where rebuilt
    length: int = 0
    cov: float = 0.0
    ab: float = 0.0
    access: int = 0
    path_ab: float = 0.0
    path_cov: float = 0.0
    seen: bool = False


@dataclass
class Found:
    cluster: int
    ab: float
    cov: float
    covered: float
    total: int
    share: float = 0.0
    how: str = field(default="accepted")


def noise_probability(n: int, least: int, p: float = 0.005) -> float:
    """P(X >= least), X ~ Bin(n, p)."""
    if least > n:
        return 0.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if least <= n * p:
        return 1 - math.fsum(math.exp(log(i)) for i in range(least))
    terms, i = [], least  # beyond the mean they fall faster than a geometric series
    while i <= n and (not terms or terms[-1] > 1e-18 * terms[0]):
        terms.append(math.exp(log(i)))
        i += 1
    return math.fsum(terms)


def poisson_quantiles(mean: float, n: int) -> list[int]:
    """Poisson values at the middle of n equal shares: the reproducible form of n sorted draws (M4)."""
    out, k, at = [], 0, math.exp(-mean)
    for i in range(n):
        while at < (i + 0.5) / n and k < 10 * mean + 50:
            k += 1
            at += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else 0.0
        out.append(k)
    return out


def corrected(rows: list[tuple[int, frozenset[int]]], leaves: list[Node], least: int = 1000) -> tuple[str, int, float, float]:
    """(category, length, cov, ab) of a rebuilt node after M3 or M4. rows: count of each of its k-mers, and the leaves that have it.

    After M3 the node counts as one that was not rebuilt. M4 takes the accepted leaves one by one, the most abundant first."""
    ids = {n.id for n in leaves}
    own = [c for c, of in rows if not ids & of]
    if len(own) >= max(1, least):
        good = [c for c in own if c > 0]
        good = [c for c in good if c < 100 * statistics.median(good)]
        return "1" if len(own) < 3 * least else "2", len(own), len(good) / len(own), statistics.fmean(good) if good else 0.0
    left = [c for c, _ in rows]
    for n in sorted(leaves, key=lambda n: (-n.path_ab, n.id)):
        at = sorted((i for i, (_, of) in enumerate(rows) if n.id in of and left[i] > 0), key=lambda i: left[i])
        for i, taken in zip(at, poisson_quantiles(n.ab, len(at)), strict=True):
            left[i] = max(0, left[i] - taken)
    good = [c for c in left if c > 0]
    return "o1" if len(rows) < 3 * least else "o2", len(rows), len(good) / len(rows) if rows else 0.0, statistics.fmean(good) if good else 0.0


class Search:
    """One search; nodes by id. correct(node, accepted leaves) gives (category, length, cov, ab) of a rebuilt node after M3/M4."""

    def __init__(self, nodes: dict[int, Node], preset: Preset, correct: Callable[[Node, list[Node]], tuple[str, int, float, float]] | None = None):
        self.nodes, self.preset, self.correct = nodes, preset, correct
        self.accepted: list[int] = []
        self.rejected: list[int] = []
        self.qualified: list[int] = []

    def sibling(self, n: Node) -> Node | None:
        return next((self.nodes[c] for c in self.nodes[n.parent].children if c != n.id), None) if n.parent is not None else None

    def unique_path(self, n: Node) -> list[Node]:
        """n and the nodes above it, up to the first whose sibling was reached (C11)."""
        out = [n]
        while n.parent is not None:
            s = self.sibling(n)
            if s is not None and s.access in (1, 2):
                break
            n = self.nodes[n.parent]
            out.append(n)
        return out

    def weighted(self, path: list[Node]) -> tuple[float, float, float, int]:
        """(abundance, coverage, covered, k-mers) of a path."""
        total = sum(x.length for x in path)
        covered = sum(x.cov * x.length for x in path)
        return (sum(x.ab * x.cov * x.length for x in path) / covered if covered else 0.0), (covered / total if total else 0.0), covered, total

    def above(self, n: Node) -> tuple[float, int]:
        path = self.unique_path(self.nodes[n.parent]) if n.parent is not None else []
        ab, _, _, total = self.weighted(path)
        return ab, total

    def run(self) -> list[Found]:
        root = next(n for n in self.nodes.values() if n.parent is None)
        groups: list[tuple[int, ...]] = [(root.id,)]
        while groups:  # a level at a time: leaves of one level don't correct each other
            self.above_leaves, below = [self.nodes[i] for i in self.accepted], deque()
            for g in groups:
                self.pair([self.nodes[i] for i in g], below)
            groups = list(below)
        return self.result()

    def pair(self, group: list[Node], below: deque) -> None:
        flagged, kind = False, {}
        weak = any(n.category == "0" for n in group)
        first, rest = [], []
        for n in group:
            cutoff, n.seen = self.preset.cov, True
            if n.category == "0":
                n.ab = n.cov = 0.0
                n.length, n.access = 0, 2
                first.append(n)
            else:
                if n.category in ("1", "o1"):
                    cutoff /= 2
                if n.category[0] == "o" and self.above_leaves and self.correct:
                    n.category, n.length, n.cov, n.ab = self.correct(n, self.above_leaves)
                    flagged = flagged or not weak
                elif n.category[0] == "o":
                    n.category = n.category[1]
                if n.length == 0:
                    n.ab = n.cov = 0.0
                    first.append(n)
                if n.cov < cutoff:
                    n.ab = 0.0
            if n.ab < self.preset.ab:
                n.ab = 0.0
            kind[n.id] = n.category if n.length else "0"
        if flagged and len(group) == 2:
            self.shared_out(*group, kind)
        for n in group:
            if n.parent is not None and n.cov >= 0.95:
                self.qualified.append(n.id)
        ab = {n.id: round(n.ab) for n in group}  # half to even
        order = sorted(group, key=lambda n: (-ab[n.id], -n.id))  # the larger first; of equals the later
        keep = [n for n in order if ab[n.id] and n.category != "0"]
        if len(group) == 2 and not noise_probability(sum(ab.values()), min(ab.values())) < 0.05:
            keep = [n for n in keep if n is order[0]]
        for n in keep:
            n.access = 1
        for n in keep:
            if not n.children:
                self.leaf(n)
        rest = [n for n in keep if n not in first]
        below.extend(n.children for n in first + rest if n.children)

    def shared_out(self, x: Node, y: Node, kind: dict[int, str]) -> None:
        """Abundances of rebuilt siblings from what is above them (M5)."""
        ab, total = self.above(x)
        if total < 1000 or ab <= self.preset.ab:
            return
        kinds = {kind[x.id], kind[y.id]}
        if kinds in ({"o1"}, {"o2"}):
            whole = x.ab + y.ab
            if whole:
                x.ab, y.ab = ab * x.ab / whole, ab * y.ab / whole
        elif "0" in kinds or kinds in ({"o1", "o2"}, {"o1", "2"}, {"o2", "2"}):
            low, high = (x, y) if kind[x.id] in ("0", "o1") or kind[y.id] == "2" else (y, x)
            low.ab = max(0.0, ab - high.ab)

    def leaf(self, n: Node) -> None:
        n.path_ab, n.path_cov, _, _ = self.weighted(self.unique_path(n))
        if n.path_cov >= self.preset.path_cov and n.path_ab > 1:  # M6
            self.accepted.append(n.id)
        else:
            n.access = 0
            self.rejected.append(n.id)

    def result(self) -> list[Found]:
        how, ids = "accepted", self.accepted
        if not ids and self.rejected:  # T9: the rejected leaf whose path is covered best, if its whole line is good enough
            best = max(self.rejected, key=lambda i: (self.nodes[i].path_cov, -i))
            ab, cov, _, _ = self.weighted([self.nodes[i] for i in self.line(self.nodes[best])])
            if self.nodes[best].path_cov >= 0.1 and cov >= 0.1 and ab > 1:
                how, ids = "rejected", [best]
        if not ids and self.qualified:  # T10: the best leaf that was reached under the last well covered node
            leaves = [n for n in self.nodes.values() if not n.children and n.seen and self.qualified[-1] in self.line(n)]
            if leaves:
                how, ids = "qualified", [max(leaves, key=lambda n: (n.cov, -n.id)).id]
        for n in self.nodes.values():
            n.access = 0
            if not n.seen:
                n.length = 0
        for i in ids:
            for j in self.line(self.nodes[i]):
                self.nodes[j].access = 1
        out = []
        for i in ids:
            ab, cov, covered, total = self.weighted(self.unique_path(self.nodes[i]))
            out.append(Found(i, ab, cov, covered, total, how=how))
        whole = sum(f.ab for f in out)
        for f in out:
            f.share = f.ab / whole if whole else 0.0  # A13
        return out

    def line(self, n: Node) -> list[int]:
        out = [n.id]
        while n.parent is not None:
            n = self.nodes[n.parent]
            out.append(n.id)
        return out


def search(make: Callable[[], dict[int, Node]], level: int = 0, correct=None) -> list[Found]:
    """Search with the presets of a level, the next looser one where nothing is found (M7)."""
    for preset in PRESETS[level]:
        found = Search(make(), preset, correct).run()
        if found:
            return found
    return []
