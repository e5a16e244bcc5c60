"""Merging the groups of one block matrix, and groups of groups, by description length.

A matrix of edge counts between document groups (rows) and word groups (columns) is all that is
needed, so a task holds as many numbers as a sector has pairs of groups, whatever its documents.
Greedy merging goes from the given groups down to one per side and keeps the costs of every step.
Above the bottom level the counts between groups are described by a model of the same kind, so
each level costs its partition and the counts inside its blocks (Peixoto 2014).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's approximation of ln n!, 0 for n = 0, as for the flat description length."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 1e-300)
    return np.where(n > 0, n * np.log(safe) - n + np.log(safe * (2 * np.pi)) / 2, 0.0)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(np.asarray(n, float) - k)


def _entropy(e: np.ndarray) -> np.ndarray:
    return np.where(e > 0, e * np.log(np.maximum(e, 1e-300)), 0.0)


def bottom_cell(rows: np.ndarray, columns: np.ndarray, e: np.ndarray) -> np.ndarray:
    """What a block of edges costs apart from its groups' degrees."""
    return -_entropy(e)


def upper_cell(rows: np.ndarray, columns: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The counts between ``rows`` x ``columns`` lower groups that sum up to ``e``."""
    return log_choose(rows * columns + e - 1, e)


def no_margin(e: np.ndarray) -> np.ndarray:
    return np.zeros_like(e, float)


def partition_cost(sizes: np.ndarray) -> float:
    n, groups = float(np.sum(sizes)), len(sizes)
    return float(log_factorial(n) - log_factorial(sizes).sum() + log_choose(n - 1, groups - 1))


@dataclass
class Merging:
    """Groups under merging: the matrix, the sizes of both sides' groups, and the costs of all pairs."""

    edges: np.ndarray
    sizes: list[np.ndarray]
    cell: Callable
    margin: Callable
    pairs: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.edges = self.edges.astype(float)
        self.sizes = [np.asarray(s, float) for s in self.sizes]
        self.members = [[[i] for i in range(n)] for n in self.edges.shape]
        self.pairs = [sum((self._inner(side, k) for k in range(self.edges.shape[1 - side])), 0.0) for side in (0, 1)]

    def _sided(self, side: int) -> np.ndarray:
        return self.edges if side == 0 else self.edges.T

    def _inner(self, side: int, k: int) -> np.ndarray:
        """What merging each pair of this side's groups costs in the cells of the other side's group k."""
        line, own, other = self._sided(side)[:, k], self.sizes[side], self.sizes[1 - side][k]
        single = self.cell(own, other, line)
        return self.cell(own[:, None] + own, other, line[:, None] + line) - single[:, None] - single

    def cost(self) -> float:
        """The description with all counts between these groups told at once."""
        sizes = self.sizes
        cells = self.cell(sizes[0][:, None], sizes[1], self.edges).sum()
        margins = self.margin(self.edges.sum(1)).sum() + self.margin(self.edges.sum(0)).sum()
        return float(cells + margins + partition_cost(sizes[0]) + partition_cost(sizes[1]) + self.flat())

    def flat(self) -> float:
        return float(log_choose(self.edges.size + self.edges.sum() - 1, self.edges.sum()))

    def _best(self, side: int) -> tuple[float, int, int, int]:
        sizes, sums = self.sizes[side], self._sided(side).sum(1)
        groups, n, total = len(sizes), self.sizes[side].sum(), self.edges.sum()
        if groups < 2:
            return np.inf, side, 0, 0
        margins, factorials = self.margin(sums), log_factorial(sizes)
        change = self.pairs[side] + self.margin(sums[:, None] + sums) - margins[:, None] - margins
        change = change + factorials[:, None] + factorials - log_factorial(sizes[:, None] + sizes)
        cells = self.edges.size
        change = change + log_choose(n - 1, groups - 2) - log_choose(n - 1, groups - 1)
        change = change + log_choose(cells - cells // groups + total - 1, total) - log_choose(cells + total - 1, total)
        change[np.tril_indices(groups)] = np.inf
        i, j = divmod(int(np.argmin(change)), groups)
        return float(change[i, j]), side, i, j

    def step(self) -> None:
        """Merge the pair of groups that costs least."""
        _, side, i, j = min(self._best(0), self._best(1))
        across = 1 - side
        self.pairs[across] = self.pairs[across] - self._inner(across, i) - self._inner(across, j)
        own = self._sided(side)
        own[i] += own[j]
        self.edges = np.delete(self.edges, j, side)
        self.sizes[side][i] += self.sizes[side][j]
        self.sizes[side] = np.delete(self.sizes[side], j)
        self.members[side][i] += self.members[side].pop(j)
        self.pairs[across] = self.pairs[across] + self._inner(across, i)
        kept = np.delete(np.delete(self.pairs[side], j, 0), j, 1)
        own, sizes, other = self._sided(side), self.sizes[side], self.sizes[across]
        single = self.cell(sizes[:, None], other, own).sum(1)
        merged = self.cell((sizes + sizes[i])[:, None], other, own + own[i]).sum(1) - single - single[i]
        kept[i], kept[:, i] = merged, merged
        self.pairs[side] = kept

    @property
    def over(self) -> bool:
        return max(self.edges.shape) == 1

    def labels(self) -> list[np.ndarray]:
        """The new group of every group at the start."""
        out = []
        for groups in self.members:
            label = np.zeros(sum(map(len, groups)), int)
            for k, members in enumerate(groups):
                label[members] = k
            out.append(label)
        return out


def upper_levels(edges: np.ndarray) -> tuple[float, list[list[np.ndarray]]]:
    """The cost of the counts between groups, and per level the group that each group of the level below joins.

    Levels are added as long as they shorten the description; a last level of one group per side isn't listed.
    """
    total, levels = 0.0, []
    while True:
        merging = Merging(edges, [np.ones(n) for n in edges.shape], upper_cell, no_margin)
        flat = merging.flat()
        best = (flat, None, None)
        while not merging.over:
            merging.step()
            cost = merging.cost()
            if cost < best[0] - 1e-9 and not merging.over:
                best = (cost, merging.labels(), merging.edges.copy())
        if best[1] is None:
            return total + flat, levels
        cost, labels, above = best
        levels.append(labels)
        # What the level above describes instead of telling all its counts at once.
        total += cost - float(log_choose(above.size + above.sum() - 1, above.sum()))
        edges = above


def nested_groups(edges: np.ndarray, documents: np.ndarray, words: np.ndarray, patience: int = 3):
    """``(length, levels)``: merged groups of the shortest nested description.

    ``levels`` lists, from the bottom, the new labels of both sides' groups of the level below. The
    flat description's best step is the start; finer steps are taken as long as the nested one shortens.
    """
    merging = Merging(edges, [documents, words], bottom_cell, _entropy)
    trail = [(merging.cost(), merging.flat(), merging.labels(), merging.edges.copy())]
    while not merging.over:
        merging.step()
        trail.append((merging.cost(), merging.flat(), merging.labels(), merging.edges.copy()))
    start = min(range(len(trail)), key=lambda k: (trail[k][0], -k))
    best, waited = None, 0
    for k in range(start, -1, -1):
        cost, flat, labels, matrix = trail[k]
        counts, above = upper_levels(matrix)
        length = cost - flat + counts
        if best is None or length < best[0] - 1e-9:
            best, waited = (length, [labels, *above]), 0
        else:
            waited += 1
            if waited > patience:
                break
    return best
