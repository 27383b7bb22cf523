"""Discrete boosting of depth-1 trees, one round after the other."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .histogram_trees import Chain, Trees


@dataclass
class Stump:
    """A split of one feature: rows up to the threshold (or, by category, in ``left``) say ``low``, others ``high``."""

    feature: int
    threshold: float
    left: list[float] | None
    low: float
    high: float
    weight: float = 0.0


def stump_of(tree: Trees, cuts: list[np.ndarray]) -> tuple[Stump, float]:
    """A tree of depth 1 (or 0) and the share of the weight that it gets wrong."""
    value, root = tree.value(), tree.roots[0]
    if tree.feature[root] < 0:
        said = float(value[root] > 0.5)
        return Stump(0, 0.0, None, said, said), float(min(value[root], 1 - value[root]))
    low, high = tree.left[root], tree.left[root] + 1
    wrong = sum(min(tree.total[k], tree.weight[k] - tree.total[k]) for k in (low, high))
    f = int(tree.feature[root])
    return Stump(f, float(cuts[f][tree.cut[root]]), None, float(value[low] > 0.5), float(value[high] > 0.5)), float(wrong / tree.weight[root])


class Boosted:
    """A chain of stumps. A perfect one or one no better than chance ends it."""

    def __init__(self, rate: float):
        self.rate, self.stumps, self.chain, self.done = rate, [], Chain(), False
        self._trees: Trees | None = None

    def take(self, tree: Trees, cuts: list[np.ndarray]) -> None:
        stump, error = stump_of(tree, cuts)
        self.done = error >= 0.5 or error <= 1e-12
        if error >= 0.5 and self.stumps:
            return
        self.stumps.append(stump)
        self._trees = tree if self._trees is None else self._trees.joined(tree)
        if self.done:
            stump.weight = 0.0 if error >= 0.5 else 1.0
            return
        stump.weight = self.rate * float(np.log((1 - error) / error))
        # The weights keep their sum, so they stay in range over any number of rounds.
        grown = float(np.log(1 - error + error * np.exp(stump.weight)))
        self.chain = replace(self.chain.added(tree), steps=[*self.chain.steps, stump.weight], log_sum=self.chain.log_sum + grown)

    def trees(self) -> Trees:
        return self._trees if self._trees is not None else Trees.planted(0)
