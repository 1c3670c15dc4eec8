"""Weak supervision: how accurate overlapping voters are, estimated from how they agree.

A voter says good (1), bad (-1) or abstains (0). Rows with the same votes are alike, so expectation-maximisation needs
only the number of rows of each vote pattern: at most 3 to the power of the number of voters, however many rows there
are. That table is counted over all rows and is all that reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Rounds at most, and the change of the prior at which rounds end.
ROUNDS, SETTLED = 200, 1e-9
#: Pseudo-counts: a voter is taken to be right in PRIOR_RIGHT of this many earlier votes.
PSEUDO, PRIOR_RIGHT = 10.0, 0.8
#: The first posterior of rows with no, one, and more bad votes.
BELIEF = (0.95, 0.6, 0.1)


@dataclass(frozen=True)
class LabelModel:
    """Log-odds of good: `bias`, plus `weights[j][vote]` of each voter."""

    bias: float
    weights: tuple[dict[int, float], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = self.bias + sum(w[v] for w, v in zip(self.weights, votes))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def accuracies(self) -> list[float]:
        """Accuracy of each voter when it votes and classes are even."""
        return [1 / (1 + math.exp(-(w[1] - w[-1]) / 2)) for w in self.weights]


def fit(patterns: dict[tuple[int, ...], int], n_voters: int) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    A voter has one accuracy for each class; abstaining says nothing. Most voters look for one kind of fault and find the
    others good, so bad votes that agree say more than good ones: the first posterior is BELIEF by the number of bad
    votes. Pseudo-counts say that voters are better than chance, which keeps `good` the name of the same class. Without
    rows, or without votes, every posterior is even but for that prior.
    """
    rows = [(v, n, BELIEF[min(v.count(-1), len(BELIEF) - 1)] if any(v) else 0.5) for v, n in sorted(patterns.items())]
    bias, weights = 0.0, tuple({1: 0.0, 0: 0.0, -1: 0.0} for _ in range(n_voters))
    prior = 0.5
    for _ in range(ROUNDS):
        total = sum(n for _, n, _ in rows)
        new_prior = (sum(n * p for _, n, p in rows) + PSEUDO / 2) / (total + PSEUDO)
        found = []
        for j in range(n_voters):
            good_good = sum(n * p for v, n, p in rows if v[j] == 1) + PSEUDO * PRIOR_RIGHT
            good_bad = sum(n * p for v, n, p in rows if v[j] == -1) + PSEUDO * (1 - PRIOR_RIGHT)
            bad_good = sum(n * (1 - p) for v, n, p in rows if v[j] == 1) + PSEUDO * (1 - PRIOR_RIGHT)
            bad_bad = sum(n * (1 - p) for v, n, p in rows if v[j] == -1) + PSEUDO * PRIOR_RIGHT
            right, wrong = good_good / (good_good + good_bad), bad_good / (bad_good + bad_bad)
            found.append({1: math.log(right / wrong), 0: 0.0, -1: math.log((1 - right) / (1 - wrong))})
        bias, weights = math.log(new_prior / (1 - new_prior)), tuple(found)
        model = LabelModel(bias, weights)
        rows = [(v, n, model.posterior(v)) for v, n, _ in rows]
        if abs(new_prior - prior) < SETTLED:
            break
        prior = new_prior
    return LabelModel(bias, weights)


def encode(votes: tuple[int, ...]) -> int:
    """Votes as one number in base three."""
    code = 0
    for v in reversed(votes):
        code = 3 * code + v + 1
    return code


def decode(code: int, n_voters: int) -> tuple[int, ...]:
    votes = []
    for _ in range(n_voters):
        votes.append(code % 3 - 1)
        code //= 3
    return tuple(votes)
