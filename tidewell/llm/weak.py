"""Weak supervision over vote patterns: expectation-maximisation and a logistic model.

Both work on counts of distinct patterns, of which there are at most
3^labelers however many rows were counted, so they run on the driver.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

#: Votes of a labeler.
NO, ABSTAIN, YES = -1, 0, 1


@dataclass(frozen=True)
class Rates:
    """How often a labeler votes yes and no on rows of the yes and of the no class."""

    yes_if_yes: float
    yes_if_no: float
    no_if_yes: float
    no_if_no: float

    def weight(self, vote: int) -> float:
        """Log likelihood ratio of a vote; an abstention has none."""
        if vote == YES:
            return math.log(self.yes_if_yes / self.yes_if_no)
        return math.log(self.no_if_yes / self.no_if_no) if vote == NO else 0.0


@dataclass(frozen=True)
class VoteModel:
    """Prior of the yes class, and each labeler's rates."""

    prior: float
    rates: tuple[Rates, ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(r.weight(v) for v, r in zip(votes, self.rates, strict=True))

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-700, min(700, self.log_odds(votes)))))


def fit_votes(counts: dict[tuple[int, ...], int], start: tuple[Rates, ...], prior: float = 0.5, rounds: int = 1000, anchor: float = 20.0, known: dict[tuple[int, ...], int] | None = None) -> VoteModel:
    """Labelers' rates by expectation-maximisation.

    counts: rows by vote pattern. start: first guesses, which also say which
    class is which; they stay in as so many rows of each class (``anchor``, a
    fixed number, so that any large table outweighs them). Abstentions carry no
    weight. ``known`` are further rows, of the yes class for certain; they tell
    how labelers vote there, but don't count for the prior. Rounds end when no rate moves any more. Without rows the guesses
    return.
    """
    total, certain = sum(counts.values()), sum((known or {}).values())
    model = VoteModel(prior, start)
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    for _ in range(rounds if total + certain else 0):
        seen = [[0.0] * 4 for _ in start]
        rows = [(pattern, n, model.posterior(pattern)) for pattern, n in counts.items()]
        yes = sum(n * p for _, n, p in rows)
        for pattern, n, p in rows + [(pattern, n, 1.0) for pattern, n in (known or {}).items()]:
            for vote, row in zip(pattern, seen, strict=True):
                if vote:
                    k = 0 if vote == YES else 2
                    row[k] += n * p
                    row[k + 1] += n * (1 - p)
        no = total - yes
        share = lambda got, guess, of: clip((got + anchor * guess) / (of + anchor))
        fitted = VoteModel(
            clip((yes + anchor * prior) / (total + anchor)),
            tuple(Rates(share(a, s.yes_if_yes, yes + certain), share(b, s.yes_if_no, no), share(c, s.no_if_yes, yes + certain), share(d, s.no_if_no, no)) for (a, b, c, d), s in zip(seen, start, strict=True)),
        )
        moved = max(abs(a - b) for f, m in zip(fitted.rates, model.rates, strict=True) for a, b in zip(astuple(f), astuple(m), strict=True))
        model, before = fitted, model
        if max(moved, abs(model.prior - before.prior)) < 1e-7:
            break
    return model


def fit_logistic(rows: list[tuple[tuple[float, ...], float, float]], ridge: float = 1.0, rounds: int = 60) -> list[float]:
    """Weights (bias first) of a logistic model of rows (features, soft label, weight), one weight after another by Newton's step.

    The ridge counts as so many rows, so any large table outweighs it.
    """
    if not rows:
        return []
    inputs = [(1.0, *features) for features, _, _ in rows]
    weights, sums = [0.0] * len(inputs[0]), [0.0] * len(rows)
    for _ in range(rounds):
        most = 0.0
        for k, w in enumerate(weights):
            gradient, curve = -ridge * w, ridge
            for x, z, (_, label, n) in zip(inputs, sums, rows, strict=True):
                if x[k]:
                    p = 1 / (1 + math.exp(-max(-50, min(50, z))))
                    gradient += n * (label - p) * x[k]
                    curve += n * p * (1 - p) * x[k] * x[k]
            step = max(-2.0, min(2.0, gradient / curve))
            weights[k] += step
            sums = [z + step * x[k] for x, z in zip(inputs, sums, strict=True)]
            most = max(most, abs(step))
        if most < 1e-6:
            break
    return weights


def logistic(weights: list[float], features: tuple[float, ...]) -> float:
    return 1 / (1 + math.exp(-max(-50, min(50, weights[0] + sum(w * x for w, x in zip(weights[1:], features, strict=True))))))
