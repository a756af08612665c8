"""A linear-chain conditional random field with two labels: training by gradient, decoding by Viterbi.

A chain is a list of positions, each with the numbers of its features. Label 1 at a position scores the sum of its
features' weights, label 0 nothing; labels that follow each other score a transition, the first one a start.
"""

from typing import NamedTuple

import numpy as np


class Chains(NamedTuple):
    """Chains of one training set, padded to one length: all arithmetic goes over the chains at once."""

    feature: np.ndarray  # numbers of the features of all positions, one after the other
    position: np.ndarray  # the position each belongs to
    place: np.ndarray  # of each position, its place in a table of chains x steps
    shape: tuple
    real: np.ndarray  # that table's cells that are positions
    labels: np.ndarray  # of each position

    @staticmethod
    def of(chains, labels):
        sizes = [len(c) for c in chains]
        steps = max(sizes, default=0)
        place = np.concatenate([np.arange(n) + i * steps for i, n in enumerate(sizes)] or [np.zeros(0)]).astype(np.int64)
        real = np.zeros(len(chains) * steps, bool)
        real[place] = True
        spots = [spot for chain in chains for spot in chain]
        return Chains(
            np.array([f for spot in spots for f in spot], np.int64),
            np.repeat(np.arange(len(spots)), [len(s) for s in spots]),
            place, (len(chains), steps), real.reshape(len(chains), steps),
            np.array([y for ys in labels for y in ys], np.int64),
        )


def likelihood(weights, moves, starts, chains):
    """Log likelihood of the labels and its gradient by weights, transitions and starts (forward and backward pass)."""
    n, steps = chains.shape
    score = np.zeros((n * steps, 2))
    score[chains.place, 1] = np.bincount(chains.position, weights[chains.feature], minlength=len(chains.place))
    score = score.reshape(n, steps, 2)
    real = chains.real
    forward = np.zeros((n, steps, 2))
    backward = np.zeros((n, steps, 2))
    forward[:, 0] = starts + score[:, 0]
    for t in range(1, steps):
        came = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + score[:, t]
        forward[:, t] = np.where(real[:, t, None], came, forward[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = backward[:, t + 1] + score[:, t + 1]
        goes = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
        backward[:, t] = np.where(real[:, t + 1, None], goes, 0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    share = np.exp(forward + backward - total[:, None, None])
    labels = np.zeros(n * steps, np.int64)
    labels[chains.place] = chains.labels
    labels = labels.reshape(n, steps)
    error = (labels - share[..., 1])[real]
    by_weight = np.bincount(chains.feature, error[chains.position], minlength=len(weights))
    pair = np.exp(
        forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
    ) * real[:, 1:, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][real[:, 1:]], labels[:, 1:][real[:, 1:]]), 1)
    first = np.bincount(labels[:, 0], minlength=2)
    value = (score[..., 1] * labels)[real].sum() + (moves * seen).sum() + (starts * first).sum() - total.sum()
    return value, by_weight, seen - pair.sum(axis=(0, 1)), first - share[:, 0].sum(axis=0)


def fit(chains, labels, features, rounds=300, rate=0.3, decay=0.02):
    """Weights, transitions and starts that make the labels likely, with a penalty of ``decay`` / 2 times their squares.

    Chains are not empty. Steps are those of Adam; all is deterministic.
    """
    table = Chains.of(chains, labels)
    at = np.zeros(features + 6)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for k in range(1, rounds + 1):
        _, *parts = likelihood(at[:features], at[features : features + 4].reshape(2, 2), at[features + 4 :], table)
        slope = np.concatenate([p.ravel() for p in parts]) - decay * at
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        at = at + rate * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return at[:features], at[features : features + 4].reshape(2, 2), at[features + 4 :]


def viterbi(scores, moves, starts):
    """The likeliest labels, given each position's score of label 1; on a tie, label 0."""
    if not scores:
        return []
    (m00, m01), (m10, m11) = moves
    low, high = starts[0], starts[1] + scores[0]
    back = []
    for s in scores[1:]:
        low_from, high_from = high + m10 > low + m00, high + m11 > low + m01
        back.append((low_from, high_from))
        low, high = (high + m10 if low_from else low + m00), (high + m11 if high_from else low + m01) + s
    label = int(high > low)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]
