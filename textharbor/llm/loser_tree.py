"""Merging front-coded sorted runs with a loser tree that knows common prefixes."""

import numpy as np


class _Run:
    """One sorted run: the current string, and how much of it is shared with the one before."""

    __slots__ = ("shared", "sizes", "tails", "at", "byte", "string")

    def __init__(self, shared, sizes, tails):
        self.shared, self.sizes, self.tails = shared, sizes, tails
        self.at, self.byte, self.string = -1, 0, b""

    def advance(self):
        """Go to the next string; its shared length, or -1 at the end."""
        self.at += 1
        if self.at == len(self.sizes):
            self.string = None
            return -1
        shared = self.shared[self.at]
        end = self.byte + self.sizes[self.at] - shared
        self.string = self.string[:shared] + self.tails[self.byte : end]
        self.byte = end
        return shared


def _differ(a, b, at):
    """The first place from ``at`` on where two strings differ, or the length of the shorter."""
    end = min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


def merge_runs(coded):
    """Order of all strings of front-coded runs (shared, sizes, tails), and the prefix each shares with the one before.

    The order numbers strings run by run. A waiting string carries the length it shares with the last string put out.
    Of two strings the one that shares more is smaller; only on a tie are bytes compared, from the tie on.
    """
    runs = [_Run(*c) for c in coded]
    starts = np.concatenate([[0], np.cumsum([len(c[1]) for c in coded], dtype=np.int64)]).tolist()
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    known = [run.advance() for run in runs] + [-1] * (leaves - len(runs))
    known = [0 if k >= 0 else -1 for k in known]
    tree = [0] * leaves  # losers; the winner is handed up

    def play(a, b):
        """Winner and loser; the loser learns what it shares with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].string, runs[b].string
        if s == t:
            known[b] = len(s)
            return a, b
        at = _differ(s, t, x)
        if at == len(s) or (at < len(t) and s[at] < t[at]):
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def build(node):
        if node >= leaves:
            return node - leaves
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    total = int(starts[-1])
    order, lcp = np.empty(total, np.int64), np.empty(total, np.int64)
    winner = build(1) if runs else 0
    for i in range(total):
        run = runs[winner]
        order[i] = starts[winner] + run.at
        lcp[i] = known[winner]
        known[winner] = run.advance()
        node = (leaves + winner) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1
    return order, lcp
