"""Configuration linear program of bin packing over a length histogram.

Minimise the number of bins over *configurations* (multisets of lengths that
fit a bin) such that every length is covered as often as it occurs. The program
is solved by multiplicative weights on the coverage constraints: prices follow
the weights, the best configurations at given prices are an unbounded knapsack,
solved by dynamic programming over the capacity, and the rounds' choices are
averaged into a fractional solution. Prices also give a lower bound on the
number of bins. The solution is rounded to whole bins, what they leave is
solved and rounded again, and only the last remainder goes to best fit. All
work is on the histogram: at most ``capacity`` numbers, however many pieces
there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity at ``prices`` (by length; below 0: not for sale), and the length to take there first.

    0 means that nothing is taken and one unit stays free.
    """
    best = np.zeros(capacity + 1)
    first = np.zeros(capacity + 1, np.int64)
    value, reverse = prices[1:], best[::-1]
    sold = np.flatnonzero(value > 0)
    for c in range(int(sold[0]) + 1 if len(sold) else capacity + 1, capacity + 1):
        # best[c - s] for s = 1..c lies backwards before c
        gain = value[:c] + reverse[capacity + 1 - c :]
        s = c - int(gain[::-1].argmax())
        best[c], first[c] = (gain[s - 1], s) if gain[s - 1] > best[c - 1] else (best[c - 1], 0)
    return best, first


def fillings(first: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best filling of each of ``rooms``: (which room, length), one after the other."""
    which, left = np.arange(len(rooms)), rooms.copy()
    rows, lengths = [], []
    while len(which):
        s = first[left]
        rows.append(which[s > 0])
        lengths.append(s[s > 0])
        left = left - np.maximum(s, 1)
        which, left = which[left > 0], left[left > 0]
    return (np.concatenate(rows), np.concatenate(lengths)) if rows else (np.zeros(0, np.int64),) * 2


@dataclass
class Solution:
    """A fractional solution: configurations with their numbers of bins, the least coverage of a length, and the lower bound."""

    configurations: dict[tuple[int, ...], float]
    coverage: float
    bound: float

    @property
    def value(self) -> float:
        """Bins of the solution once it is scaled up to cover every length."""
        return sum(self.configurations.values()) / max(self.coverage, 1e-9)


def solve(histogram: np.ndarray, capacity: int, rounds: int = 100, rate: float = 0.005, slack: float = 0.01, most: float = 200.0) -> Solution:
    """The program by multiplicative weights.

    Each round takes, for every length, the best configuration that holds it,
    where that is within ``slack`` of the best of all, in proportion to what the
    rounds before left uncovered of the length. A weight falls by how far the
    round covers its length (``most`` times over at most).
    """
    lengths = np.flatnonzero(histogram)
    counts = histogram[lengths].astype(float)
    slot = np.zeros(capacity + 1, np.int64)
    slot[lengths] = np.arange(len(lengths))
    weights = counts * lengths
    weights /= weights.sum()
    bound, mass, covered = 0.0, {}, np.zeros(len(lengths))
    for nth in range(rounds):
        prices = np.full(capacity + 1, -1.0)
        prices[lengths] = weights / counts
        best, first = knapsack(prices, capacity)
        bound = max(bound, 1 / best[capacity])  # prices / best are a feasible dual solution; the weights add up to 1
        fair = np.flatnonzero(prices[lengths] + best[capacity - lengths] >= (1 - slack) * best[capacity])
        share = np.maximum((nth + 1) / rounds * counts[fair] - covered[fair], 1e-9 * counts[fair])
        share *= bound / rounds / share.sum()
        rows, others = fillings(first, capacity - lengths[fair])
        now = np.bincount(slot[others], share[rows], len(lengths)).astype(float)
        now[fair] += share
        covered += now
        weights *= np.exp(-rate * np.minimum(now * rounds / counts, most))
        weights = np.maximum(weights / weights.sum(), 1e-12)
        order = np.argsort(rows, kind="stable")
        for own, rest, m in zip(lengths[fair].tolist(), np.split(others[order], np.cumsum(np.bincount(rows, minlength=len(fair)))[:-1]), share.tolist(), strict=True):
            key = tuple(sorted([own, *rest.tolist()], reverse=True))
            mass[key] = mass.get(key, 0.0) + m
    return Solution(mass, float((covered / counts).min()), bound)


def rounded(solution: Solution, rest: np.ndarray, capacity: int, full: float) -> list[tuple[list[int], int]]:
    """Whole bins of a solution, as far as the pieces ``rest`` go, which they are taken from.

    Those with the largest pieces first, as these fit in with the fewest others.
    Numbers of bins are rounded so that their running sum is off by less than
    one. Configurations less than ``full`` are left to later.
    """
    bins, upto = [], 0.5
    for content, m in sorted(solution.configurations.items(), reverse=True):
        if sum(content) < full * capacity:
            continue
        n, upto = int(upto + m) - int(upto), upto + m
        if n:
            often: dict[int, int] = {}
            for s in content:
                often[s] = often.get(s, 0) + 1
            whole = min(n, *(int(rest[s]) // k for s, k in often.items()))
            if whole:
                for s, k in often.items():
                    rest[s] -= whole * k
                bins.append((list(content), whole))
    return bins


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: (lengths of a bin, number of such bins).

    Bins of equal content are kept as one entry, so the work follows the number
    of different lengths and not of pieces.
    """
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room left
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        open_[room][content] = open_[room].get(content, 0) + n
        rooms[room] = True

    for s in range(capacity, 0, -1):
        n = int(histogram[s])
        while n:
            fit = np.flatnonzero(rooms[s:])
            if not len(fit):
                per = capacity // s
                for k, m in ((per, n // per), (n % per, 1)):
                    if k and m:
                        put(capacity - k * s, (s,) * k, m)
                break
            room = int(fit[0]) + s
            content, had = open_[room].popitem()
            rooms[room] = bool(open_[room])
            k = min(room // s, n)
            m = min(had, n // k)
            put(room - k * s, content + (s,) * k, m)
            if had > m:
                put(room, content, had - m)
            n -= k * m
    return [(list(c), m) for at in open_ for c, m in at.items()]


def configurations(histogram: np.ndarray, capacity: int, passes: int = 6, rounds: int = 60, full: float = 0.9995) -> list[tuple[list[int], int]]:
    """Bins that hold every piece: (lengths of a bin, number of such bins).

    ``histogram[s]`` is the number of pieces of length s, up to ``capacity``.
    Each pass solves the program for the pieces that are left and rounds the
    solution; it ends where a pass places less than a hundredth of them.
    """
    rest = histogram.astype(np.int64).copy()
    bins = [([capacity], int(rest[capacity]))] if rest[capacity] else []
    rest[capacity] = 0
    for _ in range(passes):
        before = int(rest.sum())
        if before:
            bins += rounded(solve(rest, capacity, rounds), rest, capacity, full)
        if before - int(rest.sum()) <= before // 100:
            break
    return bins + best_fit(rest, capacity)
