"""Hirschberg's divide and conquer over a four-state automaton.

A sequence of steps leads from an entry state to an exit state.  A step is a pair of 4x4 tables: its cost from
state to state, and the rank of the letters it writes among those of the same source state.  Rows of a
conversation are steps, and so are whole segments of it (:func:`spanned`), so that segments can be solved
apart: their tables meet in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

STATES = range(4)
FAR = 1 << 40

Table = list[list[int]]
Step = tuple[Table, Table]  # cost, rank
Vector = tuple[list[int], list[int]]  # cost of each state, rank of the letters written on the way there


def unit(state: int) -> Vector:
    return [0 if q == state else FAR for q in STATES], [0] * 4


def forward(vector: Vector, step: Step) -> Vector:
    """Costs after a step; of ways of one cost to one state the one with the least letters counts.

    Ways to different states differ in their letters, and none begins with another, as every way ends with the
    letter of the same row.  So ranks settle later ties without the letters themselves.
    """
    cost, rank = vector
    best = []
    for q in STATES:
        _, _, came = min((cost[p] + step[0][p][q], rank[p], p) for p in STATES)
        best.append((cost[came] + step[0][came][q], (rank[came], step[1][came][q])))
    order = sorted(key for c, key in best if c < FAR)
    return [min(c, FAR) for c, _ in best], [order.index(key) if c < FAR else 0 for c, key in best]


def backward(costs: list[int], step: Step) -> list[int]:
    """Costs to the exit from before a step."""
    return [min(FAR, min(step[0][p][q] + costs[q] for q in STATES)) for p in STATES]


Ahead = Callable[[Vector, Any], Vector]
Behind = Callable[[list[int], Any], list[int]]


def remembered(table: Sequence[Step]) -> tuple[Ahead, Behind]:
    """:func:`forward` and :func:`backward` for steps given as places of ``table``.

    Vectors that differ by a constant are alike, and few different ones occur, so nearly all are looked up.
    """
    ahead: dict[tuple, Vector] = {}
    behind: dict[tuple, list[int]] = {}

    def level(costs: list[int]) -> tuple[int, tuple[int, ...]]:
        least = min(costs)
        return least, tuple([c - least if c < FAR else FAR for c in costs])

    def raised(costs: list[int], by: int) -> list[int]:
        return [c + by if c < FAR else FAR for c in costs]

    def forwards(vector: Vector, k: int) -> Vector:
        least, costs = level(vector[0])
        key = (k, costs, *vector[1])
        if key not in ahead:
            ahead[key] = forward((list(costs), vector[1]), table[k])
        return raised(ahead[key][0], least), ahead[key][1]

    def backwards(vector: list[int], k: int) -> list[int]:
        least, costs = level(vector)
        if (k, costs) not in behind:
            behind[k, costs] = backward(list(costs), table[k])
        return raised(behind[k, costs], least)

    return forwards, backwards


def spanned(steps: Sequence, ahead: Ahead = forward) -> Step:
    """A run of steps as one step."""
    vectors = []
    for p in STATES:
        vector = unit(p)
        for step in steps:
            vector = ahead(vector, step)
        vectors.append(vector)
    return [v[0] for v in vectors], [v[1] for v in vectors]


def crossings(steps: Sequence, entry: int, leave: int, ahead: Ahead = forward, behind: Behind = backward) -> list[int]:
    """The states before, between and after ``steps`` on the cheapest way, of those the one with the least letters.

    Forward and backward vectors meet in the middle; the cheapest crossing with the least letters before it
    splits the way in two, which are solved in turn.  Only two vectors are held at a time.
    """
    states = [entry] * (len(steps) + 1)
    states[-1] = leave
    open_parts = [(0, len(steps))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        left = unit(states[low])
        for k in range(low, middle):
            left = ahead(left, steps[k])
        right = unit(states[high])[0]
        for k in range(high - 1, middle - 1, -1):
            right = behind(right, steps[k])
        states[middle] = min(STATES, key=lambda q: (left[0][q] + right[q], left[1][q]))
        open_parts += [(low, middle), (middle, high)]
    return states
