"""Fixed graphs of FIXTURES.md and plain-Python versions of the rules they are checked against."""

from __future__ import annotations

PETERSEN = [
    (1, 2), (1, 3), (1, 6), (2, 7), (2, 8), (3, 4), (3, 9), (4, 5), (4, 8), (5, 6), (5, 7),
    (6, 10), (7, 9), (8, 10), (9, 10),
]
# name: (priorities by vertex, edges, expected colours per operator)
FIXTURES = {
    "petersen": (
        {i: i for i in range(1, 11)},
        PETERSEN,
        {
            "greedy": [1, 2, 2, 1, 2, 3, 1, 3, 3, 1],
            "rounds": [1, 2, 2, 3, 4, 5, 5, 4, 6, 7],
            "repair": [1, 2, 2, 1, 2, 3, 3, 3, 1, 2],
        },
    ),
    "petersen_and_isolated": (
        {0: 0, **dict(zip(range(1, 12), [6, 11, 10, 1, 2, 7, 4, 9, 8, 3, 5]))},
        [*PETERSEN, (10, 11), (9, 11), (7, 11), (8, 11)],
        {
            "greedy": [1, 1, 2, 2, 1, 2, 3, 1, 3, 3, 1, 2],
            "rounds": [1, 1, 6, 6, 1, 2, 3, 3, 5, 5, 1, 4],
            "repair": [1, 1, 3, 3, 1, 2, 3, 1, 2, 2, 1, 3],
        },
    ),
    "conflicts": (
        dict(zip(range(1, 13), [5, 4, 7, 12, 11, 8, 1, 2, 9, 6, 3, 10])),
        [
            (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 2), (5, 4), (6, 1), (6, 3),
            (6, 5), (7, 2), (7, 4), (7, 5), (7, 6), (8, 1), (8, 3), (8, 5), (8, 6), (8, 7),
            (9, 3), (9, 4), (9, 7), (9, 8), (10, 1), (10, 2), (10, 7), (10, 8), (10, 9),
            (11, 3), (11, 4), (11, 5), (11, 6), (11, 9), (11, 10), (12, 1), (12, 2), (12, 5),
            (12, 6), (12, 9), (12, 10), (12, 11),
        ],
        {
            "greedy": [1, 2, 3, 5, 3, 4, 1, 2, 4, 3, 1, 5],
            "rounds": [3, 2, 4, 8, 7, 5, 1, 2, 5, 4, 1, 6],
            "repair": [1, 2, 3, 5, 3, 4, 1, 2, 4, 3, 1, 5],
        },
    ),
}


def neighbours(vertices, edges):
    found = {v: set() for v in vertices}
    for a, b in edges:
        if a != b:
            found[a].add(b)
            found[b].add(a)
    return found


def smallest_free(used):
    color = 1
    while color in used:
        color += 1
    return color


def first_fit(priority, edges):
    near, color = neighbours(priority, edges), {}
    for v in sorted(priority, key=lambda v: (priority[v], v)):
        color[v] = smallest_free({color[u] for u in near[v] if u in color})
    return color


def longest_path(priority, edges):
    near, color = neighbours(priority, edges), {}
    for v in sorted(priority, key=lambda v: (priority[v], v)):
        color[v] = 1 + max((color[u] for u in near[v] if u in color), default=0)
    return color


def repair(priority, edges, freeze):
    near = neighbours(priority, edges)
    color, frozen = dict.fromkeys(priority, 1), set()
    while True:
        after = dict(color)
        for v in priority:
            if v in frozen or not near[v]:
                continue
            same = [(priority[u], u) for u in near[v] if color[u] == color[v]]
            if same and (priority[v], v) < min(same):
                kept = True
            else:
                after[v] = smallest_free({color[u] for u in near[v]})
                kept = after[v] == color[v]
            if kept and freeze:
                frozen.add(v)
        if after == color:
            return color
        color = after


def greedy_cover(pairs, tie=lambda s: 0):
    sets = {}
    for s, e in pairs:
        sets.setdefault(s, set()).add(e)
    picks = []
    while True:
        s = min(sets, key=lambda s: (-len(sets[s]), tie(s), s))
        if not sets[s]:
            return picks
        taken = set(sets[s])
        picks.append((len(picks) + 1, s, len(taken)))
        for other in sets.values():
            other -= taken
