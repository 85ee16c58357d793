"""Probabilistic automata inferred from example strings (ALERGIA).

The examples, written as sequences of character classes, form a prefix tree
with counts.  States are then merged, breadth first: a state joins the first
earlier state with which it is statistically compatible (Hoeffding bounds on
the ending and on each symbol's frequency, here and below); merging folds the
subtrees.  The result gives each string a probability, which is the format's
likelihood.
"""

from __future__ import annotations

import math

# Classes of characters, each with its characters; a character's probability
# is that of its class, shared equally.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
CLASS_OF = {c: k for k, chars in enumerate(CLASSES) for c in chars}
SIZE_LOG = [math.log(len(c)) for c in CLASSES]


def classes(value: str) -> list[int]:
    return [CLASS_OF[c] for c in value]


class Automaton:
    """States are numbers; ``steps[s]`` maps a class to (next state, log probability)."""

    def __init__(self, steps: list[dict[int, tuple[int, float]]], ends: list[float]):
        self.steps, self.ends = steps, ends
        self.unseen = None

    def smooth(self, share: float = 0.01) -> None:
        """Gives the classes that a state has not seen a share of its probability; they lead back to it."""
        self.unseen = math.log(share / len(CLASSES))
        seen = math.log(1 - share)
        self.steps = [{c: (t, p + seen) for c, (t, p) in step.items()} for step in self.steps]
        self.ends = [p + seen for p in self.ends]

    def score(self, symbols: list[int]) -> float:
        """Log probability of the string; minus infinity outside the format, unless smoothed."""
        s, total = 0, 0.0
        for c in symbols:
            step = self.steps[s].get(c)
            if step is None:
                if self.unseen is None:
                    return -math.inf
                step = (s, self.unseen)
            s = step[0]
            total += step[1] - SIZE_LOG[c]
        return total + self.ends[s]


def infer(values: list[str], alpha: float = 0.05) -> Automaton | None:
    """ALERGIA over the examples (None without any)."""
    if not values:
        return None
    arcs: list[dict[int, list[int]]] = [{}]  # class -> [state, times used]
    visits, ends = [0], [0]
    for v in values:
        s = 0
        visits[0] += 1
        for c in classes(v):
            if c not in arcs[s]:
                arcs[s][c] = [len(arcs), 0]
                arcs.append({})
                visits.append(0)
                ends.append(0)
            arcs[s][c][1] += 1
            s = arcs[s][c][0]
            visits[s] += 1
        ends[s] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1, n1, f2, n2):
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], visits[a], ends[b], visits[b]):
                return False
            for c in arcs[a].keys() | arcs[b].keys():
                x, y = arcs[a].get(c, (None, 0)), arcs[b].get(c, (None, 0))
                if differ(x[1], visits[a], y[1], visits[b]):
                    return False
                if x[1] and y[1]:
                    todo.append((x[0], y[0]))
        return True

    def fold(a, b):
        """Counts the tree below b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            for c, arc in arcs[b].items():
                if c in arcs[a]:
                    arcs[a][c][1] += arc[1]
                    todo.append((arcs[a][c][0], arc[0]))
                else:
                    arcs[a][c] = arc

    red, at = [0], 0
    border = [(0, c) for c in sorted(arcs[0])]
    while at < len(border):
        source, c = border[at]
        at += 1
        s = arcs[source][c][0]
        if s in red:
            continue
        match = next((r for r in red if compatible(r, s)), None)
        if match is None:
            red.append(s)
            border += [(s, d) for d in sorted(arcs[s])]
        else:
            before = {r: set(arcs[r]) for r in red}
            arcs[source][c][0] = match
            fold(match, s)
            border += [(r, d) for r in red for d in sorted(arcs[r]) if d not in before[r]]
    number = {s: k for k, s in enumerate(red)}
    steps, finals = [], []
    for s in red:
        total = ends[s] + sum(n for _, n in arcs[s].values())
        steps.append({c: (number[t], math.log(n / total)) for c, (t, n) in arcs[s].items()})
        finals.append(math.log(max(ends[s], 0.01) / total))
    return Automaton(steps, finals)
