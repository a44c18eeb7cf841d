"""Inference of probabilistic automata: a prefix tree whose statistically compatible states are merged."""

from __future__ import annotations

import math
from collections import deque

#: Symbols that smoothing reckons with, and the weight of their uniform share in each state.
ALPHABET, SMOOTH = 96, 0.5


class Automaton:
    """A probabilistic automaton over characters, learned from strings (Carrasco and Oncina's state merging).

    States are numbers; go[s] maps a character to (state, count), stops[s] and total[s] are counts. Strings in another order
    give the same automaton: children are visited in order of characters. Of strings longer than `longest` only that much is
    learned, and not that they end there.
    """

    def __init__(self, strings: list[str], alpha: float = 0.01, longest: int | None = None) -> None:
        self.go: list[dict[str, list[int]]] = [{}]
        self.stops, self.total = [0], [0]
        for text in strings:
            s = 0
            self.total[0] += 1
            for c in text[:longest]:
                step = self.go[s].setdefault(c, [len(self.go), 0])
                if step[0] == len(self.go):
                    self.go.append({})
                    self.stops.append(0)
                    self.total.append(0)
                step[1] += 1
                s = step[0]
                self.total[s] += 1
            if longest is None or len(text) <= longest:
                self.stops[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        blue = deque((0, c) for c in sorted(self.go[0]))
        while blue:
            parent, c = blue.popleft()
            child = self.go[parent][c][0]
            if child in red:
                continue
            alike = [r for r in red if self._alike(r, child)]
            if alike:  # of all compatible states the one that makes what follows likeliest, the first of several
                r = max(alike, key=lambda r: self._fit(r, child))
                self.go[parent][c][0] = r
                self._fold(r, child)
            else:
                red.append(child)
            # folding may have put new children under any red state
            blue = deque((r, x) for r in red for x in sorted(self.go[r]) if self.go[r][x][0] not in red)
        self._compact(red)

    def _far(self, a: int, n: int, b: int, m: int) -> bool:
        """Hoeffding's bound: are the shares a of n and b of m too far apart?"""
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if self._far(self.stops[a], n, self.stops[b], m):
                return False
            for c in self.go[a].keys() | self.go[b].keys():
                x, y = self.go[a].get(c), self.go[b].get(c)
                if self._far(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fit(self, a: int, b: int) -> float:
        """Log-likelihood of one step on from b, counted as often as it was seen, in state a."""
        all_ = math.log(self.total[a] + SMOOTH)
        out = self.stops[b] * (math.log(self.stops[a] + SMOOTH / ALPHABET) - all_)
        for c, (_, n) in self.go[b].items():
            x = self.go[a].get(c)
            out += n * (math.log((x[1] if x else 0) + SMOOTH / ALPHABET) - all_)
        return out

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            self.total[a] += self.total[b]
            for c, (y, n) in self.go[b].items():
                if c in self.go[a]:
                    self.go[a][c][1] += n
                    todo.append((self.go[a][c][0], y))
                else:
                    self.go[a][c] = [y, n]

    def _compact(self, red: list[int]) -> None:
        name = {s: i for i, s in enumerate(red)}
        self.go = [{c: [name[t], n] for c, (t, n) in self.go[s].items()} for s in red]
        self.stops, self.total = [self.stops[s] for s in red], [self.total[s] for s in red]
        self.table = []
        for s in range(len(red)):
            all_ = math.log(self.total[s] + SMOOTH)
            seen = {c: (math.log(n + SMOOTH / ALPHABET) - all_, t) for c, (t, n) in self.go[s].items()}
            rare = math.log(SMOOTH / ALPHABET) - all_
            self.table.append((seen, rare, math.log(self.stops[s] + SMOOTH / ALPHABET) - all_))

    def score(self, text: str) -> float:
        """Log-likelihood of text; after an unseen character, all are equally likely."""
        s, out = 0, 0.0
        for i, c in enumerate(text):
            seen, rare, _ = self.table[s]
            if c not in seen:
                return out + rare - (len(text) - i) * math.log(ALPHABET)
            p, s = seen[c]
            out += p
        return out + self.table[s][2]
