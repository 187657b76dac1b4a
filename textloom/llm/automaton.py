"""Generalised suffix automaton over sequences of words."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of several word sequences, with the items that hold each window.

    Items are fed one after another, each from the root, so no substring spans two of them. A
    window is `width` consecutive words of an item; a shorter item is one window of its own length.
    """

    def __init__(self, items: dict[object, list[bytes]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        names = sorted(items, key=str)
        for name in names:
            at, states = 0, []
            for word in items[name]:
                at = self._extend(at, self.vocab.setdefault(word, len(self.vocab)))
                states.append(at)
            ends.append(states)
        self.items = names
        self.shortest = min([width, *(len(s) for s in ends if s)])
        self._mark(ends)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def _mark(self, ends: list[list[int]]) -> None:
        """held: state of a whole window -> items; short: state -> (length, item) of items that end there whole.

        wide: a state's ancestor whose strings include the suffix of `width` words; marked: the
        nearest one, itself included, that a short item ends in. Both are filled in order of
        length, parents first, so a scan never climbs: a text of one word repeated costs no more.
        """
        link, length, width = self.link, self.length, self.width
        self.held: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, states in enumerate(ends):
            if states and len(states) < width:
                self.short.setdefault(states[-1], []).append((len(states), k))  # the last state holds the whole item
        self.wide, self.marked = list(range(len(link))), [0] * len(link)
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            up = link[state]
            if length[up] >= width:
                self.wide[state] = self.wide[up]
            self.marked[state] = state if state in self.short else self.marked[up]
        for k, states in enumerate(ends):
            if len(states) >= width:
                for state in states[width - 1 :]:
                    self.held.setdefault(self.wide[state], set()).add(k)

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (start, end) in word positions, and items with a window in `ids`."""
        nxt, link, length, width = self.next, self.link, self.length, self.width
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        state = run = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= width:
                if spans and spans[-1][1] == i and spans[-1][0] <= i + 1 - width:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - width, i + 1))
                if (wide := self.wide[state]) not in seen:
                    seen.add(wide)
                    items |= self.held.get(wide, set())
            at = self.marked[state] if run else 0
            while at:  # each has a short item of another length, so there are fewer than `width`
                for n, k in self.short[at]:
                    if n <= run:
                        spans.append((i + 1 - n, i + 1))
                        items.add(k)
                at = self.marked[link[at]]
        return spans, items
