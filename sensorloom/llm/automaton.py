"""A suffix automaton over any symbols, built one symbol at a time."""

from __future__ import annotations

from collections.abc import Hashable


class SuffixAutomaton:
    """States are sets of end positions; ``link`` leads to the longest suffix that ends elsewhere too."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def extend(self, symbol: Hashable) -> int:
        """Append a symbol. Returns the matching statistic there: how long the longest suffix is that also ended before."""
        follow, link, length = self.next, self.link, self.length
        new = len(length)
        length.append(length[self.last] + 1)
        follow.append({})
        link.append(0)
        p = self.last
        while p >= 0 and symbol not in follow[p]:
            follow[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = follow[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                link.append(link[q])
                while p >= 0 and follow[p].get(symbol) == q:
                    follow[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new
        return length[link[new]]
