"""Boolean trigram queries derived from a regex.

``query(pattern)`` gives clauses that any match must meet: each clause is a list of alternatives, each
alternative a set of trigrams that must all stand in the text. No clause means that the regex has no mandatory
trigram and every text must be scanned. Runs on the driver, once for each rule; the texts never get here.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product

#: So many strings are followed through a concatenation before they are cut to what is known so far.
MOST = 64
Clause = frozenset[frozenset[str]]


def _trigrams(s: str) -> frozenset[str]:
    """Of a long string the first, middle and last. Each more is a posting list to build over all texts, and these leave
    hardly more texts than have a match."""
    n = len(s) - 2
    return frozenset(s[i : i + 3] for i in ({0, n // 2, n - 1} if n > 3 else range(n)))


def _clause(strings: frozenset[str]) -> Clause | None:
    alternatives = frozenset(_trigrams(s) for s in strings)
    return None if not alternatives or frozenset() in alternatives else alternatives


def _letters(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _exact(node) -> frozenset[str] | None:
    """All strings that the node can match in lower case, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return frozenset({chr(value).lower()})
    if kind is op.IN:
        return _letters(value)
    if kind is op.SUBPATTERN:
        return _exact_all(value[3])
    if kind is op.BRANCH:
        found = [_exact_all(x) for x in value[1]]
        return None if None in found else frozenset().union(*found)
    if kind is op.MAX_REPEAT and value[1] <= 2:
        one = _exact_all(value[2])
        if one is not None:
            return frozenset("".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n))
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return frozenset({""})
    return None


def _exact_all(nodes) -> frozenset[str] | None:
    out = frozenset({""})
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = frozenset(a + b for a in out for b in one)
    return out


def _needs(nodes) -> list[Clause]:
    """Clauses of a concatenation: exact stretches give theirs, other nodes what they hold themselves."""
    clauses: list[Clause] = []
    stretch = frozenset({""})

    def close() -> None:
        nonlocal stretch
        if found := _clause(stretch):
            clauses.append(found)
        stretch = frozenset({""})

    for node in nodes:
        one = _exact(node)
        if one is not None and len(stretch) * len(one) <= MOST:
            stretch = frozenset(a + b for a in stretch for b in one)
            continue
        close()
        if one is not None:
            stretch = one
            continue
        kind, value = node
        if kind is op.SUBPATTERN:
            clauses += _needs(value[3])
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            clauses += _needs(value[2])
        elif kind is op.BRANCH:
            each = [_needs(x) for x in value[1]]
            if all(each):  # one clause of each branch, the alternatives put together
                clauses.append(frozenset().union(*[min(x, key=len) for x in each]))
    close()
    return clauses


def query(pattern: str) -> list[list[list[str]]]:
    """Clauses in a fixed order; the trigrams are in lower case, to be looked up in a lower-cased text."""
    clauses = {c for c in _needs(parser.parse(pattern))}
    return sorted(sorted(sorted(a) for a in c) for c in clauses)
