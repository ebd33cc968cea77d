"""Plain versions of the operators, row by row, that the tests hold them against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

from sensorloom.llm.tokenise import default_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def license_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    w = words(text)
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def leaks(text: str | None, items: list[tuple[str, str | None]], size: int = 10) -> tuple[int, int, list[str]]:
    w = words(text)
    hit, ids = set(), set()
    for item, other in items:
        v = words(other)
        windows = [v[i : i + size] for i in range(len(v) - size + 1)] if len(v) >= size else [v] if v else []
        for x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def simhash(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text: str | None) -> set[str]:
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    fps = [simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3).tolist():
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


_tokenizer = None


def ids(text: str | None) -> np.ndarray:
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(default_path())
        _tokenizer.encode_special_tokens = True
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(values: np.ndarray) -> int:
    return zlib.crc32(values.astype("<u4").tobytes())


def without_repeats(rows: list[tuple[int, str | None]], size: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        w = BLANKS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = BLANKS.findall(t)
    lines = [x for x in t.split("\n") if BLANKS.search(x)]
    seen: dict[tuple, int] = {}
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    hit = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def clean(rows: list[tuple[str | None, str | None]], most: int = 10) -> list[tuple[int, str]]:
    """The number of removed words and the text that is left, for rows of (host, text)."""
    bare = lambda x: re.sub("[0-9]", "0", " ".join(BLANKS.findall(x))).lower()
    sets = {(h or "", frozenset(bare(x) for x in (t or "").split("\n") if BLANKS.search(x))) for h, t in rows}
    count: dict[tuple[str, str], int] = {}
    for h, lines in sets:
        for x in lines:
            count[h, x] = count.get((h, x), 0) + 1
    out = []
    for h, t in rows:
        gone = [x for x in (t or "").split("\n") if BLANKS.search(x) and count[h or "", bare(x)] > most]
        stay = [x for x in (t or "").split("\n") if not BLANKS.search(x) or count[h or "", bare(x)] <= most]
        out.append((sum(len(BLANKS.findall(x)) for x in gone), "\n".join(stay)))
    return out


def depleted(rows: list[tuple[str | None, str | None]]) -> list[tuple[int, bool]]:
    """The number of removed words and the verdict, for rows of (host, text)."""
    out = []
    for (_, t), (n, _) in zip(rows, clean(rows), strict=True):
        q = quality(t)
        out.append((n, not q[5] and not 2 * n > q[0]))
    return out
