"""Simple-8b: integers in 64-bit words, as many in each as their size allows.

The top four bits of a word select how many values it holds and how wide each is; the value of lowest index
is in the lowest bits. Selector 0 is an escape: the next word holds one value of more than 60 bits. Words
never reach over the end of a block, and each block's first word is listed, so blocks are decoded alone
or all at once. A segment is one file of the format:

    magic, version, docs, ids, words, ids in a block (u64 each), doc ids (i64), null flags of doc ids (u8),
    ids of each document (u64), first word of each block and the end (u64), words (u64)
"""

from __future__ import annotations

import numpy as np

#: Selector -> (values in a word, bits of each); fixed by the format.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
COUNT = np.ones(15, np.int64)
for _s, (_c, _b) in SELECTORS.items():
    COUNT[_s] = _c
JUMP = COUNT.astype(np.uint8).tobytes().ljust(256, b"\1")
BLOCK, TAIL, MAGIC = 4096, 60, 0x53384231


#: Bits of the values below 2**16.
SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value as bytes, exactly: floats of 53 bits hold each half of a value."""
    if values.dtype == np.uint16:
        return SMALL.take(values)
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end)."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    row = block + TAIL
    # Short integers keep the work on them short; they are widened as they are packed.
    kind = np.uint16 if values.max() < len(SMALL) else np.uint64
    x = np.zeros((blocks, row), kind)
    padded = np.zeros(blocks * block, kind)
    padded[:n] = values
    x[:, :block] = padded.reshape(blocks, block)
    width = _widths(x)
    most = {1: width}  # the widest of so many values from each place
    for p in (2, 4, 8, 16, 32):
        half = most[p // 2]
        most[p] = half.copy()
        most[p][:, : -p // 2] = np.maximum(half[:, : -p // 2], half[:, p // 2 :])
    select = np.zeros((blocks, row), np.uint8)
    for s in sorted(SELECTORS, reverse=True):  # from few values in a word to many: the last that fits is the best
        c, b = SELECTORS[s]
        p = 1 << (c.bit_length() - 1)
        widest = most[p] if c == p else np.maximum(most[p][:, : row - c + p], most[p][:, c - p :])
        np.copyto(select[:, : widest.shape[1]], s, where=widest <= b)
    flat, jumps, starts, firsts = select.ravel(), select.tobytes().translate(JUMP), [], []
    add = starts.append
    for k in range(blocks):
        i = k * row
        end = i + min(block, n - k * block)
        firsts.append(len(starts))
        while i < end:
            add(i)
            i += jumps[i]
    at = np.array(starts)
    chosen = flat[at]
    place = np.cumsum(1 + (chosen == 0)) - 1 - (chosen == 0)
    words = np.zeros(len(at) + int((chosen == 0).sum()), np.uint64)
    source = x.ravel()
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[mine] + 1] = source[at[mine]]
            continue
        c, b = SELECTORS[int(s)]
        shifted = source[at[mine][:, None] + np.arange(c)].astype(np.uint64) << (np.arange(c, dtype=np.uint64) * np.uint64(b))
        words[place[mine]] = np.bitwise_or.reduce(shifted, axis=1) | (np.uint64(s) << np.uint64(60))
    return words, np.append(place[firsts], len(words)).astype(np.uint64)


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """The values of blocks ``first`` to before ``last`` of ``n`` values in all."""
    last = len(offsets) - 1 if last is None else last
    a, z = int(offsets[first]), int(offsets[last])
    w = words[a:z]
    if not len(w):
        return np.zeros(0, np.uint64)
    select = (w >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(w), bool)
    skip = -1
    for i in np.flatnonzero(select == 0).tolist():  # what follows an escape is a value, whatever its top bits are
        if i != skip:
            skip = i + 1
            head[skip] = False
    # A raw value can look like any selector, so words after an escape are left out here.
    at = np.flatnonzero(head)
    chosen, count = select[at], COUNT[select[at]]
    before = np.cumsum(count) - count
    of = np.searchsorted(offsets[first:last].astype(np.int64) - a, at, side="right") - 1
    first_word = np.searchsorted(at, offsets[first:last].astype(np.int64) - a)
    row = block + TAIL
    short = (select[at] != 0).all() and (select[at] < 13).all()  # at most 20 bits
    out = np.zeros((last - first) * row, np.uint32 if short else np.uint64)
    start = of * row + before - before[first_word][of]
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            out[start[mine]] = w[at[mine] + 1]
            continue
        c, b = SELECTORS[int(s)]
        out[start[mine][:, None] + np.arange(c)] = (w[at[mine]][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b))) & np.uint64((1 << b) - 1)
    return out.reshape(-1, row)[:, :block].ravel()[: min(n, last * block) - first * block]


def pack_segment(doc_ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    words, offsets = encode_blocks(values)
    head = np.array([MAGIC, 1, len(doc_ids), len(values), len(words), BLOCK], np.uint64)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in (head, ids, null, np.array(counts, np.uint64), offsets, words))


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each document, all values)."""
    at = 0

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    magic, version, docs, n, n_words, block = (int(v) for v in take(6, "<u8"))
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a segment of this format")
    ids, null, counts = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u8")
    offsets, words = take(-(-n // block) + 1, "<u8"), take(n_words, "<u8")
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, decode_blocks(words, offsets, n, block=block)
