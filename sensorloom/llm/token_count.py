"""Edit-aware token counts.

Method: each document's segment tree over its pre-tokens is kept in a table; a leaf has a pre-token's number of
tokens and of characters, a node their sums. For edits the tree is loaded, not built by encoding: an edit is found by
descending on characters; the pre-tokens that it touches, two before and as many after as it takes to meet an old
boundary again are split and encoded anew, and the sums on the way up are updated. Byte-level BPE never merges across
pre-tokens, and splitting from a boundary does not depend on what stands before it, so counts equal those of a full
encoding. A document without edits only has its root read.

The table holds the leaves, from which the sums above are added up on loading, and the text of the documents that have
edits, as boundary context. A tokenizer of another form than byte-level BPE has no such boundaries and is refused.

Edits: array of (start, end, text) in code points of the original text, in order and without overlap; a null or
empty array leaves the text. Null text: empty. Null or repeated doc_id, repeated rows and extra columns: each row
is counted by itself. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, need
from .tokenise import Encoder, default_path, encoder

BEFORE, AFTER = 2, 4
EDITS = "array<struct<start:int,end:int,text:string>>"


def packed(values: list[int]) -> bytes:
    """Numbers in as few bytes each as the largest needs, which is told first."""
    out = np.array(values, np.int64)
    kind = np.min_scalar_type(int(out.max(initial=0)))
    return bytes([kind.itemsize]) + out.astype(kind.newbyteorder("<")).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def leaves_of(text: str, enc: Encoder) -> tuple[list[int], list[int]]:
    """The numbers of tokens and of characters of a text's pre-tokens."""
    pieces = enc.split.findall(text)
    words, tokens = enc.words, enc.tokens
    return [len(words[p[1:]] if p[0] == " " and len(p) > 1 and p[1] != " " and p.isascii() and p[1:].isalpha() else tokens[p]) // 4 for p in pieces], list(map(len, pieces))


class SegmentTree:
    """A text's pre-tokens with the sums of tokens and characters; a slot holds the pre-tokens that took its place."""

    def __init__(self, text: str, enc: Encoder, tokens: Sequence[int], chars: Sequence[int]):
        self.enc, self.original, self.size = enc, text, len(chars)
        self.leaves = 1 << max(0, self.size - 1).bit_length()
        self.tokens, self.chars = self._sums(tokens), self._sums(chars)
        self.starts = np.concatenate(([0], np.cumsum(np.asarray(chars, np.int64)))).tolist()
        self.changed: dict[int, list[str]] = {}
        self.encoded = 0

    @classmethod
    def of(cls, text: str, enc: Encoder) -> SegmentTree:
        return cls(text, enc, *leaves_of(text, enc))

    def _sums(self, values: Sequence[int]) -> list[int]:
        level = np.zeros(self.leaves, np.int64)
        level[: self.size] = values
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1)
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def slot(self, i: int) -> list[str]:
        """The pre-tokens that stand at a slot now."""
        if i in self.changed:
            return self.changed[i]
        return [self.original[self.starts[i] : self.starts[i + 1]]] if i < len(self.starts) - 1 else []

    def _count(self, pieces: list[str]) -> int:
        return sum(len(self.enc.tokens[p]) for p in pieces) // 4

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for i in range(self.size) for p in self.slot(i))

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds a character, and the slot's first character; the last slot beyond the end."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def _set(self, i: int, pieces: list[str]) -> None:
        self.changed[i] = pieces
        node = self.leaves + i
        self.tokens[node], self.chars[node] = self._count(pieces), sum(map(len, pieces))
        while node > 1:
            node //= 2
            self.tokens[node], self.chars[node] = self.tokens[2 * node] + self.tokens[2 * node + 1], self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from ``start`` to before ``end``."""
        size = self.chars[1]
        start, end = min(max(0, start), size), min(max(start, end), size)
        self.size = max(1, self.size)
        first, left = self.find(max(0, start - 1)) if size else (0, 0)
        if first >= self.size:
            first, left = self.size - 1, size - self.chars[self.leaves + self.size - 1]
        back = 0
        while first > 0 and back < BEFORE:
            first -= 1
            left -= self.chars[self.leaves + first]
            back += bool(self.slot(first))
        last, right, more = first, left, AFTER
        while last < self.size and (right < end or last == first):  # one at least, to hold what is new
            right += self.chars[self.leaves + last]
            last += 1
        reach = last
        while True:
            seen = 0
            while reach < self.size and seen < more:
                seen += len(self.slot(reach))
                reach += 1
            old = "".join(p for k in range(first, reach) for p in self.slot(k))
            new = old[: start - left] + text + old[end - left :]
            pieces = self.enc.split.findall(new)
            if reach == self.size:
                stop, used = reach, len(pieces)
                break
            # Old boundaries after the edit, by their place in the new text; the last pieces may still grow.
            shift, place, bounds = len(text) - (end - start), right - left, {}
            for k in range(last, reach):
                bounds[place + shift] = k
                place += self.chars[self.leaves + k]
            at, met = 0, None
            for n, p in enumerate(pieces[: -2] if len(pieces) > 2 else []):
                at += len(p)
                if at in bounds and at >= start - left + len(text):
                    met = (bounds[at], n + 1)
                    break
            if met:
                stop, used = met
                break
            more *= 2
        self.encoded += used
        self._set(first, pieces[:used])
        for k in range(first + 1, stop):
            if self.slot(k):
                self._set(k, [])


def repeated_line_edits(text: str | None) -> list[tuple[int, int, str]]:
    """Edits that remove each line with a word that equals an earlier one, with the line break before it."""
    seen: set[str] = set()
    out, at = [], 0
    for line in (text or "").split("\n"):
        if line.strip():
            if line in seen:
                out.append((at - 1, at + len(line), ""))
            seen.add(line)
        at += len(line) + 1
    return out


def _planter(path: str, edits: Callable | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        if not enc.plain:
            raise ValueError(f"{path} is no byte-level BPE whose pre-tokens are encoded each for itself")
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                text = text or ""
                if edits:
                    todo = [{"start": a, "end": b, "text": t} for a, b, t in edits(text)]
                else:
                    todo = [] if batch["edits"].iat[i] is None else [{"start": e["start"], "end": e["end"], "text": e["text"]} for e in batch["edits"].iat[i]]
                tokens, chars = leaves_of(text, enc)
                rows.append((sum(tokens), packed(tokens), packed(chars), todo, text if todo else None))
            grown = pd.DataFrame(rows, columns=["n_tokens", "tokens", "chars", "edits", "text"])
            yield pd.concat([batch[["doc_id"]].astype("Int64").reset_index(drop=True), grown], axis=1)

    return plant


def _editor(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for text, n, tokens, chars, edits in zip(batch["text"], batch["n_tokens"], batch["tokens"], batch["chars"], batch["edits"], strict=True):
                tree = SegmentTree(text, enc, unpacked(tokens), unpacked(chars))
                for e in reversed(edits):  # from the end, so earlier places stay what they were
                    tree.edit(e["start"], e["end"], e["text"] or "")
                rows.append((n, len(edits), tree.total, tree.encoded))
            counts = pd.DataFrame(rows, columns=["n_tokens", "n_edits", "n_tokens_after", "n_encoded_again"])
            yield pd.concat([batch[["doc_id"]].astype("Int64").reset_index(drop=True), counts], axis=1)

    return edit


COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_encoded_again long"


def document_trees(docs: DataFrame, *, edits: str | Callable[[str], list] = "edits", doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The stored trees (doc_id, n_tokens, tokens, chars, edits, text) of all rows."""
    need(docs, doc_id, text, *([edits] if isinstance(edits, str) else []))
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if isinstance(edits, str):
        columns.append(F.col(edits).cast(EDITS).alias("edits"))
    plant = _planter(tokenizer or default_path(), None if isinstance(edits, str) else edits)
    return kept(docs.select(*columns).mapInPandas(plant, f"doc_id long, n_tokens long, tokens binary, chars binary, edits {EDITS}, text string"), "trees", batch=64)


def edited_counts(trees: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_again) of each tree, with its edits."""
    none = F.size("edits") == 0
    done = kept(trees.filter(~none).mapInPandas(_editor(tokenizer or default_path()), COUNTS), "edited", batch=64)
    zero = F.lit(0).cast("long")
    return trees.filter(none).select("doc_id", "n_tokens", zero.alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), zero.alias("n_encoded_again")).unionByName(done)


def count_tokens(docs: DataFrame, *, edits: str | Callable[[str], list] = "edits", doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_again). ``edits``: a column, or a function of a text."""
    return edited_counts(document_trees(docs, edits=edits, doc_id=doc_id, text=text, tokenizer=tokenizer), tokenizer=tokenizer)
