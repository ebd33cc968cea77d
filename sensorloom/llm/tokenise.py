"""Token ids of whole texts, by a byte-level BPE of the tokenizers library.

The library's byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in
a row. Workers keep the ids of pre-tokens that they have met, which is several times as fast as encoding
each of them again; what is not kept is encoded by the library. The bound on what is kept does not change
results.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer


def _visible_bytes() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Ids(dict):
    """Pre-token or piece -> ids as bytes of unsigned 32-bit integers, within a bound in bytes; long keys are not held.

    When half the bound is full, what is held becomes the old half and the former old half goes; what is met again in the
    old half is held anew, so frequent keys stay."""

    #: What an entry takes besides its characters: the two objects' heads and its share of the table.
    ENTRY, LONG = 200, 48

    def __init__(self, make, most: int):
        self.make, self.most, self.held = make, most // 2, 0
        self.old: dict[str, bytes] = {}

    def hold(self, key: str, ids: bytes) -> None:
        if len(key) <= self.LONG:
            if self.held >= self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = ids
            self.held += self.ENTRY + len(key) + len(ids)

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self.hold(key, out)
        return out


#: Bytes of ids that a worker holds, if it is not told otherwise.
HELD = 160 << 20
#: Marks that follow a word: none is a letter, a digit or white space, so a row of them is one pre-token.
#: White space other than the blank and the line break.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = ".,;:!?#$%&*()[]{}<>\"'-_/\\|@^~+=`"


class Encoder:
    """``most`` bounds what is held, in bytes; a worker process has one encoder, for as long as it lives."""

    def __init__(self, path: str, most: int = HELD):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path) as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        #: Only for this plain form are ids put together from pre-tokens; anything else is encoded as a whole.
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.alphabet = str.maketrans({chr(k): v for k, v in _visible_bytes().items()})
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are held here already
        self.tokens = Ids(self._token, most // 8)
        self.words = Ids(self._word, most // 4 * 3)
        self.pieces = Ids(self._piece, most // 8)

    def _token(self, token: str) -> bytes:
        seen = token.encode().decode("latin1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The pre-token of a space and a word. ASCII letters stand for themselves in the byte alphabet."""
        seen = "\u0120" + word if word.isascii() and word.isalnum() else (" " + word).encode().decode("latin1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece stands after a space, or after the line break that it begins with."""
        parts = self.split.findall(piece if piece[0] == "\n" else " " + piece)
        return b"".join([self.words[p[1:]] if p[0] == " " else self.tokens[p] for p in parts])

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        # Where all white space is single blanks and line breaks between words, each is the start of a pre-token.
        if text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", "\n\n", " \n", "\n ")) or any(c in text for c in OTHER_SPACE):
            return b"".join(map(self.tokens.__getitem__, self.split.findall(text)))
        rest = text.replace("\n", " \n").split(" ")
        out = list(map(self.words.get, rest))
        out[0] = b"".join(map(self.tokens.__getitem__, self.split.findall(rest[0])))
        self._fill(rest, out)
        return b"".join(out)

    def _fill(self, pieces: list[str], out: list[bytes | None]) -> None:
        """The pieces after a space that are not held, or in the old half. With marks at its end a piece is held from the second time that its word is met.

        A text has a hundred of them where words are many, so they are worked off in one loop, and only longer ways are calls."""
        words, held, old, hold, tokenize = self.words, self.words.get, self.words.old, self.words.hold, self.model.tokenize
        for i in [i for i, ids in enumerate(out) if ids is None]:
            piece = pieces[i]
            if (ids := old.get(piece)) is not None:
                hold(piece, ids)
            else:
                word = piece if piece.isalpha() else piece.rstrip(MARKS)
                if not word.isalpha():
                    out[i] = self.pieces[piece]
                    continue
                ids = held(word)
                met = ids is not None
                if not met:
                    ids = old.get(word)
                    met = ids is not None
                    if not met:
                        ids = array("I", [t.id for t in tokenize("\u0120" + word)]).tobytes() if word.isascii() else self._word(word)
                    hold(word, ids)
                    old = words.old
                if word is not piece:
                    ids += self.tokens[piece[len(word) :]]
                    if met:
                        hold(piece, ids)
            old = words.old
            out[i] = ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = HELD) -> Encoder:
    """One for each worker process."""
    return Encoder(path, most)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
