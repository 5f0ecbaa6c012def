"""Token ids of whole texts with a public word vocabulary, cached by word."""

from __future__ import annotations

import re

import numpy as np

#: entries that one Python worker keeps; later words are encoded anew, with the same ids
CACHE = 600_000
#: lower-case letters that are their own normal form
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: marks that may follow a word; a run of them is one token group of its own
MARKS = ".,!?%$&#*;:()-"

_made: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a vocabulary file; a Python worker keeps it between tasks."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


class _Pieces(dict):
    """Ids of pieces between blanks, made on first use."""

    def __init__(self, owner: "Encoder"):
        super().__init__({"": b""})
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        out = self.owner.piece(piece)
        if len(self) < CACHE:
            self[piece] = out
        return out


class Encoder:
    """Ids of a text, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The vocabulary never joins characters across white space, so a text is cut at
    blanks and line ends and each piece is looked up.  A new piece of lower-case
    Latin-1 letters and marks goes straight to the vocabulary's merges; any other
    piece takes the tokenizer's whole path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        # the alphabet that the merges are written in
        self.alphabet = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
        self.pieces = _Pieces(self)
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _one(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, p: str) -> bytes:
        w = p.rstrip(MARKS)
        if not LETTERS.fullmatch(w):
            return self._one(p)
        t = p[len(w) :]
        if (end := self.tails.get(t)) is None:
            end = self._one(t)
            if len(self.tails) < CACHE:
                self.tails[t] = end
        if (b := self.words.get(w)) is None:
            b = b"".join([k.id.to_bytes(4, "little") for k in self.model.tokenize(w if w.isascii() else w.translate(self.alphabet))])
            if len(self.words) < CACHE:
                self.words[w] = b
        return b + end

    def _plain(self, s: str) -> str:
        """The text in lower case where that changes no id: Latin-1 characters only, no special token."""
        try:
            s.encode("latin-1")
        except UnicodeEncodeError:
            return s
        return s if "<|" in s else s.lower()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.pieces.__getitem__, self._plain(text).replace("\n", " ").split(" ")))
