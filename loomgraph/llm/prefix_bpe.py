"""BPE by dynamic programming over prefixes.

A sequence of tokens is the BPE encoding of its string exactly if every two
neighbours are compatible, that is, if merging their joined string would never
merge across their border. So the encoding of each prefix of a word ends in
exactly one token that is compatible with the last token of the prefix before
it. An automaton over all token strings yields the tokens that end at each
place; the first compatible one is stored, and back-pointers give the ids.

In a vocabulary with an end-of-word mark, a word's last symbol carries the mark
and is a symbol of its own.

Memory: some 50 MB for the tables of 50,000 tokens, 20 MB for pair tests and
what they look up at most, and some 20 bytes for each byte of the word in hand.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick

_NEVER = 1 << 60
#: Moves a character that carries the end-of-word mark out of the way of all others.
_MARKED = 0x100000
#: Pair tests that are kept, and spines of tokens on either side.
PAIRS = 100_000
SPINES = 15_000


def _visible_bytes() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


_VISIBLE = _visible_bytes()
_VISIBLE_TABLE = dict(enumerate(_VISIBLE))


def visible(word: str) -> str:
    """A word in the characters of byte-level vocabularies."""
    return word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(_VISIBLE_TABLE)


class PrefixBpe:
    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        self.mark: str = model.get("end_of_word_suffix") or ""
        self.strings = {i: t for t, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged: dict[int, int] = {}  # (left, right) packed -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        for rank, (a, b) in enumerate(merges):
            left, right, token = vocab[a], vocab[b], vocab[a.removesuffix(self.mark) + b if self.mark else a + b]
            self.merged[left << 32 | right] = rank
            self.parts.setdefault(token, (left, right, rank))
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            if self.whole(token):  # others stand in no encoding
                symbols = self._symbols(text)
                self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()
        self._whole.clear()
        self.forget()

    def forget(self) -> None:
        """Drop the pair tests and spines that are kept."""
        for table in (self._fits, self._left, self._right):
            table.clear()

    def _symbols(self, text: str) -> str:
        if self.mark and text.endswith(self.mark) and len(text) > len(self.mark):
            text = text[: -len(self.mark)]
            return text[:-1] + chr(ord(text[-1]) + _MARKED)
        return text

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that touch its border, outermost last: (part, rank of the merge that ends it)."""
        chain = [(token, _NEVER)]
        while token in self.parts:
            parts = self.parts[token]
            token = parts[side]
            chain.append((token, parts[2]))
        return chain[::-1]

    def _first_crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of two tokens that grow side by side."""
        left, right = self._right.get(a), self._left.get(b)
        if left is None:
            if len(self._right) >= SPINES:
                self._right.clear()
            left = self._right[a] = self._spine(a, 1)
        if right is None:
            if len(self._left) >= SPINES:
                self._left.clear()
            right = self._left[b] = self._spine(b, 0)
        first = _NEVER
        merged = self.merged
        for x, x_ends in left:
            for y, y_ends in right:
                found = merged.get(x << 32 | y)
                # Of equal merges the one further left goes first: x must still stand, y may just be about to go.
                if found is not None and found < x_ends and found <= y_ends and found < first:
                    first = found
        return first

    def whole(self, token: int) -> bool:
        """Whether BPE turns the token's own string into the token."""
        known = self._whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self._whole[token] = parts is None or (self.whole(parts[0]) and self.whole(parts[1]) and self._first_crossing(parts[0], parts[1]) == parts[2])
        return known

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._first_crossing(a, b) == _NEVER
        return known

    def encode(self, word: str) -> list[int] | array:
        """Ids of one pre-token, given as the characters of the vocabulary; an array if it is long."""
        if not word:
            return []
        symbols = word[:-1] + chr(ord(word[-1]) + _MARKED) if self.mark else word
        n = len(symbols)
        kind = list if n < 1000 else (lambda x: array("i", x))  # lists are faster, arrays smaller
        last, size = kind([-1]) * (n + 1), kind([0]) * (n + 1)
        known = self._fits.get
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 32 | token)
                if not (self.fits(before, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        out = kind([])
        while n:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks a symbol of the text")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out


def load(path: str) -> PrefixBpe:
    with open(path, encoding="utf-8") as f:
        return PrefixBpe(json.load(f)["model"])
