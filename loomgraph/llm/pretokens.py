"""Pre-tokens of byte-level BPE files, cut as their library cuts them, whole batches at a time.

Texts of characters below U+0300 without special strings are cut by a fixed
number of numpy passes over their bytes: a pre-token begins where the class of
characters (letter, number, white space, other) changes, a single space goes to
the word that follows, and contractions stand alone. All other texts are cut by
the library. The distinct pre-tokens of a batch are named once; every place in
the batch then refers to them by number.

Memory: a batch takes some ten times its bytes, at most; the passes run over
windows of ``WINDOW`` bytes, so a single very long text adds its own bytes, one
flag for each and eight bytes for each of its pre-tokens. The library's cut takes
texts in parts of ``PART`` characters that end before a space.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

LETTER, NUMBER, OTHER, WHITE = range(4)
#: Characters below this code point are cut without the library.
LATIN = 0x300
WINDOW = 1 << 20
PART = 1 << 16
_PAST_LATIN = 0xCC  # first byte of a character from U+0300 on

_KIND = np.full(LATIN, OTHER, np.uint8)
for _kind, _class in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
    _KIND[[c for c in range(LATIN) if regex.match(_class, chr(c))]] = _kind


def kinds(buf: np.ndarray) -> np.ndarray:
    """The class of each byte's character, for UTF-8 text below U+0300."""
    out = _KIND[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead) and lead[-1] + 1 == len(buf):
        lead = lead[:-1]  # cut inside a character; only a window's margin is
    code = (buf[lead].astype(np.int32) & 0x1F) << 6 | (buf[lead + 1] & 0x3F)
    out[lead] = out[lead + 1] = _KIND[np.minimum(code, LATIN - 1)]
    return out


def _begins(buf: np.ndarray, head: np.ndarray, words: bool) -> np.ndarray:
    """Flags of the bytes at which pre-tokens begin; ``head`` flags the first bytes of texts.

    ``words`` is the form of word-level files: each digit stands alone, and a
    contraction may follow a space.
    """
    n = len(buf)
    kind = kinds(buf)
    first = (buf & 0xC0) != 0x80
    begin = head.copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    # The last character of a run of white space before a word stands for itself.
    ends = np.zeros(n, bool)
    ends[:-1] = white[:-1] & ~white[1:] & ~head[1:]
    begin |= ends & first
    long = ends & ~first
    begin[:-1] |= long[1:]
    if words:
        begin |= (kind == NUMBER) & first
    spaced = np.zeros(n, bool)
    spaced[1:] = (buf[:-1] == 0x20) & ~white[1:] & ~head[1:]
    quotes = np.flatnonzero((buf == 0x27) & (begin | spaced if words else begin & ~spaced))
    begin &= ~spaced
    for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        at = quotes[quotes + len(tail) < n]
        for j, c in enumerate(tail, 1):
            at = at[(buf[at + j] == c) & ~head[at + j]]
        begin[at + 1] = False
        after = at + len(tail) + 1
        begin[after[after < n]] = True
    return begin


def begins(buf: np.ndarray, offsets: np.ndarray, words: bool) -> np.ndarray:
    """Flags of the bytes at which pre-tokens begin, window by window."""
    n, margin = len(buf), 16
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[:-1] < n]] = True
    out = np.empty(n, bool)
    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        lo, hi = max(0, a - margin), min(n, b + margin)
        while lo and buf[lo] & 0xC0 == 0x80:
            lo -= 1
        out[a:b] = _begins(buf[lo:hi], head[lo:hi], words)[a - lo : b - lo]
    return out


@dataclass
class Cut:
    """Distinct pre-tokens of a batch, the number of each one in order of the texts, and bounds per text."""

    words: list[str]
    index: np.ndarray
    bounds: np.ndarray


class PreTokens:
    """Cuts texts as the file at ``path`` does; ``words`` is set for word-level files, which lower letters and drop white space.

    Special strings come out whole. Words of word-level files keep a space that
    goes before them, and runs of white space are words; see ``bare``.
    """

    def __init__(self, path: str, plain: bool = False):
        """``plain``: special strings inside texts are ordinary text."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        bytewise = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        split, level = pre["pretokenizers"] if pre.get("type") == "Sequence" and len(pre["pretokenizers"]) == 2 else ({}, {})
        self.words = split.get("type") == "Split" and split["invert"] and split["behavior"] == "Removed" and level["type"] == "ByteLevel" and not level["use_regex"]
        if not (bytewise or self.words):
            raise ValueError("only byte-level BPE files and word-level ones that drop white space are supported")
        self.model = spec["model"]
        self.has_decoder = spec.get("decoder") is not None
        if self.words:  # the library only cuts for such files, for which it needs no vocabulary
            text = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.special = {} if plain else {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or " " in x["content"] for x in spec["added_tokens"]):
            raise ValueError("only plain special strings are supported")
        self._apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._space = regex.compile(r" (?=[^\s\x1c-\x1f])")

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            found = self._space.search(text, at + PART)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def by_library(self, text: str) -> list[str]:
        """Pre-tokens of any text."""
        out: list[str] = []
        for i, segment in enumerate(self._apart.split(text) if self._apart else [text]):
            if i % 2:
                out.append(segment)
                continue
            for part in self._parts(segment):
                part = self.tokenizer.normalizer.normalize_str(part) if self.words else part
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def bare(self, word: str) -> str:
        """A word of a word-level file without its space; white space is empty."""
        word = word.removeprefix(" ")
        return "" if not word or (ord(word[0]) < LATIN and _KIND[ord(word[0])] == WHITE) else word

    def cut(self, texts: pa.Array) -> Cut:
        from loomgraph.llm.bytetext import text_buffer

        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        buf, offsets = text_buffer(texts)
        other = np.zeros(n, bool)
        other[np.searchsorted(offsets, np.flatnonzero(buf >= _PAST_LATIN), "right") - 1] = True
        for s in [*self.special, *(["İ"] if self.words else [])]:  # the lower case of that letter is two characters
            other |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        slow = [self.by_library(texts[int(i)].as_py()) for i in np.flatnonzero(other)]
        if other.any():
            texts = pc.if_else(pa.array(other), "", texts)
        if self.words:
            texts = pc.utf8_lower(texts)
        buf, offsets = text_buffer(texts)
        begin = np.flatnonzero(begins(buf, offsets, self.words))
        bounds = np.searchsorted(begin, offsets)
        ends = np.append(begin, len(buf))
        places = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(buf))
        if not slow:
            named = places.dictionary_encode()
            return Cut(named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy(), bounds)
        more = pa.array([x for found in slow for x in found], pa.large_string())
        named = pa.chunked_array([places, more]).combine_chunks().dictionary_encode()
        index = named.indices.to_numpy()
        # Texts that the library cut stand last; put all into the order of the texts.
        sizes, starts = np.diff(bounds), bounds[:-1].copy()
        sizes[other] = [len(x) for x in slow]
        starts[other] = len(begin) + np.cumsum([0, *map(len, slow)])[:-1]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(int(bounds[-1])) + np.repeat(starts - bounds[:-1], sizes)
        return Cut(named.dictionary.to_numpy(zero_copy_only=False).tolist(), index[at], bounds)


def chunked(words: list[str], size: int) -> Iterable[list[str]]:
    for a in range(0, len(words), size):
        yield words[a : a + size]


class Ids:
    """Ids of single pre-tokens of a byte-level file, by the library, in a few calls."""

    #: Longer pre-tokens are encoded by dynamic programming, for the library takes some 100 bytes for each of theirs.
    LONG = 1 << 16
    #: Pre-tokens in one text for the library.
    TOGETHER = 500

    def __init__(self, pre: PreTokens):
        self.pre, self.tokenizer = pre, pre.tokenizer
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.spaced, self.broken = np.zeros(size, bool), np.zeros(size, bool)
        self.spaced[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True  # the letter for a space
        self.broken[vocab["Ċ"]] = True  # the letter for a line break
        self._bpe = None

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<i4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _long(self, word: str) -> bytes:
        from loomgraph.llm.prefix_bpe import PrefixBpe, visible

        if self._bpe is None:
            self._bpe = PrefixBpe(self.pre.model)
        return np.array(self._bpe.encode(visible(word)), "<i4").tobytes()

    def _joined(self, words: list[str], before: str, borders: np.ndarray) -> list[bytes]:
        """Words that each begin at a token of ``borders`` when written one after another; ``before`` goes before each."""
        out: list[bytes] = []
        for part in chunked(words, 40 * self.TOGETHER):
            groups = list(chunked(part, self.TOGETHER))
            found = self.tokenizer.encode_batch_fast([before + before.join(g) for g in groups], add_special_tokens=False)
            for group, x in zip(groups, found, strict=True):
                ids = np.array(x.ids, "<i4")
                at = np.flatnonzero(borders[ids])
                if len(at) != len(group):
                    out += self._single(group)
                    continue
                raw, skip = ids.tobytes(), 4 * bool(before)
                ends = (np.append(at, len(ids)) * 4).tolist()
                out += [raw[a + skip : b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def of(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        after_space, plain, rest, made = [], [], [], {}
        special = self.pre.special
        for w in words:
            if len(w) > self.LONG:
                made[w] = self._long(w)
            elif w in special or w[-1].isspace() or w[0].isspace() and w[0] != " ":
                rest.append(w)
            elif w[0] == " ":
                after_space.append(w)
            else:
                plain.append(w)
        made |= zip(after_space, self._joined(after_space, "", self.spaced), strict=True)
        made |= zip(plain, self._joined(plain, "\n", self.broken), strict=True)
        for part in chunked(rest, 1000):
            made |= zip(part, self._single(part), strict=True)
        return made
