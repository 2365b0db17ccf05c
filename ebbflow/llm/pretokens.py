"""Cutting texts into pieces that a byte-level BPE encodes independently of each other."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Fixed value: the public byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: A space between two white-space characters, or between one and the end: there a cut would change a token.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


def pieces(text: str) -> tuple[list[str], bool]:
    """(pieces, safe): if safe, all pieces but the first stand for themselves after a space.

    A pre-token holds a space only at its start or inside white space, and white space before a word leaves its last
    space to that word. So a text may be cut before every space that has no white space on one of its sides; each
    piece then gives the same tokens alone as in its text. Other texts come back whole.
    """
    if UNSAFE.search(text):
        return [text], False
    return text.split(" "), True


#: Pieces longer than this aren't remembered.
LONG_PIECE = 80


class Encoder:
    """Encodes texts through what it remembers of their pieces and pre-tokens; new pre-tokens go to ``encode_new``.

    ``encode_new`` maps a list of pre-tokens to their ids as little-endian unsigned 32-bit integers. ``special`` holds
    the strings that are tokens of their own wherever they occur. About ``most`` entries are kept.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], special: dict[str, int], most: int):
        self.encode_new, self.most = encode_new, most
        self.special = {text: np.uint32(i).tobytes() for text, i in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.alone: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _learn(self, cache: dict[str, bytes], lead: str, new: set[str]) -> None:
        tokens, after = self.tokens, self.after_space
        whole = [x for x in new if x.isalpha()]
        mixed = [(x, PATTERN.findall(lead + x)) for x in new if not x.isalpha()]
        needed = {lead + x for x in whole}
        for _, parts in mixed:
            needed.update(parts)
        found, unknown = {}, []
        for t in needed:
            ids = tokens.get(t)
            if ids is None and t[0] == " ":
                ids = after.get(t[1:])
            if ids is None:
                unknown.append(t)
            else:
                found[t] = ids
        found.update(zip(unknown, self.encode_new(unknown)))
        get = found.__getitem__
        for x in whole:
            cache[x] = get(lead + x)
        for x, parts in mixed:
            cache[x] = b"".join(map(get, parts))
        for t in unknown:
            if len(t) <= LONG_PIECE and not (lead and t[0] == " " and t[1:] in cache):
                tokens[t] = found[t]

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        if len(self.after_space) + len(self.alone) + len(self.tokens) > self.most:
            for cache in (self.alone, self.after_space, self.tokens):
                cache.clear()
        first: set[str] = set()
        later: set[str] = set()
        docs = []
        for text in texts:
            # What is known is looked up once; a part with unknown pieces waits as (cache, pieces, ids so far).
            own: list = []
            cut = self.split_special.split(text) if self.split_special and any(map(text.__contains__, self.special)) else [text]
            for k, segment in enumerate(cut):
                if k % 2:
                    own.append(self.special[segment])
                    continue
                found, safe = pieces(segment)
                if not safe:
                    self._take(own, first, self.alone, PATTERN.findall(segment))
                else:
                    self._take(own, first, self.alone, found[:1])
                    self._take(own, later, self.after_space, found[1:])
            docs.append(own)
        self._learn(self.alone, "", first)
        self._learn(self.after_space, " ", later)
        out = [b"".join([x if isinstance(x, bytes) else b"".join([x[0][p] if i is None else i for p, i in zip(x[1], x[2])]) for x in own]) for own in docs]
        for cache, new in ((self.alone, first), (self.after_space, later)):
            for piece in [x for x in new if len(x) > LONG_PIECE]:
                del cache[piece]
        return out

    @staticmethod
    def _take(own: list, new: set[str], cache: dict[str, bytes], found: list[str]) -> None:
        ids = list(map(cache.get, found))
        try:
            own.append(b"".join(ids))
        except TypeError:
            new.update([p for p, i in zip(found, ids) if i is None])
            own.append((cache, found, ids))
